"""Random forests that score rows while their trees grow.

Deep trees of many rows end in hundreds of thousands of nodes, and one job for
each level that sends the statistics of every node takes hours. Here Spark deals the
rows and small nodes are finished where their rows are:

1. Values become the numbers of at most BINS ranges, with cut points at the
   values of few-valued places and else at quantiles, and rows alike in all ranges become one
   with its counts per label. Rows to be scored go along, without counts.
2. A tree draws its bootstrap as Poisson counts: for n equal rows Poisson(n),
   the sum of n draws. Draws are those of (seed, tree, block of rows), so every pass has the same.
3. Up to LOCAL_ROWS distinct rows (LOCAL_BYTES) are broadcast, and each task grows some of the
   trees, whole; no row is shuffled, only the votes summed over a task's trees.
4. Above that, while a node holds more than NODE_ROWS rows, its split is chosen from
   histograms that all tasks add to (one row per node to the driver); below that
   its rows meet in one task, which grows the subtree and keeps the vote of each
   row that is to be scored. A node that no cut divides is a leaf, whatever its size.
5. The score is the mean vote of all trees, joined back by the ranges.

Each node tries sqrt(places) random places (rounded up); impurity is Gini with the class weights
of the training rows; both children hold ``min_leaf`` drawn rows or more; a vote is
the weighted share of label 1 in the leaf, 0 in a tree that drew no row.
"""
from __future__ import annotations

import math
import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .rows import running_sums

# Functions that run on executors are sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
#: Distinct rows, and bytes of them, that every task may hold to grow whole trees.
LOCAL_ROWS = 3_000_000
LOCAL_BYTES = 256_000_000
#: Where there are more, distinct rows of a node that one task finishes.
NODE_ROWS = 100_000
#: Rows whose quantiles are Spark's summaries of them all; of more, the distinct values are ranked by their counts.
SUMMARIZED = 50_000
#: Rows of small nodes that are looked at together; what is made for them stays in the processor's cache.
CHUNK = 32_768
#: Counts of both labels are summed as one number while either sum is below this.
PACKED = 2.0 ** 26
#: Histograms that a task holds before it passes them on.
HISTOGRAMS = 20_000


def cut_points(rows: DataFrame, width: int) -> list[list[float]]:
    """Ascending cut points of each place of the array column ``x``; a value is
    left of a cut if it is no larger. ``n``, if there, counts the rows that a row
    stands for. Few-valued places are cut at each value, others at the values of
    rank ceil(k / BINS * rows), or up to one beside it in Spark's summaries. At most
    BINS rows per place come to the driver."""
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    if (rows.agg(F.sum(n)).first()[0] or 0) <= SUMMARIZED:
        return _summarized(rows.select("x", F.explode(F.sequence(F.lit(1), n))).coalesce(1), width)
    values = rows.select(F.posexplode("x").alias("i", "v"), n.alias("n")).groupBy("i", "v").agg(F.sum("n").alias("n"))
    placed = running_sums(values.withColumn("one", F.lit(1)), ["i"], "v", ["n", "one"])
    ranks = [F.ceil(F.col("n_total") * F.lit(k / BINS)) for k in range(1, BINS)]
    hit = F.array(*[(F.col("n_below") < r) & (r <= F.col("n_below") + F.col("n")) for r in ranks])
    told = placed.where((F.col("one_total") <= BINS) | F.exists(hit, lambda x: x)).select("i", "v", "one_total").collect()
    cuts = []
    for i in range(width):
        own = sorted((r.v, r.one_total) for r in told if r.i == i)
        cuts.append([v for v, _ in own][:-1 if own and own[0][1] <= BINS else None])
    return cuts


def _summarized(rows: DataFrame, width: int) -> list[list[float]]:
    probs = [k / BINS for k in range(1, BINS)]
    place = [F.get("x", F.lit(i)) for i in range(width)]
    told = rows.agg(*[F.percentile_approx(x, probs, 10_000).alias(f"q{i}") for i, x in enumerate(place)],
                    *[F.approx_count_distinct(x).alias(f"n{i}") for i, x in enumerate(place)]).first()
    few = [i for i in range(width) if told[f"n{i}"] <= BINS + BINS // 4]
    values = rows.agg(F.lit(0), *[F.collect_set(place[i]).alias(f"v{i}") for i in few]).first()
    cuts = [sorted(set(told[f"q{i}"] or [])) for i in range(width)]
    for i in few:
        if len(values[f"v{i}"]) <= BINS:
            cuts[i] = sorted(values[f"v{i}"])[:-1]
    return cuts


def binned(cuts: list[list[float]]):
    """Column function: the array as one byte per place, its range's number."""
    edges = [np.array(c, dtype=float) for c in cuts]

    @F.pandas_udf("binary")
    def of(x: pd.Series) -> pd.Series:
        values = np.stack(x.to_numpy())
        out = np.empty(values.shape, np.uint8)
        for i, e in enumerate(edges):
            out[:, i] = np.searchsorted(e, values[:, i], "left")
        return pd.Series([r.tobytes() for r in out])
    return of


def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of rows, each as one record; a block's name is its first row's."""
    for b in batches:
        if len(b):
            yield pd.DataFrame([(b.row.iloc[0], b"".join(b.bins), b[["n0", "n1"]].to_numpy(np.int64).tobytes(), b.row.to_numpy(np.int64).tobytes(), b.asked.to_numpy(bool).tobytes())],
                               columns=["block", "bins", "n", "rows", "asked"])


def drawn(seed: int, tree: int, block: int, n: np.ndarray) -> np.ndarray:
    """The bootstrap's counts of a block's rows for a tree."""
    return np.random.default_rng([seed, tree, block]).poisson(n).astype(np.int32)


def tried(rng, nodes: int, width: int) -> np.ndarray:
    """For each node the places it tries: distinct ones, drawn evenly."""
    places, at = np.tile(np.arange(width, dtype=np.int32), (nodes, 1)), np.arange(nodes)
    tries = math.ceil(math.sqrt(width))
    for k in range(tries):
        other = rng.integers(k, width, nodes)
        places[:, k], places[at, other] = places[at, other], places[:, k].copy()
    return places[:, :tries]


def best_cut(h: np.ndarray, weights, min_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(gain, cut) for each node from its histogram (2, nodes, BINS) of label
    counts; the gain is 0 where no cut divides the node."""
    left = np.cumsum(h, axis=2)
    total, left = left[:, :, -1:], left[:, :, :-1]
    right = total - left
    fits = (left.sum(0) >= min_leaf) & (right.sum(0) >= min_leaf)
    w = np.array(weights).reshape(2, 1, 1)

    def purity(c):
        c = c * w
        s = c.sum(0)
        return (c * c).sum(0) / np.where(s > 0, s, 1.0)

    base = purity(total)
    gain = np.where(fits, purity(left) + purity(right) - base, 0.0)
    cut = gain.argmax(1)
    best = np.take_along_axis(gain, cut[:, None], 1)[:, 0]
    return np.where(best > 1e-9 * (total * w).sum(0)[:, 0], best, 0.0), cut


def vote(n0, n1, weights):
    """The weighted share of label 1."""
    a, b = n0 * weights[0], n1 * weights[1]
    return b / np.where(a + b > 0, a + b, 1.0)


def purity(n0, n1, weights):
    """The weighted size of a node times one less its impurity."""
    a, b = n0 * weights[0], n1 * weights[1]
    s = a + b
    return (a * a + b * b) / np.where(s > 0, s, 1.0)


def parted(c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The counts of label 0 and 1, of sums that hold both as one number or one each."""
    if len(c) == 2:
        return c
    n1 = np.floor(c[0] * (1 / PACKED))
    return c[0] - n1 * PACKED, n1


def best_cuts(flat, base, own, c, places, total, weights, min_leaf):
    """(gain, place, cut) for each of some nodes from their rows: ``own`` has the
    node of each row, ``flat[base + place]`` its ranges, ``c`` its counts. Only
    ranges that rows have are looked at; the gain is 0 where no cut divides the node."""
    m = len(places)
    found = np.zeros((3, m))
    before = [np.cumsum(t) - t for t in total]
    t0, t1 = parted(total)
    whole, least = purity(t0, t1, weights), 1e-9 * (t0 * weights[0] + t1 * weights[1])
    cells, places = own * BINS, places.astype(np.int64)
    for k in range(places.shape[1]):
        cell = cells + flat[base + places[:, k][own]]
        h = [np.bincount(cell, x, m * BINS) for x in c]
        used = np.flatnonzero(h[0] if len(h) == 1 else h[0] + h[1])
        node = used // BINS
        left = parted([np.cumsum(x[used]) - b[node] for x, b in zip(h, before)])
        n0, n1 = t0[node], t1[node]
        drawn = left[0] + left[1]
        fits = np.flatnonzero((drawn >= min_leaf) & (n0 + n1 - drawn >= min_leaf))
        if not len(fits):
            continue
        node, a, b = node[fits], left[0][fits], left[1][fits]
        gain = purity(a, b, weights) + purity(n0[fits] - a, n1[fits] - b, weights) - whole[node]
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        most = np.maximum.reduceat(gain, first)
        size = np.diff(np.append(first, len(node)))
        at = np.flatnonzero(gain == np.repeat(most, size))
        at = at[np.concatenate([[True], node[at[1:]] != node[at[:-1]]])]
        x = node[at]
        better = (most > least[x]) & (most > found[0, x])
        x, at = x[better], at[better]
        found[0, x], found[1, x], found[2, x] = most[better], places[x, k], used[fits[at]] % BINS
    return found


def subtree(bins: np.ndarray, counts: np.ndarray, asked: np.ndarray, weights, rng, depth: int, max_depth: int, min_leaf: int) -> np.ndarray:
    """Grows the tree below a node at ``depth`` from its rows, level by level,
    and returns the vote of each asked row. The rows stay in the order of their
    nodes, so that a level is gone through in stretches of CHUNK rows."""
    votes, width, flat = np.zeros(len(bins)), bins.shape[1], bins.ravel()
    at = np.flatnonzero((counts.sum(1) > 0) | asked)
    if not len(at):
        return votes
    c = [counts[at, 0].astype(float), counts[at, 1].astype(float)]
    if max(x.sum() for x in c) < PACKED:
        c = [c[0] + c[1] * PACKED]
    start, total = np.array([0]), [x.sum(keepdims=True) for x in c]

    def is_open(total, depth):
        n0, n1 = parted(total)
        return (np.minimum(n0, n1) > 0) & (n0 + n1 >= 2 * min_leaf) & (depth < max_depth)

    if not is_open(total, depth)[0]:
        votes[at] = vote(*parted(total), weights)[0]
        return votes
    while len(at):
        nodes, size = len(start), np.diff(np.append(start, len(at)))
        places = tried(rng, nodes, width)
        split, right = np.empty(nodes, bool), np.empty(len(at), bool)
        ends = np.append(start, len(at))
        first = 0
        while first < nodes:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, "right")) - 1)
            rows = slice(ends[first], ends[last])
            own = np.repeat(np.arange(last - first), size[first:last])
            if last > first + 1:
                local = bins.take(at[rows], axis=0)
                f, base = local.ravel(), np.arange(len(local)) * width
            else:
                f, base = flat, at[rows] * width
            gain, place, cut = best_cuts(f, base, own, [x[rows] for x in c], places[first:last], [t[first:last] for t in total], weights, min_leaf)
            split[first:last] = gain > 0
            right[rows] = f[base + place.astype(np.int64)[own]] > cut[own]
            first = last
        # children
        node = np.repeat(np.arange(nodes), size)
        child = 2 * node + right
        sums = [np.bincount(child, x, 2 * nodes) for x in c]
        stay = ~split
        open_ = is_open(sums, depth + 1) & np.repeat(split, 2)
        v = vote(*parted(sums), weights)
        if stay.any():
            v[0::2][stay] = v[1::2][stay] = vote(*parted(total), weights)[stay]
        ended = ~open_[child]
        votes[at[ended]] = v[child[ended]]
        keep = np.flatnonzero(~ended)
        number = np.cumsum(open_) - 1
        ch = number[child[keep]]
        order = np.sort((ch << 32) | keep)
        idx = order & 0xffffffff
        at, c = at[idx], [x[idx] for x in c]
        total = [s[open_] for s in sums]
        own = order >> 32
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.array([], np.int64)
        depth += 1
    return votes


def routed(bins: np.ndarray, splits: dict) -> np.ndarray:
    """The node (root 1, children of n: 2n and 2n + 1) that each row has come to."""
    node = np.ones(len(bins), np.int64)
    for n, (place, cut) in sorted(splits.items()):
        own = node == n
        node[own] = 2 * n + (bins[own, place] > cut)
    return node


class Growing:
    """The nodes of all trees that are too large for one task: their splits, and the votes of those that are leaves."""

    def __init__(self, trees: int, seed: int, max_depth: int, min_leaf: int, weights: tuple[float, float], width: int):
        self.trees, self.seed, self.max_depth, self.min_leaf, self.weights, self.width = trees, seed, max_depth, min_leaf, weights, width
        self.splits, self.leaves = defaultdict(dict), {}

    def rng(self, tree: int, node: int):
        return np.random.default_rng([self.seed, tree, node, 1])

    def _blocks(self, batches):
        for b in batches:
            for r in b.itertuples(index=False):
                yield (r.block, np.frombuffer(r.bins, np.uint8).reshape(-1, self.width), np.frombuffer(r.n, np.int64).reshape(-1, 2),
                       np.frombuffer(r.rows, np.int64), np.frombuffer(r.asked, bool))

    def whole(self, groups: int, n: int):
        """For mapInPandas over all ``n`` rows by block, the same for each group:
        grows the group's trees and gives their votes summed, a record for each
        block; the rows' numbers go along once, with group 0."""
        def of(batches):
            bins, counts, asked, blocks, ids, group = np.empty((n, self.width), np.uint8), np.empty((n, 2), np.int64), np.empty(n, bool), [], [], None
            at = 0
            for b in batches:
                group = int(b.group.iloc[0]) if len(b) else group
                for block, x, c, rows, a in self._blocks([b]):
                    end = at + len(rows)
                    bins[at:end], counts[at:end], asked[at:end] = x, c, a
                    blocks.append((block, at, end))
                    ids.append(np.where(a, rows, -1).tobytes() if group == 0 else b"")
                    at = end
            if group is None:
                return
            votes = np.zeros(n)
            for tree in range(group, self.trees, groups):
                taken = np.concatenate([drawn(self.seed, tree, block, counts[i:j]) for block, i, j in blocks])
                votes += subtree(bins, taken, asked, self.weights, self.rng(tree, 1), 0, self.max_depth, self.min_leaf)
            for (block, i, j), own in zip(blocks, ids):
                yield pd.DataFrame([(block, group, own, votes[i:j].tobytes())], columns=["block", "group", "ids", "votes"])
        return of

    def summed(self):
        """For applyInPandas: the votes of a block's asked rows, summed over the groups in their order."""
        def of(told: pd.DataFrame) -> pd.DataFrame:
            told = told.sort_values("group")
            ids, votes = np.frombuffer(b"".join(told.ids), np.int64), sum(np.frombuffer(v) for v in told.votes)
            return pd.DataFrame({"row": ids[ids >= 0], "votes": votes[ids >= 0]})
        return of

    def histograms(self, large: dict[int, list[int]]):
        """For mapInPandas: of each large node the counts by tried place and
        range, of the labels and of the rows, as each task adds them up."""
        def of(batches):
            sums = {}
            for block, bins, n, _, asked in self._blocks(batches):
                for tree, own in large.items():
                    counts = drawn(self.seed, tree, block, n)
                    node = routed(bins, self.splits.get(tree, {}))
                    for x in own:
                        use = np.flatnonzero((node == x) & ((counts.sum(1) > 0) | asked))
                        if len(use):
                            by = [counts[use, 0], counts[use, 1], np.ones(len(use))]
                            h = np.stack([[np.bincount(bins[use, p], w, BINS) for p in tried(self.rng(tree, x), 1, self.width)[0]] for w in by])
                            sums[tree, x] = sums.get((tree, x), 0) + h
                if len(sums) > HISTOGRAMS:
                    yield pd.DataFrame([(t, x, h.tobytes()) for (t, x), h in sums.items()], columns=["tree", "node", "h"])
                    sums = {}
            yield pd.DataFrame([(t, x, h.tobytes()) for (t, x), h in sums.items()], columns=["tree", "node", "h"])
        return of

    def choice(self):
        """For applyInPandas: the split of one node, its place -1 for a leaf."""
        def of(key: tuple, told: pd.DataFrame) -> pd.DataFrame:
            tree, node = int(key[0]), int(key[1])
            h = sum(np.frombuffer(x).reshape(3, -1, BINS) for x in told.h)
            gain, cut = best_cut(h[:2], self.weights, self.min_leaf)
            k = int(gain.argmax())
            n0, n1, n = h[:, k].sum(1)
            if gain[k] <= 0 or node.bit_length() > self.max_depth:
                return pd.DataFrame([(tree, node, -1, 0, 0, 0, float(vote(n0, n1, self.weights)))], columns=CHOICE)
            left = int(h[2, k, :cut[k] + 1].sum())
            return pd.DataFrame([(tree, node, int(tried(self.rng(tree, node), 1, self.width)[0][k]), int(cut[k]), left, int(n) - left, 0.0)], columns=CHOICE)
        return of

    def pieces(self):
        """For mapInPandas: the rows of each block by tree and node. A leaf's rows stay by block."""
        def of(batches):
            for block, bins, n, rows, asked in self._blocks(batches):
                ids = np.where(asked, rows, -1)
                for tree in range(self.trees):
                    counts = drawn(self.seed, tree, block, n)
                    node = routed(bins, self.splits.get(tree, {}))
                    use = (counts.sum(1) > 0) | asked
                    told = []
                    for x in np.unique(node[use]).tolist():
                        own = np.flatnonzero(use & (node == x))
                        told.append((tree, x, block if (tree, x) in self.leaves else -1, bins[own].tobytes(), counts[own].tobytes(), ids[own].tobytes()))
                    yield pd.DataFrame(told, columns=["tree", "node", "part", "bins", "counts", "ids"])
        return of

    def votes(self):
        """For applyInPandas: the votes of the rows at one node of a tree."""
        def of(key: tuple, told: pd.DataFrame) -> pd.DataFrame:
            tree, node = int(key[0]), int(key[1])
            ids = np.frombuffer(b"".join(told.ids), np.int64)
            asked = ids >= 0
            if (tree, node) in self.leaves:
                return pd.DataFrame({"row": ids[asked], "votes": self.leaves[tree, node]})
            bins = np.frombuffer(b"".join(told.bins), np.uint8).reshape(-1, self.width)
            counts = np.frombuffer(b"".join(told.counts), np.int32).reshape(-1, 2)
            votes = subtree(bins, counts, asked, self.weights, self.rng(tree, node), node.bit_length() - 1, self.max_depth, self.min_leaf)
            return pd.DataFrame({"row": ids[asked], "votes": votes[asked]})
        return of


CHOICE = ["tree", "node", "place", "cut", "left_rows", "right_rows", "vote"]


def score_forest(train: DataFrame, test: DataFrame, trees: int, seed: int, max_depth: int, min_leaf: int) -> DataFrame:
    """``test`` with p and y_pred by a forest of ``train`` (y, weight, features; a
    weight for each label). A row of ``train`` may stand for ``n`` rows. Rows are
    numbered in the order of ``first``, or else as they are read."""
    weights = {r.y: r.weight for r in train.groupBy("y").agg(F.first("weight").alias("weight")).collect()}  # one row per label
    spark = train.sparkSession
    width = train.select(F.size(vector_to_array("features"))).first()[0]
    count = F.col("n") if "n" in train.columns else F.lit(1).cast("long")
    of = binned(cut_points(train.select(vector_to_array("features").alias("x"), count.alias("n")), width))

    def rows_of(df: DataFrame, counts: list, asked: bool) -> DataFrame:
        first = F.col("first") if "first" in df.columns else F.monotonically_increasing_id()
        return df.select(of(vector_to_array("features")).alias("bins"), *[c.cast("long").alias(f"n{k}") for k, c in enumerate(counts)],
                         F.lit(asked).alias("asked"), (first + F.lit(2 ** 62 if asked else 0)).alias("first"))

    alike = rows_of(train, [F.when(F.col("y") == k, count).otherwise(0) for k in (0, 1)], False)
    distinct = alike.unionByName(rows_of(test, [F.lit(0)] * 2, True)).groupBy("bins").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.max("asked").alias("asked"), F.min("first").alias("first"))
    # Draws are dealt by place, so rows stand in an order of their own: as they are first read, by part of the shuffle.
    read_by = F.when(F.col("first") < 2 ** 62, 0).otherwise(F.shiftright(F.col("first") - 2 ** 62, 33) + 1)
    part = F.pmod(F.hash("bins"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ordered = distinct.sortWithinPartitions(read_by, part, "first").drop("first")
    rows = materialize(ordered.withColumn("row", F.monotonically_increasing_id()), "forest_rows")
    blocks = materialize(rows.mapInPandas(packed, "block long, bins binary, n binary, rows binary, asked binary"), "forest_blocks")
    n = rows.count()
    forest = Growing(trees, seed, max_depth, min_leaf, (weights.get(0, 1.0), weights.get(1, 1.0)), width)
    if n <= LOCAL_ROWS and n * (width + 25) <= LOCAL_BYTES:
        groups = min(trees, 2 * spark.sparkContext.defaultParallelism)
        every = spark.range(0, groups, 1, groups).withColumnRenamed("id", "group").join(F.broadcast(blocks), how="cross")
        votes = every.mapInPandas(forest.whole(groups, n), "block long, group long, ids binary, votes binary") \
            .groupBy("block").applyInPandas(forest.summed(), "row long, votes double").select("row", (F.col("votes") / trees).alias("p"))
    else:
        votes = dealt_votes(forest, blocks, n)
    scores = materialize(rows.join(votes, "row").select("bins", "p"), "forest_scores")
    return test.withColumn("_bins", of(vector_to_array("features"))).join(scores.withColumnRenamed("bins", "_bins"), "_bins", "left").drop("_bins") \
        .withColumn("y_pred", F.when(F.col("p") > 0.5, 1).otherwise(0))


def dealt_votes(forest: Growing, blocks: DataFrame, n: int) -> DataFrame:
    """(row, p) of the asked rows where there are too many for one task: large
    nodes are split by histograms, small ones dealt to tasks."""
    most = min(NODE_ROWS, LOCAL_ROWS)
    large = {t: [1] for t in range(forest.trees)}
    while large:
        told = blocks.mapInPandas(forest.histograms(large), "tree long, node long, h binary").groupBy("tree", "node") \
            .applyInPandas(forest.choice(), "tree long, node long, place int, cut int, left_rows long, right_rows long, vote double").collect()  # one row per large node
        large = defaultdict(list)
        for r in told:
            if r.place < 0:
                forest.leaves[r.tree, r.node] = r.vote
                continue
            forest.splits[r.tree][r.node] = (r.place, r.cut)
            large[r.tree] += [2 * r.node + side for side, k in enumerate((r.left_rows, r.right_rows)) if k > most]
        large = {t: own for t, own in large.items() if own}
    # Growing takes time and few bytes: Spark is told the number of tasks.
    groups = forest.trees * math.ceil(n / most)
    dealt = blocks.mapInPandas(forest.pieces(), "tree long, node long, part long, bins binary, counts binary, ids binary").repartition(max(1, groups), "tree", "node", "part")
    return dealt.groupBy("tree", "node", "part").applyInPandas(forest.votes(), "row long, votes double").groupBy("row").agg((F.sum("votes") / forest.trees).alias("p"))
