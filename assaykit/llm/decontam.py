"""Benchmark decontamination by spaced seeds. DataFrame functions only.

Tokens are runs of letters and digits, lower-cased. A mask is three tokens,
``gap`` ignored ones and three more; for every position of a benchmark item
and of a document the six tokens under the mask are hashed, and equal hashes
join. From each hit the two token sequences are compared in step, to the first
and last token of the shorter side, whatever its length. An overlap
is a stretch of ``MIN_TOKENS`` tokens or more (the whole item, if shorter) with
4 of 5 equal: the one of best score (+1 equal, -2 substituted) if that has
both, otherwise the longest that has.

An item shorter than the longest mask is searched by its first and its last
``SIDE`` tokens. With 4 of 5 equal it may hold one substituted token from five
tokens on, and one of the two ends is then as it was; in an item of five tokens
the middle one belongs to both, and that one must be equal. Items of one or two
tokens (under ``MIN_ITEM``) are single words or pairs that any text holds; they
are no evidence and are not searched. The item hashes are broadcast in blocks of at most ``BLOCK`` rows; a
larger benchmark is searched block after block, so any size gives whole results
in bounded memory, and the documents are never shuffled.

Defined cases: a null or empty text or item has no tokens and never matches;
items with equal tokens are one, under their smallest id (null ids last); texts
under one id, or without an id, are searched each for itself and give one row a
document, that of the best overlap; rows
that repeat a doc_id and text are one document in the result; equal overlaps are
resolved to the earliest; empty tables give an empty result; other columns are
not read by the search and come through ``clean`` unchanged.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import running, whole
from assaykit.session import materialize

SIDE, GAPS = 3, (1, 2, 4)
MIN_TOKENS, MIN_ITEM = 12, SIDE
EQUAL, OF = 4, 5
BLOCK = 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of the tokens of a text, in order."""
    return F.transform(F.array_remove(F.split(F.lower(whole(text)), r"[^\p{L}\p{N}]+", -1), ""), lambda w: F.xxhash64(w))


def offsets(gap: int) -> list[int]:
    return [*range(SIDE), *range(SIDE + gap, 2 * SIDE + gap)]


def _positions(df: DataFrame) -> DataFrame:
    """One row per position ``at`` of ``toks``, with ``side``, the hash of the
    SIDE tokens from there. The hash is taken after the explode, where it is
    compiled; outer, as Spark copies what feeds a plain explode into a filter
    below it and would compute it twice."""
    df = df.select("*", F.posexplode_outer("toks").alias("at", "t"))
    return df.withColumn("side", F.xxhash64("t", *[F.get("toks", F.col("at") + k) for k in range(1, SIDE)])).drop("t")


def _keyed(positions: DataFrame, masks: list[list[int]]) -> DataFrame:
    """One row per position and mask: ``mask`` and ``key``, the hash of the
    tokens under the mask."""
    # A lambda keeps this out of the compiled stage before it, which would grow too large to be compiled well.
    rest = F.array(*[F.array(*[F.lit(o) for o in at[SIDE:]]).cast("array<int>") for at in masks])
    key = lambda at, m: F.aggregate(at, F.xxhash64(m, F.col("side")), lambda a, o: F.xxhash64(a, F.get("toks", F.col("at") + o)))
    each = F.explode_outer(F.transform(rest, lambda at, m: F.struct(m.alias("mask"), key(at, m).alias("key"))))
    return positions.select("*", each.alias("k")).select("*", "k.mask", "k.key").drop("k")


def _best(same: Column) -> Column:
    """The stretch of best score (+1 equal, -2 substituted) of ``same``, which
    says place by place whether the tokens are equal: at, len, good (equal)."""
    def better(a: Column, x: Column) -> Column:
        score, k = a["score"] + F.when(x, 1).otherwise(-2), a["k"] + 1
        more, low = score - a["low"] > a["best"], score <= a["low"]
        return _ints(k=k, score=score, low=F.when(low, score).otherwise(a["low"]), low_at=F.when(low, k).otherwise(a["low_at"]),
                     best=F.when(more, score - a["low"]).otherwise(a["best"]), at=F.when(more, a["low_at"]).otherwise(a["at"]), to=F.when(more, k).otherwise(a["to"]))

    zero = F.lit(0)
    # Of n tokens with e equal the score is 3e - 2n.
    return F.aggregate(same, _ints(**dict.fromkeys(("k", "score", "low", "low_at", "best", "at", "to"), zero)), better,
                       lambda a: _ints(at=a["at"], len=a["to"] - a["at"], good=(a["best"] + 2 * (a["to"] - a["at"])) / 3))


def _longest(same: Column) -> Column:
    """The longest stretch of ``same`` that has the share: at, len, good."""
    # It has it if EQUAL of OF, so if the sum of OF - EQUAL for each equal token and -EQUAL for each other is 0 or more.
    sums = running(F.concat(same, F.array(F.lit(False))), "int", lambda pos, x: pos, lambda x: F.when(x, OF - EQUAL).otherwise(-EQUAL))
    # From the least sum on, the first place so far is where the longest stretch to this place begins.
    order = F.array_sort(F.transform(sums, lambda p, k: F.struct(p.alias("p"), k.alias("k"))))

    def longer(a: Column, x: Column) -> Column:
        first = x["k"] < a["first"]
        n = x["k"] - a["first"]
        more = n > a["len"]
        return _ints(first=F.when(first, x["k"]).otherwise(a["first"]), p=F.when(first, x["p"]).otherwise(a["p"]),
                     at=F.when(more, a["first"]).otherwise(a["at"]), len=F.when(more, n).otherwise(a["len"]), sum=F.when(more, x["p"] - a["p"]).otherwise(a["sum"]))

    zero = F.lit(0)
    return F.aggregate(order, _ints(first=F.size(same) + 1, p=zero, at=zero, len=zero, sum=zero), longer,
                       lambda a: _ints(at=a["at"], len=a["len"], good=(a["sum"] + EQUAL * a["len"]) / OF))


def _ints(**fields: Column) -> Column:
    return F.struct(*[c.cast("int").alias(n) for n, c in fields.items()])


def items(benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Distinct items with enough tokens: item_id, item (token hashes), and
    ``num``, which tells texts under one id apart once the table is written."""
    read = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), tokens(F.col(f"`{text}`")).alias("item"))
    distinct = read.groupBy("item").agg(F.min("item_id").alias("item_id")).where(F.size("item") >= MIN_ITEM)
    return distinct.withColumn("num", F.monotonically_increasing_id())


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, x (hash of
    the text), item_id, doc_start and n_tokens (the overlap, in tokens), n_equal."""
    known = materialize(items(benchmark), "items")
    longest = offsets(max(GAPS))[-1] + 1
    masks = [*map(offsets, GAPS), list(range(SIDE))]
    # The last mask is for both ends of short items, the spaced ones are for all others, where they fit.
    size, spans = F.size("toks"), F.array(*[F.lit(at[-1] + 1) for at in masks])
    ends = (F.col("at") == 0) | (F.col("at") == size - SIDE)
    fits = F.when(F.col("mask") < len(GAPS), (size >= longest) & (F.col("at") + F.get(spans, F.col("mask")) <= size)).otherwise((size < longest) & ends)
    test = _keyed(_positions(known.select("num", "item_id", F.col("item").alias("toks"))), masks).where(fits)
    test = materialize(test.select("key", "mask", "side", "num", F.col("at").alias("j")), "seeds")
    blocks = max(1, -(-test.count() // BLOCK))
    t = F.col(f"`{text}`")
    train = _positions(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(t).alias("x"), tokens(t).alias("toks")))
    in_block = lambda df, b: df.where(F.pmod(F.xxhash64("num"), F.lit(blocks)) == b)
    all_found = reduce(DataFrame.union, [_verified(train, in_block(test, b), in_block(known, b), masks) for b in range(blocks)])
    best = F.max_by(F.struct("doc_start", "n_tokens", "n_equal"), F.struct("n_equal", -F.col("doc_start")))
    return all_found.groupBy("doc_id", "x", "item_id").agg(best.alias("b")).select("doc_id", "x", "item_id", "b.*")


def _verified(train: DataFrame, test: DataFrame, known: DataFrame, masks: list[list[int]]) -> DataFrame:
    # First the half of a mask: a position whose first tokens begin no seed has no hit.
    begins = test.select("side").distinct()
    begun = train.join(F.broadcast(begins), "side", "left_semi")
    hits = _keyed(begun, masks).join(F.broadcast(test.select("key", "mask", "num", "j")), ["key", "mask"]).withColumnRenamed("at", "i")
    hits = hits.join(F.broadcast(known.select("num", "item_id", "item")), "num")
    doc, item, i, j = F.col("toks"), F.col("item"), F.col("i"), F.col("j")
    # Of the hits of one spaced mask along an overlap only the first is compared.
    follows = F.lit(False)
    for m, at in enumerate(masks[:len(GAPS)]):
        same = reduce(lambda a, b: a & b, [F.get(doc, F.greatest(i - 1 + o, F.lit(0))) == F.get(item, F.greatest(j - 1 + o, F.lit(0))) for o in at])
        follows = F.when(F.col("mask") == m, (i > 0) & (j > 0) & F.coalesce(same, F.lit(False))).otherwise(follows)
    hits = hits.where(~follows)
    # All places of both in step, from the first token of either to the end of either.
    back = F.least(i, j)
    length = F.least(F.size(doc) - i, F.size(item) - j) + back
    same = F.zip_with(F.slice(doc, i - back + 1, length), F.slice(item, j - back + 1, length), lambda x, y: x == y)
    hits = hits.select("doc_id", "x", "item_id", (i - back).alias("start"), F.least(F.lit(MIN_TOKENS), F.size("item")).alias("least"), same.alias("same"))
    enough = lambda s: (s["len"] >= F.col("least")) & (OF * s["good"] >= EQUAL * s["len"])
    hits = hits.withColumn("best", _best(F.col("same")))
    hits = hits.withColumn("told", F.when(enough(F.col("best")), F.col("best")).otherwise(_longest(F.col("same")))).where(enough(F.col("told")))
    return hits.select("doc_id", "x", "item_id", (F.col("start") + F.col("told.at")).alias("doc_start"), F.col("told.len").alias("n_tokens"), F.col("told.good").alias("n_equal"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that overlap; documents
    without an overlap have no row."""
    return overlaps(docs, benchmark).drop("x").select(
        "doc_id", "item_id", *[F.col(c).cast("long").alias(c) for c in ("doc_start", "n_tokens", "n_equal")])


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents without any overlap, in the columns of ``docs``."""
    found = overlaps(docs, benchmark, text, doc_id).select(F.col("doc_id").alias("_d"), F.col("x").alias("_x")).distinct()
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("d"), F.xxhash64(F.col(f"`{text}`")).alias("x"))
    left = marked.join(found, F.col("d").eqNullSafe(F.col("_d")) & (F.col("x") == F.col("_x")), "left_anti")
    return left.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
