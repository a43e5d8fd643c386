"""Quality by attention-based multiple-instance learning: a document is a bag
of passages, of which only the whole has a label.

Every passage is encoded (counts of its characters and words, then a learned
layer); gated attention, softmax over the passages of w . (tanh(V h) * sigm(U h)),
weighs the encodings; the weighted sum is scored by a logistic unit. All
weights are learned together from the labels of documents.

A passage is ``PASSAGE`` words (runs of bytes other than the six ASCII white
space characters) with the space after them; texts are also cut every
``SEGMENT`` characters, so that memory is bounded by segments and by the
features of one document, a fortieth of its text.

Training rows: labelled documents with crc32(doc_id as text) mod 5 other than
0, at most about ``MOST_TRAINING`` of each class, drawn by hash and weighted
back to their share. Their passages are encoded by Spark tasks and dealt to
``SHARDS`` groups; in each of ``ROUNDS`` rounds every group takes Adam steps
from the common weights in a task of its own, and the weights are averaged
(some thousand numbers; no training row passes the driver). Rows, order and
seeds are fixed, so a fit is repeatable; a lost task is run again.

Defined cases: a null or blank text is one passage without words; a null doc_id
is held out; of a document's repeated labels the largest holds, null labels
none; without labels, or with one class only, every score is the smoothed share
of good rows, (good + 1) / (rows + 2) of the training rows, or 1/2 if there are
none; repeated rows score alike; an empty table gives an empty result; other
columns come through ``score`` unchanged. Label, language, source and id are no
input of a score.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import whole
from assaykit.session import materialize

PASSAGE, SEGMENT, BATCH = 64, 1 << 19, 1 << 20
MOST_TRAINING, FOLDS = 4_000, 5
SHARDS, ROUNDS, EPOCHS, STEP, RIDGE, DOCS_A_STEP = 8, 6, 4, 0.01, 1e-4, 64
HIDDEN, ATTENTION, WORD_BUCKETS = 24, 12, 48

#: Byte classes; HIGH are the bytes of non-ASCII characters.
LOWER, UPPER, DIGIT, BLANK, NEWLINE, SYMBOL, POINT, HIGH, CONTROL = range(9)
SHAPE = 9 + 10
N_FEATURES = SHAPE + WORD_BUCKETS


def _class_table() -> np.ndarray:
    table = np.full(256, CONTROL, np.uint8)
    for cls, chars in ((LOWER, b"abcdefghijklmnopqrstuvwxyz"), (UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (DIGIT, b"0123456789"), (BLANK, b" \t\v\f\r"),
                       (NEWLINE, b"\n"), (POINT, b".,;:!?'\"()-_/[]{}=+@\\^`~"), (SYMBOL, b"#*$%&|<>")):
        table[list(chars)] = cls
    table[128:] = HIGH
    return table


CLASS_OF = _class_table()


def segments(text: str) -> list[bytes]:
    """The UTF-8 bytes of a text, cut every SEGMENT characters; at least one."""
    return [text[k:k + SEGMENT].encode("utf-8", "replace") for k in range(0, max(len(text), 1), SEGMENT)]


def encode(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all passages of some segments, in order, and how many
    passages each segment has (one if it has no word)."""
    # A newline after each segment parts its words from the next; it is not counted.
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    sizes = np.array([len(p) + 1 for p in parts])
    ends = np.cumsum(sizes)
    cls = CLASS_OF[data]
    solid = (cls != BLANK) & (cls != NEWLINE)
    starts = np.flatnonzero(solid & ~np.r_[False, solid[:-1]])
    stops = np.flatnonzero(solid & ~np.r_[solid[1:], False]) + 1
    segment_of_word = np.searchsorted(ends, starts, "right")
    n_words = np.bincount(segment_of_word, minlength=len(parts))
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    first = np.cumsum(n_passages) - n_passages
    word_in_segment = np.arange(len(starts)) - (np.cumsum(n_words) - n_words)[segment_of_word]
    passage = first[segment_of_word] + word_in_segment // PASSAGE
    n = int(n_passages.sum())
    # Every byte belongs to the passage of the last word begun in its segment, or else to the segment's first one.
    begun = np.zeros(len(data), np.int64)
    begun[starts] = 1
    word = np.cumsum(begun) - 1 - np.repeat(np.cumsum(n_words) - n_words, sizes)
    at = np.repeat(first, sizes) + np.maximum(word, 0) // PASSAGE
    keep = np.ones(len(data), bool)
    keep[ends - 1] = False
    counts = np.bincount(at[keep] * 9 + cls[keep], minlength=n * 9).reshape(n, 9).astype(np.float32)

    out = np.zeros((n, N_FEATURES), np.float32)
    total = np.maximum(counts.sum(1), 1)
    out[:, :9] = np.sqrt(counts / total[:, None])
    if len(starts):
        words = np.bincount(passage, minlength=n).astype(np.float32)
        some = np.maximum(words, 1)
        length = (stops - starts).astype(np.float64)
        place = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
        value = (data.astype(np.uint64) + np.uint64(1)) * POWERS[place % len(POWERS)] * solid
        h = np.add.reduceat(value, starts)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        mean = np.bincount(passage, length, n) / some
        spread = np.sqrt(np.maximum(np.bincount(passage, length ** 2, n) / some - mean ** 2, 0))
        longest = np.zeros(n)
        np.maximum.at(longest, passage, length)
        again = np.r_[False, (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])]
        keys = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        new = np.r_[True, keys[1:] != keys[:-1]]
        runs = np.diff(np.r_[np.flatnonzero(new), len(keys)])
        most = np.zeros(n)
        np.maximum.at(most, (keys[new] >> np.uint64(40)).astype(np.int64), runs)
        distinct = np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=n)
        head = cls[starts]
        tail = cls[stops - 1]

        def share(mask: np.ndarray) -> np.ndarray:
            return np.bincount(passage, mask, n) / some

        out[:, 9:SHAPE] = np.stack([
            np.log1p(words), mean / 10, spread / 10, np.log1p(longest), distinct / some, most / some,
            share(again), share(head == UPPER), share((tail == SYMBOL) | (head == SYMBOL)), share(length <= 2)], 1)
        bucket = ((h >> np.uint64(8)) % np.uint64(WORD_BUCKETS)).astype(np.int64)
        sign = 1.0 - 2.0 * ((h >> np.uint64(60)) & np.uint64(1)).astype(np.float64)
        out[:, SHAPE:] = np.bincount(passage * WORD_BUCKETS + bucket, sign, n * WORD_BUCKETS).reshape(n, WORD_BUCKETS) / np.sqrt(some)[:, None]
    return out, n_passages


def _powers(n: int = 256) -> np.ndarray:
    out = np.ones(n, np.uint64)
    for k in range(1, n):
        out[k] = np.uint64((int(out[k - 1]) * 0x100000001B3) % (1 << 64))
    return out


POWERS = _powers()


def bags(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and number of passages of each text, some texts at a time."""
    parts, owners, done, held = [], [], 0, 0

    def flush():
        x, n = encode(parts)
        return x, np.bincount(np.array(owners) - done, n, owners[-1] - done + 1).astype(np.int64)

    for i, text in enumerate(texts):
        if held and held + len(text) > BATCH:
            yield flush()
            parts, owners, done, held = [], [], i, 0
        for p in segments(text):
            parts.append(p)
            owners.append(i)
        held += len(text)
    if parts:
        yield flush()


@dataclass
class Weights:
    """The layers by name; all learned."""

    W: np.ndarray
    b: np.ndarray
    V: np.ndarray
    v: np.ndarray
    U: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    c0: np.ndarray

    NAMES = ("W", "b", "V", "v", "U", "u", "w", "c", "c0")

    @classmethod
    def start(cls, n_features: int, seed: int = 13) -> Weights:
        rng = np.random.default_rng(seed)

        def layer(a: int, b: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(a), (a, b))

        return cls(layer(n_features, HIDDEN), np.zeros(HIDDEN), layer(HIDDEN, ATTENTION), np.zeros(ATTENTION), layer(HIDDEN, ATTENTION), np.zeros(ATTENTION),
                   rng.normal(0, 1, ATTENTION) / np.sqrt(ATTENTION), rng.normal(0, 1, HIDDEN) / np.sqrt(HIDDEN), np.zeros(1))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def filled(self, flat: np.ndarray) -> Weights:
        out, at = [], 0
        for k in self.NAMES:
            old = getattr(self, k)
            out.append(flat[at:at + old.size].reshape(old.shape))
            at += old.size
        return Weights(*out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(m: Weights, x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """All layers for bags of ``n`` passages each (at least one); ``a`` are the
    attention weights, ``p`` the scores."""
    starts = np.cumsum(n) - n
    own = np.repeat(np.arange(len(n)), n)
    h = np.maximum(x @ m.W + m.b, 0)
    t, s = np.tanh(h @ m.V + m.v), _sigmoid(h @ m.U + m.u)
    e = (t * s) @ m.w
    q = np.exp(e - np.maximum.reduceat(e, starts)[own])
    a = q / np.add.reduceat(q, starts)[own]
    r = np.add.reduceat(a[:, None] * h, starts)
    return {"own": own, "starts": starts, "h": h, "t": t, "s": s, "a": a, "r": r, "p": _sigmoid(r @ m.c + m.c0[0])}


def loss(m: Weights, x: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    p = np.clip(forward(m, x, n)["p"], 1e-12, 1 - 1e-12)
    return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum() + RIDGE / 2 * (m.W ** 2).sum())


def gradient(m: Weights, x: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The gradient of :func:`loss` in the order of ``Weights.flat``."""
    f = forward(m, x, n)
    own, h, t, s, a = f["own"], f["h"], f["t"], f["s"], f["a"]
    d = weight * (f["p"] - y) / weight.sum()
    from_bag = d[own, None] * m.c[None, :]
    pull = (from_bag * h).sum(1)
    de = a * (pull - np.add.reduceat(a * pull, f["starts"])[own])
    dg = de[:, None] * m.w
    dt, ds = dg * s * (1 - t ** 2), dg * t * s * (1 - s)
    dh = (a[:, None] * from_bag + dt @ m.V.T + ds @ m.U.T) * (h > 0)
    return Weights(x.T @ dh + RIDGE * m.W, dh.sum(0), h.T @ dt, dt.sum(0), h.T @ ds, ds.sum(0), (t * s).T @ de, f["r"].T @ d, np.array([d.sum()])).flat()


def descend(m: Weights, x: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int) -> np.ndarray:
    """Flat weights after EPOCHS passes of Adam over shuffled steps."""
    rng = np.random.default_rng(seed)
    starts, flat = np.cumsum(n) - n, m.flat()
    mean, square, k = np.zeros_like(flat), np.zeros_like(flat), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(n))
        for at in range(0, len(n), DOCS_A_STEP):
            docs = order[at:at + DOCS_A_STEP]
            rows = np.concatenate([np.arange(starts[i], starts[i] + n[i]) for i in docs])
            g, k = gradient(m.filled(flat), x[rows], n[docs], y[docs], weight[docs]), k + 1
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g ** 2
            flat = flat - STEP * (mean / (1 - 0.9 ** k)) / (np.sqrt(square / (1 - 0.99 ** k)) + 1e-8)
    return flat


class Model:
    """Scores of texts. ``share`` is the score of all if nothing was learned."""

    def __init__(self, weights: Weights | None, mean: np.ndarray | None = None, scale: np.ndarray | None = None, share: float = 0.5):
        self.weights, self.mean, self.scale, self.share = weights, mean, scale, share

    def ready(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def attend(self, texts: list[str]) -> Iterator[dict[str, np.ndarray]]:
        for x, n in bags(texts):
            yield forward(self.weights, self.ready(x), n)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        return np.concatenate([f["p"] for f in self.attend(texts)]) if len(texts) else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Training rows, written: shard, key, y, w, and the features (flat) and
    number of passages. The drawn labels are at most about 2 * MOST_TRAINING
    rows, which is why they may be broadcast."""
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).where(~held_out(F.col("doc_id")))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.coalesce(*[F.when(F.col("y") == y, F.lit(min(1.0, MOST_TRAINING / n))) for y, n in sizes.items()], F.lit(0.0))
    drawn = known.withColumn("rate", rate).where(F.pmod(F.xxhash64("doc_id", F.lit("passages")), F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    drawn = materialize(drawn.select(F.col("doc_id").alias("key"), "y", F.try_divide(F.lit(1.0), F.col("rate")).alias("w")), "passage_labels")
    texts = docs.select(F.col("doc_id").alias("key"), whole(F.col("text")).alias("text")).join(F.broadcast(drawn), "key")

    @F.pandas_udf("struct<x: binary, n: int>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x, n in bags(b.tolist()):
                out += [(p.tobytes(), len(p)) for p in np.split(x, np.cumsum(n)[:-1])]
            yield pd.DataFrame(out, columns=["x", "n"])

    shard = F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(SHARDS)).cast("int")
    return materialize(texts.select(shard.alias("shard"), "key", "y", "w", features("text").alias("f")).select("shard", "key", "y", "w", "f.x", "f.n"), "passage_training")


def _unpacked(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for x in b["x"]]), b["n"].to_numpy()


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature over the training passages, summed in
    the tasks; one row a task reaches the driver."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, one, two = 0, np.zeros(N_FEATURES), np.zeros(N_FEATURES)
        for b in batches:
            x = _unpacked(b)[0].astype(np.float64) if len(b) else np.zeros((0, N_FEATURES))
            n, one, two = n + len(x), one + x.sum(0), two + (x ** 2).sum(0)
        yield pd.DataFrame({"n": [n], "one": [one.tolist()], "two": [two.tolist()]})

    got = rows.select("x", "n").mapInPandas(sums, "n long, one array<double>, two array<double>").toPandas()
    n = max(1, got["n"].sum())
    mean = np.sum([np.asarray(v) for v in got["one"]], axis=0) / n
    return mean, np.sqrt(np.maximum(np.sum([np.asarray(v) for v in got["two"]], axis=0) / n - mean ** 2, 0)) + 1e-3


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Train on the labelled rows that are not held out."""
    rows = training(docs, labels, label)
    told = {r["y"]: (r["n"], r["w"]) for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).collect()}
    if len(told) < 2:
        n = sum(x for x, _ in told.values())
        return Model(None, share=(told.get(1, (0, 0))[0] + 1) / (n + 2) if n else 0.5)
    model = Model(Weights.start(N_FEATURES), *moments(rows))
    for k in range(ROUNDS):
        now = model

        def train(b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values(["key", "y"], kind="stable")
            x, n = _unpacked(b)
            flat = descend(now.weights, now.ready(x).astype(np.float64), n, b["y"].to_numpy(float), b["w"].to_numpy(float), seed=k * SHARDS + int(b["shard"].iloc[0]))
            return pd.DataFrame({"w": [b["w"].sum()], "flat": [flat.tolist()]})

        got = rows.groupBy("shard").applyInPandas(train, "w double, flat array<double>").toPandas().sort_values("w", kind="stable")
        flat = np.average(np.stack([np.asarray(f) for f in got["flat"]]), axis=0, weights=got["w"])
        model = Model(now.weights.filled(flat), now.mean, now.scale)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1."""
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()))

    return docs.withColumn(to, of(whole(F.col(f"`{text}`"))))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
