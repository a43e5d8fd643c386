"""Toxicity by a linear classifier over character n-grams whose features are
scaled by naive Bayes log-count ratios, trained on labelled text.

Features: the character n-grams (``GRAMS`` long) that occur in the lower-cased
text, hashed to ``BUCKETS`` buckets, present or not. For each bucket the ratio
r = log(share of toxic documents with it / share of the others with it) is
counted over the training rows; buckets whose ratio is at least ``LEAST_Z``
standard errors from 0 are features, with the value r where the n-gram occurs;
``pyspark.ml`` fits logistic regression on them. Scores are the probabilities.

Training rows: labelled documents with crc32(doc_id as text) mod 5 other than
0, at most about ``MOST_TRAINING`` of each class, drawn by hash and weighted
back to their share. Label, language, source and id are no input of a score.

Defined cases: a null text counts as empty, and an empty text has the score of
the intercept; a null doc_id is held out; of a document's repeated labels the
largest holds, null labels none; without labels, or with one class only, every
score is the smoothed share of toxic rows, (toxic + 1) / (rows + 2) of the
training rows, or 0 if there are none; repeated rows score alike; an empty
table gives an empty result; other columns come through ``score`` unchanged.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import whole
from assaykit.session import materialize

GRAMS, BUCKETS = (3, 4, 5), 1 << 18
MOST_TRAINING, FOLDS = 5_000, 5
LEAST_Z, RIDGE, ROUNDS = 4.0, 1e-3, 60


def buckets_of(text: str) -> np.ndarray:
    """The bucket of every n-gram occurrence, lengths one after another."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.uint64)
    out = []
    for n in GRAMS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ codes[k:len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(46)).astype(np.int32))
    return np.concatenate(out) if out else np.array([], np.int32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Training rows: text, y, w. The sampled labels are at most about
    2 * MOST_TRAINING rows, which is why they may be broadcast."""
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).where(~held_out(F.col("doc_id")))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.coalesce(*[F.when(F.col("y") == y, F.lit(min(1.0, MOST_TRAINING / n))) for y, n in counts.items()], F.lit(0.0))
    drawn = known.withColumn("rate", rate).where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    drawn = materialize(drawn.select(F.col("doc_id").alias("_id"), "y", F.try_divide(F.lit(1.0), F.col("rate")).alias("w")), "toxicity_labels")
    return docs.select(F.col("doc_id").alias("_d"), whole(F.col("text")).alias("text")).join(F.broadcast(drawn), F.col("_d") == F.col("_id")).select("text", "y", "w")


class Model:
    """Scores of a text: weights by bucket (0 for most) and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept, self.counts = weights, intercept, weights != 0

    def score(self, text: str) -> float:
        found = buckets_of(text)
        found = np.unique(found[self.counts[found]])
        z = self.intercept + float(self.weights[found].sum())
        return float(1 / (1 + np.exp(-max(-700.0, min(700.0, z)))))


def ratios(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The log-count ratio of each bucket, and how many standard errors it is
    from 0. ``rows`` has ``found`` (distinct buckets) and y; counts are summed
    in each task before they meet."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, BUCKETS + 1), np.int64)
        for b in batches:
            for found, y in zip(b["found"], b["y"]):
                sums[int(y > 0), found] += 1
                sums[int(y > 0), BUCKETS] += 1
        at = np.flatnonzero(sums.any(axis=0))
        yield pd.DataFrame({"bucket": at, "neg": sums[0, at], "pos": sums[1, at]})

    # At most BUCKETS + 1 rows, whatever the input.
    got = rows.select("found", "y").mapInPandas(count, "bucket long, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toPandas()
    neg, pos = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    neg[got["bucket"]], pos[got["bucket"]] = got["neg"], got["pos"]
    with_pos, with_neg = pos[:-1] + 1, neg[:-1] + 1
    r = np.log(with_pos / (pos[-1] + 2)) - np.log(with_neg / (neg[-1] + 2))
    error = np.sqrt(np.maximum(1 / with_pos - 1 / (pos[-1] + 2), 0) + np.maximum(1 / with_neg - 1 / (neg[-1] + 2), 0))
    return r, np.abs(r) / np.maximum(error, 1e-9)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Train on the labelled rows that are not held out."""
    @F.pandas_udf("array<int>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.unique(buckets_of(t)))

    rows = materialize(training(docs, labels, label).select(found("text").alias("found"), "y", "w"), "toxicity")
    told = {r["y"]: (r["n"], r["w"]) for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).collect()}
    if len(told) < 2:
        n = sum(x for x, _ in told.values())
        share = (told.get(1, (0, 0))[0] + 1) / (n + 2) if n else 0.0
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))) if share else -700.0)
    r, z = ratios(rows)
    picked = np.flatnonzero(z >= LEAST_Z).astype(np.int32)
    scale = r[picked]

    @F.udf(VectorUDT())
    def vector(found: list[int]):
        at = np.searchsorted(picked, np.asarray(found, np.int32))
        at = at[(at < len(picked))] if not len(picked) else at[(picked[np.minimum(at, len(picked) - 1)] == np.asarray(found, np.int32))]
        return Vectors.sparse(max(1, len(picked)), at.tolist(), scale[at].tolist())

    lr = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=RIDGE, maxIter=ROUNDS, standardization=False)
    fitted = lr.fit(materialize(rows.select(vector("found").alias("x"), F.col("y").cast("double").alias("y"), "w"), "toxicity_vectors"))
    weights = np.zeros(BUCKETS)
    weights[picked] = fitted.coefficients.toArray()[:len(picked)] * scale
    return Model(weights, float(fitted.intercept))


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*sent.value)
        for texts in batches:
            yield texts.map(own.score).astype(float)

    return docs.withColumn(to, of(whole(F.col(f"`{text}`"))))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
