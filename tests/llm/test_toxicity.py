"""Toxicity by held-out accuracy."""
import zlib

import numpy as np

from assaykit.llm import toxicity
from tests.llm.helpers import odd_docs

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    own = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.report(own, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    held = got[got.held_out]
    rank, n = held.score.rank(), held.toxic.sum()
    auc = (rank[held.toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(held) - n))
    assert auc > 0.95 and (held.predicted == held.toxic).mean() > 0.95


def test_buckets_are_those_of_the_characters():
    assert len(toxicity.buckets_of("ab")) == 0 and len(toxicity.buckets_of("abc")) == 1 and len(toxicity.buckets_of("é🎉cd")) == 3
    assert (toxicity.buckets_of("ABCDE") == toxicity.buckets_of("abcde")).all()
    one, two = toxicity.buckets_of("xabcx"), toxicity.buckets_of("yabcz")
    assert one[1] == two[1] and one[0] != two[0]
    assert toxicity.buckets_of("long " * 1000).max() < toxicity.BUCKETS


def test_without_two_classes(spark):
    df = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.report(df, none).collect()} <= {0.0, float(1 / (1 + np.exp(700.0)))}
    one = spark.createDataFrame([(1, 1), (1, None), (2, 1), (4, 1), (None, 1), (777, 0)], "doc_id long, toxic int").where("doc_id <> 777 or doc_id is null")
    got = toxicity.report(df, one).collect()
    assert len(got) == df.count() and len({r.score for r in got}) == 1 and 0.5 < got[0].score < 1
    assert all(r.held_out for r in got if r.doc_id is None)
    assert toxicity.report(df.limit(0), one).count() == 0


def test_ratios_against_a_recount(spark):
    """Counts, ratios and errors bucket by bucket, and all that reach the least error are features."""
    texts = [("you are vile scum", 1)] * 240 + [("a calm day by the sea", 0)] * 260 + [("vile weather by the sea", 0)] * 3 + [("", 1), ("ab", 0)]
    rows = [(sorted({int(b) for b in toxicity.buckets_of(t)}), y) for t, y in texts]
    r, z = toxicity.ratios(spark.createDataFrame(rows, "found array<int>, y int").repartition(3))
    n1, n0 = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    for b in sorted({b for f, _ in rows for b in f}) + [next(k for k in range(toxicity.BUCKETS) if not any(k in f for f, _ in rows))]:
        a1, a0 = 1 + sum(b in f for f, y in rows if y), 1 + sum(b in f for f, y in rows if not y)
        want = np.log(a1 / (n1 + 2)) - np.log(a0 / (n0 + 2))
        error = np.sqrt(max(1 / a1 - 1 / (n1 + 2), 0) + max(1 / a0 - 1 / (n0 + 2), 0))
        assert abs(r[b] - want) < 1e-12 and abs(z[b] - abs(want) / max(error, 1e-9)) < 1e-9
    docs = spark.createDataFrame([(i + 1, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i + 1, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    known = [(sorted({int(b) for b in toxicity.buckets_of(t)}), y) for i, (t, y) in enumerate(texts) if zlib.crc32(str(i + 1).encode()) % 5]
    _, z = toxicity.ratios(spark.createDataFrame(known, "found array<int>, y int"))
    model = toxicity.fit(docs, labels)
    assert set(np.flatnonzero(model.weights)) <= set(np.flatnonzero(z >= toxicity.LEAST_Z)) and (z >= toxicity.LEAST_Z).sum() > 20
    assert model.score("vile scum") > 0.9 > 0.1 > model.score("by the sea")


def test_clashing_names_come_through(spark):
    df = odd_docs(spark).withColumnRenamed("x", "score_").withColumnRenamed("w", "y")
    model = toxicity.Model(np.zeros(toxicity.BUCKETS), 0.0)
    out = toxicity.score(df, model)
    assert out.columns == [*df.columns, "score"] and {r.score for r in out.collect()} == {0.5} and out.count() == df.count()
