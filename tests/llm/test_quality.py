"""Quality rules against plain Python."""
import collections
import math
import re

from pyspark.sql import functions as F

from assaykit.llm import quality
from tests.llm.helpers import documents, odd_docs, words


def measured(t):
    w = words(t)
    n = len(w)
    seen = collections.Counter(tuple(w[p:p + 5]) for p in range(n - 4))
    covered = {q for p in range(n - 4) if seen[tuple(w[p:p + 5])] > 1 for q in range(p, p + 5)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_base_rules(spark):
    extra = [(10**6, "a b c d e a b c d e"), (10**6 + 1, "x " * 500), (10**6 + 2, "q\nq\n\n q\nq\x0b|é<\x1c"), (10**6 + 3, None)]
    df = documents(spark, extra)
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in quality.report(df).collect():
        n, chars, symbols, lines, repeated = measured(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated)
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n)
        assert not (r.base_failed and r.kept)


def test_distance(spark):
    df = spark.createDataFrame([([1, 2, 0], [2, 4, 0]), ([1, 0, 0], [0, 0, 5]), ([3, 1, 0], [1, 1, 2]), ([0, 0, 0], [1, 1, 1])], "a array<long>, b array<long>")
    share = lambda c: quality.shares(F.col(c), F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x))
    got = [r[0] for r in df.select(quality.distance(share("a"), share("b"))).collect()]

    def js(a, b):
        p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
        kl = lambda u, v: sum(x * math.log2(x / y) for x, y in zip(u, v) if x)
        m = [(x + y) / 2 for x, y in zip(p, q)]
        return math.sqrt((kl(p, m) + kl(q, m)) / 2)

    assert got[0] == 0 and abs(got[1] - 1) < 1e-12 and abs(got[2] - js([3, 1, 0], [1, 1, 2])) < 1e-12 and got[3] is None


def test_labels_follow(spark):
    got = quality.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("not base_failed")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    share = {(r.quality, r.kept): r.n for r in got.join(labels, "doc_id").groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert share[1, True] / (share[1, True] + share.get((1, False), 0)) > 0.99
    assert share[0, False] / (share[0, False] + share.get((0, True), 0)) > 0.8


def test_odd_rows(spark):
    df = odd_docs(spark)
    assert quality.report(df).count() == df.count()
    assert quality.keep_good(df).columns == df.columns and quality.keep_good(df).count() == 0
    assert quality.report(df.limit(0)).count() == 0
