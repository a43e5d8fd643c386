"""Filter interactions against every order applied in plain Python."""
from collections import Counter
from itertools import permutations

from assaykit.llm import filter_audit as a
from tests.llm.helpers import documents, odd_docs, words

FIELDS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failed(text, later):
    w = words(text)
    return {c for c, f in zip("ABCDE", [
        len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= x <= "Z" for x in text) > 5 * len(text), any(x in "#$%&*|" for x in text), later]) if f}


def brute(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = [(s or "", failed(t or "", i is not None and i > least[t or ""]), i in good, i in toxic) for i, t, s in docs]
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, c in enumerate(order):
                lost = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                shapley[part, c] += len(lost)
                out[part, order, k + 1] = [len(left), len(lost), sum(c in r[1] for r in own) - len(lost), sum(r[1] == {c} for r in own), sum(r[2] for r in lost), sum(r[3] for r in lost)]
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def rows_of(df):
    return {(r.part, r.filter_order, r.step): tuple(r[f] for f in FIELDS) for r in df.collect()}


def check(docs, labels):
    got = rows_of(a.report(docs, labels))
    want = brute([(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert got == want
    return got


def test_against_all_orders(spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = check(documents(spark), labels)
    assert any(v[2] for v in got.values()) and any(v[4] for v in got.values())


def test_odd_rows(spark):
    """Null and repeated ids, nulls, a copy whose ids tie, repeated and null labels, clashing names."""
    df = odd_docs(spark, ["Same TEXT | here"] * 3 + ["a b c " * 30])
    df = df.unionByName(df.where("doc_id = 100")).unionByName(df.where("doc_id = 102").withColumn("doc_id", df.doc_id * 0).withColumn("source", df.lang))
    labels = spark.createDataFrame([(100, 1, 0), (100, 0, 1), (101, None, None), (4, 1, 1), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = check(df, labels)
    assert {k[0] for k in got} == {"", "a", "b", "s0", "s1", "s2", "s3", "en"} and len(got) == 8 * 600


def test_empty(spark):
    df = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert a.report(df.limit(0), none).count() == 0
    assert all(v[4] == v[5] == 0 for v in check(df, none).values())


def test_recursion_enumerates_prefixes(spark):
    got = a.steps(spark, "ABC").collect()
    prefixes = {"".join(p) for n in (1, 2, 3) for p in permutations("ABC", n)}
    assert {r.prefix for r in got} == prefixes and len(got) == 8 * len(prefixes)
    for r in got:
        before = sum(1 << "ABC".index(c) for c in r.prefix[:-1])
        own = 1 << "ABC".index(r.letter)
        assert (r.applied, r.gone, r.failing) == (before | own, bool(r.mask & before), bool(r.mask & own))
