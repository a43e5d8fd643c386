"""Decontamination against all alignments of documents and items."""
import random
import re

from assaykit.llm import decontam
from tests.llm.helpers import documents, odd_docs


def toks(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shares_run(doc, item, n):
    runs = {tuple(item[i:i + n]) for i in range(len(item) - n + 1)}
    return any(tuple(doc[i:i + n]) in runs for i in range(len(doc) - n + 1))


def test_planted_passages(spark):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    items = {r.item_id: r.text for r in bench.collect()}
    rng, extra = random.Random(1), []
    for k in range(40):
        item = rng.choice(sorted(items))
        w = items[item].split()
        for at in rng.sample(range(len(w)), len(w) // 12):
            w[at] = "substitute"
        extra.append((10**6 + k, "Words before it, " + " ".join(w) + " and behind."))
    extra += [(10**6 + 50, "alpha BETA-gamma: delta, epsilon!"), (10**6 + 51, "alpha beta gamma delta zeta"), (10**6 + 52, None)]
    df = documents(spark, extra)
    bench = bench.union(spark.createDataFrame([(5000, "Alpha, beta gamma delta epsilon"), (5001, "a b"), (5002, None), (None, "")], "item_id long, text string"))
    found = decontam.report(df, bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    # An item of five tokens is found with one of them substituted (4 of 5).
    assert {d for d, _ in got if d >= 10**6} == {10**6 + k for k in range(40)} | {10**6 + 50, 10**6 + 51}
    texts = {r.doc_id: toks(r.text) for r in df.collect()}
    # All that share 13 tokens in a row are found; all that are found share 4 in a row.
    sure = {(d, i) for d, t in texts.items() for i, x in items.items() if shares_run(t, toks(x), 13)}
    assert sure <= got
    assert all(shares_run(texts[d], toks(items.get(i, "Alpha, beta gamma delta epsilon")), 4) for d, i in got)
    for r in found:
        assert 5 * r.n_equal >= 4 * r.n_tokens and 0 <= r.doc_start and r.doc_start + r.n_tokens <= len(texts[r.doc_id])
    left = {r.doc_id for r in decontam.clean(df, bench).collect()}
    assert left == set(texts) - {d for d, _ in got}


def test_blocks_give_the_same(spark, monkeypatch):
    df, bench = documents(spark), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(tuple, decontam.report(df, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK", 500)
    assert sorted(map(tuple, decontam.report(df, bench).collect())) == whole and whole


def test_odd_rows(spark):
    passage = "This very passage of the benchmark has sixteen words, which is more than enough to be found."
    df = odd_docs(spark, ["see: " + passage, passage.upper(), "clean"])
    bench = spark.createDataFrame([(1, passage, 3), (2, passage, 4), (3, None, 5)], "item_id long, text string, doc_id int")
    assert sorted((r.doc_id, r.item_id) for r in decontam.report(df, bench).collect()) == [(100, 1), (101, 1)]
    left = decontam.clean(df, bench)
    assert left.columns == df.columns and left.count() == df.count() - 2
    assert decontam.report(df.limit(0), bench).count() == 0 and decontam.report(df, bench.limit(0)).count() == 0


def good_stretch(doc, item, shift):
    """Whether 12 tokens in step, 10 or more of them equal, lie on a diagonal."""
    same = [0 <= j + shift < len(doc) and doc[j + shift] == x for j, x in enumerate(item)]
    return any(sum(same[j:j + 12]) >= 10 and 0 <= j + shift and j + 12 + shift <= len(doc) for j in range(len(item) - 11))


def seeded(doc, item, shift):
    at = [j for j, x in enumerate(item) if 0 <= j + shift < len(doc) and doc[j + shift] == x]
    return any({j + o for o in decontam.offsets(g)} <= set(at) for g in decontam.GAPS for j in at)


def test_substitutions_against_all_stretches(spark):
    rng, items, docs, want, some = random.Random(5), [], [], set(), 0
    for k in range(240):
        n, rate = (20, 40, 60)[k % 3], (0.15, 0.2, 0.25, 0.3)[k % 4]
        item = [f"i{k}w{m}" for m in range(n)]
        doc = [f"d{k}w{m}" for m in range(9)] + [f"s{k}w{m}" if rng.random() < rate else x for m, x in enumerate(item)] + [f"e{k}w{m}" for m in range(9)]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(doc)))
        some += good_stretch(doc, item, 9)
        if good_stretch(doc, item, 9) and seeded(doc, item, 9):
            want.add((k, k))
    found = decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r.n_tokens >= 12 and 5 * r.n_equal >= 4 * r.n_tokens for r in found)
    texts, known = dict(docs), dict(items)
    for r in found:
        assert sum(x == y for x, y in zip(texts[r.doc_id].split()[r.doc_start:][:r.n_tokens], known[r.item_id].split()[r.doc_start - 9:])) == r.n_equal
    got = {(r.doc_id, r.item_id) for r in found}
    assert want <= got and len(want) > 0.95 * some
    # The longer stretches of 4 of 5 hold 12 tokens with 4 of 5 equal, or 13 to 23.
    assert all(any(5 * sum(s[a:a + n]) >= 4 * n for n in range(12, 24) for a in range(len(s) - n + 1))
               for k, _ in got for s in [[x == y for x, y in zip(texts[k].split()[9:], known[k].split())]])


def test_long_items_are_compared_whole(spark):
    item = [f"w{k}" for k in range(300)]
    spoilt = [f"s{k}" if k % 9 == 4 else w for k, w in enumerate(item)]
    docs = [(1, ["own", *item, "own"]), (2, spoilt), (3, item[100:200] + ["own"])]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in docs], "doc_id long, text string")
    found = decontam.report(df, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(1, 7, 1, 300, 300), (2, 7, 0, 300, 267), (3, 7, 0, 100, 100)]


def test_texts_under_one_id_and_without_id(spark):
    """Each text is compared with its own hits; a passage of the back of the longer one crashed."""
    long, short = [f"l{k}" for k in range(40)], [f"s{k}" for k in range(14)]
    docs = spark.createDataFrame([(1, " ".join(["x", *long[24:], "y"])), (2, " ".join(short)), (3, " ".join(long[:20] + short)), (4, "clean text")], "doc_id long, text string")
    for own in (7, None):
        bench = spark.createDataFrame([(own, " ".join(long)), (own, " ".join(short))], "item_id long, text string")
        got = sorted(map(tuple, decontam.report(docs, bench).collect()))
        assert got == [(1, own, 1, 16, 16), (2, own, 0, 14, 14), (3, own, 0, 20, 20)]
        assert [r.doc_id for r in decontam.clean(docs, bench).collect()] == [4]


def test_short_items(spark):
    """Items of 3 to 9 tokens against all places, with one substitution from five tokens on."""
    rows, items = [], []
    for n in range(1, 10):
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for at in (None, *range(n)):
            rows.append((100 * n + (99 if at is None else at), " ".join(["before", *[w if k != at else "other" for k, w in enumerate(item)], "after"])))
    got = {(r.doc_id, r.item_id, r.n_tokens, r.n_equal) for r in decontam.report(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(100 * n + 99, n, n, n) for n in range(3, 10)} | {(100 * n + at, n, n, n - 1) for n in range(5, 10) for at in range(n) if (n, at) != (5, 2)}
    assert got == want
