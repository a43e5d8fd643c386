"""Multiple-instance learning: features and scores by plain Python, gradients by
differences, held-out accuracy, and the odd rows."""
import math
import re
import zlib

import numpy as np

from assaykit.llm import passage_quality as q
from tests.llm.helpers import odd_docs

SF = "/root/testdata/sf0.1"
TEXTS = ["", " \n ", "One", "The The The x", "é🎉 ñandú 12 ab#\n\nCd| $$", "w" * 600 + " tail", "\n lead " + "many words go by " * 50 + "end\n", "a b c " * 64]


def plain(text):
    """The first SHAPE features of every passage, byte by byte."""
    data = text.encode()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    groups = [found[k:k + q.PASSAGE] for k in range(0, len(found), q.PASSAGE)] or [[]]
    cuts = [0] + [g[0][0] for g in groups[1:]] + [len(data)]
    out = []
    for g, a, b in zip(groups, cuts, cuts[1:]):
        counts = [sum(q.CLASS_OF[x] == k for x in data[a:b]) for k in range(9)]
        row = [math.sqrt(c / max(1, b - a)) for c in counts]
        w = [data[s:e] for s, e in g]
        n = max(1, len(w))
        mean = sum(map(len, w)) / n
        row += [math.log1p(len(w)), mean / 10, math.sqrt(max(0, sum(len(x) ** 2 for x in w) / n - mean ** 2)) / 10, math.log1p(max(map(len, w), default=0)), len(set(w)) / n,
                max((w.count(x) for x in w), default=0) / n, sum(x == y for x, y in zip(w, w[1:])) / n, sum(q.CLASS_OF[x[0]] == q.UPPER for x in w) / n,
                sum(q.CLASS_OF[x[0]] == q.SYMBOL or q.CLASS_OF[x[-1]] == q.SYMBOL for x in w) / n, sum(len(x) <= 2 for x in w) / n]
        out.append(row)
    return np.array(out)


def test_features(monkeypatch):
    for batch in (1 << 20, 20):
        monkeypatch.setattr(q, "BATCH", batch)
        got = list(q.bags(TEXTS))
        n = np.concatenate([g[1] for g in got])
        x = np.split(np.concatenate([g[0] for g in got]), np.cumsum(n)[:-1])
        for text, own in zip(TEXTS, x):
            np.testing.assert_allclose(own[:, :q.SHAPE], plain(text), rtol=1e-4, atol=1e-5)
            alone = list(q.bags([text]))[0][0]
            np.testing.assert_allclose(own, alone, rtol=1e-5, atol=1e-6)
    assert np.abs(x[2][:, q.SHAPE:]).sum() == 1 and not np.array_equal(x[2], x[3])


def test_segments(monkeypatch):
    """A text of several segments is one bag, with all its words."""
    monkeypatch.setattr(q, "SEGMENT", 50)
    (x, n), = q.bags(["short", "ab " * 100, "é" * 60])
    assert n.tolist() == [1, 6, 2] and len(x) == 9
    assert round(float(np.expm1(x[1:7, 9]).sum())) in (100, 101, 102, 103, 104, 105, 106)


def test_gradient():
    rng = np.random.default_rng(1)
    m = q.Weights.start(5)
    m = m.filled(m.flat() + rng.normal(0, 0.3, m.flat().size))
    n = np.array([1, 3, 2, 4])
    x, y, w = rng.normal(0, 1, (10, 5)), np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 0.5, 1])
    got, flat = q.gradient(m, x, n, y, w), m.flat()
    for k in rng.choice(flat.size, 60, replace=False):
        d = np.zeros_like(flat)
        d[k] = 1e-5
        want = (q.loss(m.filled(flat + d), x, n, y, w) - q.loss(m.filled(flat - d), x, n, y, w)) / 2e-5
        assert abs(got[k] - want) < 1e-6


def test_forward_by_hand():
    rng = np.random.default_rng(2)
    m = q.Weights.start(4)
    n = np.array([2, 1, 3])
    x = rng.normal(0, 1, (6, 4))
    f, at = q.forward(m, x, n), 0
    for i, k in enumerate(n):
        hs, es = [], []
        for row in x[at:at + k]:
            h = [max(0.0, sum(a * b for a, b in zip(row, m.W[:, j])) + m.b[j]) for j in range(q.HIDDEN)]
            t = [math.tanh(sum(a * b for a, b in zip(h, m.V[:, j]))) for j in range(q.ATTENTION)]
            s = [1 / (1 + math.exp(-sum(a * b for a, b in zip(h, m.U[:, j])))) for j in range(q.ATTENTION)]
            hs.append(h)
            es.append(math.exp(sum(a * b * c for a, b, c in zip(t, s, m.w))))
        a = [e / sum(es) for e in es]
        z = sum(a_k * sum(v * c for v, c in zip(h, m.c)) for a_k, h in zip(a, hs)) + m.c0[0]
        assert abs(f["p"][i] - 1 / (1 + math.exp(-z))) < 1e-9 and np.allclose(f["a"][at:at + k], a)
        at += k


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    own = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = q.report(own, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out]
    rank, n = held.score.rank(), held.quality.sum()
    auc = (rank[held.quality == 1].sum() - n * (n + 1) / 2) / (n * (len(held) - n))
    good = held[held.quality == 1]
    print("auc", auc, "accuracy", (held.predicted == held.quality).mean(), "good kept", good.predicted.mean(), "bad found", 1 - held[held.quality == 0].predicted.mean())
    assert auc > 0.95 and (held.predicted == held.quality).mean() > 0.95 and good.predicted.mean() > 0.98


def test_attention_finds_the_passage(spark):
    """A document is bad through one passage among many; its weight stands out."""
    rng = np.random.default_rng(5)
    clean = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho", "tau"], q.PASSAGE)) for _ in range(400)]
    junk = " ".join(["### $$$"] * (q.PASSAGE // 2))
    rows = [(i, " ".join(clean[i:i + 4] + ([junk] if i % 2 else []) + clean[i + 4:i + 7]), 1 - i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = q.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    f = next(model.attend([rows[1][1], rows[2][1]]))
    assert f["p"][0] < 0.1 and f["p"][1] > 0.9
    assert f["a"][:8].argmax() == 4 and f["a"][4] > 0.3


def test_odd_rows_and_single_class(spark):
    df = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in q.report(df, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, None), (2, 1), (4, 1), (None, 0)], "doc_id long, quality int")
    got = q.report(df, one).collect()
    assert len(got) == df.count() and len({r.score for r in got}) == 1 and got[0].score > 0.5
    assert all(r.held_out for r in got if r.doc_id is None)
    assert q.report(df.limit(0), one).count() == 0
    two = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (4, 1), (5, 0), (6, 1)], "doc_id long, quality int")
    model = q.fit(df, two)
    out = q.score(df, model, to="kept")
    assert out.count() == df.count() and set(out.columns) == set(df.columns)
    scores = {}
    for r in q.report(df, two).collect():
        assert scores.setdefault(r.doc_id, r.score) == r.score or r.doc_id is None
    assert all(0 <= v <= 1 for v in scores.values()) and scores[1] == scores[2]
