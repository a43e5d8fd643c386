"""SimHash near-dedup against all pairs."""
import collections
import random

import numpy as np
import pytest
import xxhash

from assaykit.llm import simhash
from assaykit.llm.components import components
from tests.llm.helpers import documents, low, odd_docs, words


def fingerprint(text):
    w = words(low(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, bits):
    """Class of each fingerprint by all pairs."""
    parent = {f: f for f in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(sorted(prints), np.uint64)
    for i in range(len(a)):
        for j in (i + 1 + np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= bits)).tolist():
            parent[top(int(a[j]))] = top(int(a[i]))
    return {f: top(f) for f in prints}


def test_documents(spark):
    base = "one two three four five six seven eight nine ten"
    df = documents(spark, [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "A b"), (10**6 + 3, "a  B\n"), (10**6 + 4, base), (10**6 + 5, base.upper()), (10**6 + 6, "é\x85É ß")]).select("doc_id", "text")
    rows = df.collect()
    by_print = collections.defaultdict(list)
    for r in rows:
        by_print[fingerprint(r.text)].append(r.doc_id)
    top = classes(by_print, 2)
    least = collections.defaultdict(list)
    for f, ids in by_print.items():
        least[top[f]] += ids
    want = {(i, f"{f:016x}", min(least[top[f]])) for f, ids in by_print.items() for i in ids}
    assert {tuple(r) for r in simhash.report(df).collect()} == want
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == {c for _, _, c in want}


@pytest.mark.parametrize("bucket,bits", [(64, 2), (3, 2), (3, 1), (8, 3), (64, 0)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, bucket, bits):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng, prints = random.Random(bucket + bits), set()
    for size in (1, 2, 5, 40, 150) * 3:
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
            centre = x if rng.random() < 0.1 else centre
    signed = {f: f - (1 << 64) if f >> 63 else f for f in prints}
    links = simhash.links(spark.createDataFrame([(f,) for f in signed.values()], "f long"), bits)
    root = {r.node: r.root for r in components(links).collect()}
    got, want = collections.defaultdict(set), collections.defaultdict(set)
    for f, c in classes(prints, bits).items():
        got[root.get(signed[f], signed[f])].add(f)
        want[c].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == {**{i: 0 for i in range(1, 201)}, 500: 400}
    assert components(links.limit(0)).count() == 0


def test_odd_rows(spark):
    df = odd_docs(spark)
    got = simhash.report(df).collect()
    assert len(got) == df.count()
    empty = [r.component_id for r in got if r.fingerprint == "0" * 16]
    assert empty == [1] * 4
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (True, 0)]
    assert simhash.report(df.limit(0)).count() == 0
