"""Sharding by its law, and by hot and odd rows."""
import zlib

from assaykit.llm import sharding
from tests.llm.helpers import documents, odd_docs


def check(rows, texts, shards=16):
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None) or r.doc_id is None
    total, most = sum(r.size for r in rows), max(r.size for r in rows)
    for s in range(shards):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / shards) <= most


def test_bytes_are_near_equal(spark):
    df = documents(spark)
    check(sharding.report(df).collect(), {r.doc_id: r.text for r in df.collect()})


def test_a_text_repeated_without_end(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 500)
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(12_000)]
    base = spark.createDataFrame(rows, "doc_id long, text string")
    check(sharding.report(base).collect(), dict(rows))
    placed, sums = sharding.ranges(sharding.materialize(sharding._base(base, "text", ["doc_id"]), "test"))
    assert sums["rows"].sum() == 12_000 and sums["rows"].max() <= sharding.OVERFULL * 12_000 / sharding.LEAST_RANGES + 1
    # Equal texts stand together: shards that hold some hold nothing else, but for the ends.
    mixed = [r for r in sharding.report(base).groupBy("shard").agg({"text_crc32": "approx_count_distinct"}).collect() if r[1] > 1]
    assert len(mixed) < 16


def test_odd_rows(spark):
    df = odd_docs(spark)
    got = sharding.report(df).collect()
    assert len(got) == df.count() and {r.shard for r in got} <= set(range(16))
    out = sharding.sharded(df)
    assert out.columns == [*df.columns, "_shard", "_slot"] and out.count() == df.count()
    assert sharding.report(df.limit(0)).count() == 0
