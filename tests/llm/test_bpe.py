"""BPE against the tokenizers library."""
import hashlib
import random
import struct

import duckdb
import pytest
import tokenizers as library

from assaykit.llm import bpe
from assaykit.llm.tokenizers import path
from tests.llm.helpers import SF, documents, odd_docs


@pytest.fixture(scope="module")
def known():
    t = library.Tokenizer.from_file(path())
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def encoder():
    with open(path(), "rb") as f:
        return bpe.Encoder(f.read())


def texts():
    rng = random.Random(3)
    pool = "abcXYZ ÀÉßΣσςİıǅﬁéñ中文日本🎉👩‍👩‍👧   \x1c\x1f\x85​'sre've'LL'd0123½Ⅷ²_!!!--@#\t\n\r\x00́ͅ�<|endoftext|>"
    yield from ("".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(1500))
    yield from ("", " ", "hello<|endoftext|>World <|startoftext|>x", "<|ENDOFTEXT|>", "a" * 5000, "!" * 3000, "ab" * 2000 + "é" * 500, "don't CAN'T 'S", "ΑΣ ΣΑΣ.")
    yield "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    yield from (r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall())


def test_like_the_library(known, encoder):
    for t in texts():
        want = known.encode(t, add_special_tokens=False).ids
        ids = encoder.encode([t])[0]
        assert ids == struct.pack(f"<{len(want)}I", *want), t
        assert encoder.decode(ids) == known.decode(want, skip_special_tokens=False)


def test_fragments_are_cut_where_no_token_joins(encoder):
    assert encoder.joins[ord("t"), ord("h")] and 0 < encoder.joins.sum() < 256 * 256
    never = [(a, b) for a in range(97, 123) for b in range(97, 123) if not encoder.joins[a, b]]
    for a, b in never[:20]:
        one, two, both = encoder.encode([chr(a), chr(b), chr(a) + chr(b)])
        assert two == both[-len(two):]


def test_tables_may_be_emptied_at_any_time(encoder, monkeypatch):
    some = list(texts())
    want = encoder.encode(some)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "PIECE", 100)
    assert encoder.encode(some) == want


def test_query_and_round_trip(spark, known):
    df = documents(spark)
    by_id = {r.doc_id: r for r in bpe.report(df, path()).collect()}
    both = bpe.decode(bpe.encode(df, path()), path()).collect()
    for r in both:
        ids = known.encode(r.text or "", add_special_tokens=False).ids
        packed, decoded = struct.pack(f"<{len(ids)}I", *ids), known.decode(ids, skip_special_tokens=False)
        assert (bytes(r.ids), r.decoded) == (packed, decoded)
        assert tuple(by_id[r.doc_id])[1:] == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_odd_rows(spark):
    df = odd_docs(spark)
    got = bpe.report(df, path())
    assert got.count() == df.count() and got.where("doc_id in (1, 2, 3)").select("n_tokens").distinct().collect()[0][0] == 0
    assert bpe.report(df.limit(0), path()).count() == 0
    with pytest.raises(ValueError):
        bpe.Encoder(b'{"model": {"type": "Unigram"}, "normalizer": {"normalizers": []}, "pre_tokenizer": {"pretokenizers": [{"invert": false}]}, "decoder": null}')
