"""The pipeline's stages against brute-force versions of each, on its own input."""
import hashlib
import struct

import tokenizers as library

import corpus_pipeline
from assaykit.llm import line_dedup, quality
from assaykit.llm.tokenizers import path
from assaykit.session import materialize
from tests.llm.helpers import SF, odd_docs
from tests.llm.test_decontam import shares_run, toks
from tests.llm.test_line_dedup import brute
from tests.llm.test_simhash import classes, fingerprint


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen, inputs = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = {r.doc_id: r for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF), f"test_{name}")
        assert docs.columns == names or name == "bpe"
        seen[name] = {r.doc_id: r for r in docs.collect()}

    kept = {r.doc_id for r in quality.report(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()}
    assert set(seen["quality_rules"]) == kept and all(inputs["quality_rules"][k] == r for k, r in seen["quality_rules"].items())

    before = inputs["line_dedup"]
    want = brute(sorted((k, r.text) for k, r in before.items()), line_dedup.MIN_RUN_WORDS)
    assert {(k, before[k].text): r.text for k, r in seen["line_dedup"].items()} == want
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"].values())

    before = inputs["simhash_near_dedup"]
    prints = {k: fingerprint(r.text) for k, r in before.items()}
    top = classes(set(prints.values()), 2)
    least = {}
    for k in sorted(before):
        least.setdefault(top[prints[k]], k)
    assert set(seen["simhash_near_dedup"]) == set(least.values())

    items = [toks(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = inputs["benchmark_decontamination"]
    dirty = {k for k, r in before.items() if any(shares_run(toks(r.text), i, 13) for i in items)}
    touched = {k for k, r in before.items() if any(shares_run(toks(r.text), i, 4) for i in items)}
    gone = set(before) - set(seen["benchmark_decontamination"])
    assert dirty <= gone <= touched and dirty

    known = library.Tokenizer.from_file(path())
    for k, r in inputs["bpe"].items():
        ids = known.encode(r.text, add_special_tokens=False).ids
        assert seen["bpe"][k].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert set(seen["bpe"]) == set(inputs["bpe"])
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in seen["bpe"].values()}


def test_odd_rows(spark):
    df = odd_docs(spark, ["word " * 5 + f"{i} more words than ten are here now " for i in range(3)])
    for empty in (False, True):
        docs = df.limit(0) if empty else df
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() == (0 if empty else 3)
