"""The corpus pipeline: five stages over ``documents``, each written as
Parquet and read again by the next.

Every stage works on all that the one before kept. Stages that filter keep
rows unchanged; line dedup rewrites texts and keeps every row. All but the last
return the columns of documents; the last returns one row per document with
its token count and digests. Null or empty texts and ids, repeated rows and
empty tables pass through as each operator says.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaykit.llm import bpe, decontam, line_dedup, quality, simhash
from assaykit.llm.tokenizers import path as tokenizer_path
from assaykit.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later copies of repeated runs of lines deleted."""
    return line_dedup.rewrite(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each SimHash component."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the token ids and of the decoded text."""
    return bpe.report(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("bpe", encode),
]

#: SimHash votes, seeds and BPE merges cannot be said in SQL; the stages are
#: tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``, each written to the shared
    folder, so a lost executor costs no more than the stage at hand."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
