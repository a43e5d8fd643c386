"""The registered queries of this folder and their oracle SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from assaykit.llm import bpe, conversation_trie, conversation_trie_sql, decontam, filter_audit, filter_audit_sql, html_extract, line_dedup, line_dedup_sql, passage_quality, pii, quality, quality_sql, secret_scan, sharding, simhash, tokenizers, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_decontam": lambda s, d: decontam.report(_docs(s, d), s.read.parquet(f"{d}/benchmark.parquet")),
        "op2_simhash": lambda s, d: simhash.report(_docs(s, d)),
        "op3_secret_scan": lambda s, d: secret_scan.report(_docs(s, d)),
        "op4_bpe": lambda s, d: bpe.report(_docs(s, d), tokenizers.path()),
        "op5_line_dedup": lambda s, d: line_dedup.report(_docs(s, d)),
        "op6_quality_rules": lambda s, d: quality.report(_docs(s, d)),
        "op7_sharding": lambda s, d: sharding.report(_docs(s, d)),
        "op8_html_extract": lambda s, d: html_extract.report(s.read.parquet(f"{d}/pages.parquet")),
        "op9_pii": lambda s, d: pii.report(_docs(s, d)),
        "op10_toxicity": lambda s, d: toxicity.report(_docs(s, d), s.read.parquet(f"{d}/labels.parquet")),
        "op11_filter_audit": lambda s, d: filter_audit.report(_docs(s, d), s.read.parquet(f"{d}/labels.parquet")),
        "op12_prefix_trie": lambda s, d: conversation_trie.report(s.read.parquet(f"{d}/conversations.parquet")),
        "op13_passage_quality": lambda s, d: passage_quality.report(_docs(s, d), s.read.parquet(f"{d}/labels.parquet")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": line_dedup_sql.sql(), "op6_quality_rules": quality_sql.sql(), "op11_filter_audit": filter_audit_sql.sql(),
            "op12_prefix_trie": conversation_trie_sql.sql()}
