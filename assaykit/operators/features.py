"""Model-family descriptors computed once per distinct sequence.

Records repeat sequences (one sequence tested under many conditions), so
descriptors are computed on the distinct sequences (keyed by SHA-1) and
joined back on the key; those of narrow records once per document, in the
scan of the documents, so that no text is shuffled. The per-sequence table is written to the shared
folder first: it is small, it is read by every fold of every model, and a
scan under the join keeps the optimizer's plan small (a 54-column
projection under a join makes constraint inference explode).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import BASELINE_FEATURES, baseline_count_columns, baseline_feature_columns
from ..functions.text import letters_only_sequence
from ..session import materialize

KEY = "_seq_key"


def with_sequence_key(df: DataFrame, seq_col: str = "sequence") -> DataFrame:
    return df.withColumn(KEY, F.sha1(F.coalesce(F.col(seq_col), F.lit(""))))


def baseline_feature_table(df: DataFrame, seq_col: str = "sequence", write: bool = True) -> DataFrame:
    """(_seq_key, 54 features) for the distinct sequences of ``df``. Key and
    text both group, so that no text is an aggregate's state (Spark would sort)."""
    seqs = with_sequence_key(df, seq_col).select(KEY, F.coalesce(F.col(seq_col), F.lit("")).alias("_seq")).distinct()
    x = seqs.select(KEY, letters_only_sequence("_seq").alias("_letters"))
    x = x.select(KEY, *baseline_count_columns("_letters"))
    x = x.select(KEY, *baseline_feature_columns())
    return materialize(x, "baseline_features") if write else x


def with_baseline_features(df: DataFrame, seq_col: str = "sequence") -> DataFrame:
    """``df`` plus the 54 model features of its sequence column."""
    table = baseline_feature_table(df, seq_col)
    return with_sequence_key(df, seq_col).join(table, KEY, "left").drop(KEY)


def text_features(texts: DataFrame, id_col: str) -> DataFrame:
    """(``id_col``, 54 features) for each row of ``texts`` (``id_col``, sequence); a null sequence is the empty one."""
    x = texts.select(id_col, letters_only_sequence("sequence").alias("_letters"))
    return x.select(id_col, *baseline_count_columns("_letters")).select(id_col, *baseline_feature_columns())


def with_features_of_texts(df: DataFrame, texts: DataFrame, refs: DataFrame, id_col: str) -> DataFrame:
    """Narrow rows ``df`` plus the 54 features of the sequence that ``id_col``
    refers to, one without a text having those of the empty sequence. ``texts``
    (``id_col``, sequence) are described where ``refs``, a written table of the
    references in use, has them. Rows come out sorted by ``id_col`` in each
    partition: equal features stand together, and a table of them is small."""
    spark = df.sparkSession
    table = materialize(text_features(texts.join(refs, id_col, "left_semi"), id_col), "baseline_features")
    empty = text_features(spark.range(1).select(F.lit(0).alias(id_col), F.lit("").alias("sequence")), id_col).first()
    found = df.join(table.withColumn("_found", F.lit(True)).hint("merge"), id_col, "left")
    filled = [F.when(F.col("_found"), F.col(c)).otherwise(F.lit(empty[c]).cast(table.schema[c].dataType)).alias(c) for c in BASELINE_FEATURES]
    return found.select(*[c for c in df.columns if c != id_col], *filled)


__all__ = ["baseline_feature_table", "text_features", "with_baseline_features", "with_features_of_texts", "BASELINE_FEATURES"]
