"""One-row documents that say what a split job or a model run did."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _texts(told: dict[str, str | None]) -> Column:
    return F.struct(*[F.lit(v).cast("string").alias(k) for k, v in told.items()])


def _data_counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_records"), F.countDistinct(F.sha1(F.col("sequence"))).alias("n_unique_sequences"),
            F.countDistinct("solvent").alias("n_unique_solvents"), F.avg(F.col("label").cast("double")).alias("positive_rate")]


def split_manifest(records: DataFrame, roles: dict[str, str | None], seed: int, input_file: str, files: list[str]) -> DataFrame:
    """When, from what, with which seed and columns the splits were made, the
    counts of the records, and the files written. One aggregate."""
    return records.agg(*_data_counts()).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("created_at_utc"), F.lit(input_file).alias("input_file"),
        F.lit(seed).alias("seed"), _texts(roles).alias("detected_columns"), "n_records", "n_unique_sequences", "n_unique_solvents", "positive_rate",
        F.array(*[F.lit(f) for f in files]).cast("array<string>").alias("files"))


def run_metadata(records: DataFrame, results: DataFrame, roles: dict[str, str | None], seed: int, data: str, splits_dir: str, models: list[str],
                 split_files: list[str]) -> DataFrame:
    """What a model run read and how many results and errors it left; ``results``
    has a column ``error``, null where the model ran."""
    told = results.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return records.agg(*_data_counts()).select(
        F.lit(data).alias("data"), F.lit(splits_dir).alias("splits_dir"), F.lit(seed).alias("seed"), _texts(roles).alias("detected_columns"),
        "n_records", "n_unique_sequences", "n_unique_solvents", "positive_rate", F.array(*[F.lit(m) for m in models]).cast("array<string>").alias("models"),
        F.array(*[F.lit(f) for f in split_files]).cast("array<string>").alias("split_files"),
        told.select("ok").scalar().alias("n_result_rows"), told.select("failed").scalar().alias("n_error_rows"))
