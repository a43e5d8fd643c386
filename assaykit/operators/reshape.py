"""Wide -> long: one row per labelled (row, condition) cell."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import normalize_label
from ..functions.text import slugify, stable_id
from .ingest import INDEX_COL, KEY, q

# Metadata carried onto every long row when present, in output order.
LONG_OPTIONAL = ["difficulty_prediction", "difficulty_score", "difficulty_score_num", "mw",
                 "mw_num", "quantity_delivered", "quantity_total_mg", "hplc_result",
                 "hplc_percent"]
LONG_IDS = [INDEX_COL, "sequence_id", "sequence_raw", "sequence_clean"]


def _unpivot(clean: DataFrame, conditions: list[str], keep: list[str]) -> DataFrame:
    """(keep..., solvent_name, label_raw) for every condition cell (nulls
    included). Spark plans this as one Expand over the scan."""
    base = clean.select(*[q(c) for c in keep],
                        *[q(c).cast("string").alias(f"_v{i}") for i, c in enumerate(conditions)])
    stacked = base.unpivot(keep, [f"_v{i}" for i in range(len(conditions))], "_slot", "label_raw")
    names = F.create_map(*[x for i, c in enumerate(conditions) for x in (F.lit(f"_v{i}"), F.lit(c))])
    return stacked.select(*keep, names[F.col("_slot")].alias("solvent_name"), "label_raw")


def wide_to_long(clean: DataFrame, conditions: list[str]) -> DataFrame:
    """Labelled long table (18 columns when all metadata roles exist):
    observation_id, source_row_index, sequence_id, sequence_raw,
    sequence_clean, solvent_name, solvent_id, label_raw, y, metadata...

    ``clean`` is the output of :func:`assaykit.operators.ingest.ingest_wide`,
    so its cells are already cleaned; a stored KEY comes last."""
    opt = [c for c in [*LONG_OPTIONAL, KEY] if c in clean.columns]
    cells = _unpivot(clean, conditions, LONG_IDS + opt)
    y = normalize_label("label_raw", cleaned=True)
    labelled = cells.withColumn("y", y).where(F.col("y").isNotNull())
    sid = slugify("solvent_name")
    return labelled.select(
        stable_id("obs", "sequence_id", sid, INDEX_COL).alias("observation_id"),
        INDEX_COL, "sequence_id", "sequence_raw", "sequence_clean", "solvent_name",
        sid.alias("solvent_id"), "label_raw", F.col("y").cast("int").alias("y"), *opt)


def unknown_label_values(clean: DataFrame, conditions: list[str]) -> DataFrame:
    """Non-null condition cells whose label does not parse:
    (row_index, solvent_column, raw_value)."""
    cells = _unpivot(clean, conditions, [INDEX_COL])
    return (cells.where(F.col("label_raw").isNotNull()
                        & normalize_label("label_raw", cleaned=True).isNull())
            .select(F.col(INDEX_COL).alias("row_index"), F.col("solvent_name").alias("solvent_column"),
                    F.col("label_raw").alias("raw_value")))
