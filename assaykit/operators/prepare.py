"""First steps of a split or model job on a labelled table of any naming."""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.labels import normalize_label_strict, require_labels
from ..sources.schema import resolve_roles
from .rows import with_partition_row_index


def drop_missing(df: DataFrame, subset: list[str], name: str = "missing") -> tuple[DataFrame, Observation]:
    """Rows without a null in ``subset``, and an observation with ``n_rows``
    and ``n_dropped``, counted in the pass that an action on the rows makes.
    ``observation.get`` waits for that action; no pass is made for the count."""
    told = Observation(name)
    whole = F.lit(True)
    for c in subset:
        whole = whole & F.col(f"`{c}`").isNotNull()
    seen = df.observe(told, F.count(F.lit(1)).alias("n_rows"), F.count_if(~whole).alias("n_dropped"))
    return seen.where(whole), told


def prepare_records(table: DataFrame, strict: bool = True) -> tuple[DataFrame, Observation]:
    """(record_id, sequence, solvent, label) of a labelled table, and the
    observation of its dropped rows.

    Columns are found by role whatever their spelling; a table without an id
    column gets its row positions as ids; rows that lack sequence, condition or
    label are dropped and counted. Labels follow the strict rule: with
    ``strict`` a label that is not understood raises
    :class:`assaykit.functions.labels.LabelError` with the first examples, after
    one aggregate over the label column; otherwise such rows have a null label."""
    roles = resolve_roles(table.columns)
    if roles["record_id"] is None:
        table = with_partition_row_index(table, "record_id")
        roles["record_id"] = "record_id"
    cols = {"record_id": roles["record_id"], "sequence": roles["sequence"], "solvent": roles["condition"], "_raw": roles["label"]}
    named = table.select(*[F.col(f"`{c}`").alias(k) for k, c in cols.items()])
    kept, told = drop_missing(named, ["sequence", "solvent", "_raw"], "prepared")
    labelled = named.dropna(subset=["sequence", "solvent", "_raw"]).withColumn("label", normalize_label_strict("_raw"))
    if strict:
        require_labels(labelled, "_raw", "label", "record_id")
    out = kept.withColumn("label", normalize_label_strict("_raw"))
    return out.select(F.col("record_id").cast("string").alias("record_id"), "sequence", "solvent", "label"), told
