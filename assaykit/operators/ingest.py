"""Wide-table ingest: one lazy ``select`` from raw strings to typed columns,
plus the single aggregate that detects the condition columns."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import CONDITION_HINTS, META_COLUMNS
from ..functions.labels import normalize_label
from ..functions.mojibake import repair_column
from ..functions.text import (clean_cell, lower_trim, normalize_sequence, parse_number,
                              parse_quantity_mg, stable_id, weird_count)
from ..sources.schema import dedupe_headers, normalize_header

# Typed columns derived from metadata roles, in output order.
DERIVED_NUMERIC = [("difficulty_score", "difficulty_score_num", parse_number),
                   ("mw", "mw_num", parse_number),
                   ("quantity_delivered", "quantity_total_mg", parse_quantity_mg),
                   ("hplc_result", "hplc_percent", parse_number)]

INDEX_COL = "source_row_index"
#: SHA-1 of the cleaned sequence, in tables that store it (see :func:`stored`).
KEY = "_sequence_key"


def q(name: str):
    """Column reference that survives dots, spaces and brackets in names."""
    return F.col("`" + name.replace("`", "``") + "`")


def ingest_wide(raw: DataFrame, index_col: str = INDEX_COL, repair_cells: bool = False) -> DataFrame:
    """Raw all-string wide table -> ``clean_wide``.

    ``raw`` holds the source columns plus ``index_col`` (the 0-based file
    position, from :func:`assaykit.operators.rows.with_file_row_index` or
    :func:`with_partition_row_index`). Headers are repaired and mapped to
    roles, every cell is cleaned and null tokens become null; then
    ``sequence_raw/clean/id`` and the parsed numbers are added. All of it
    is one projection."""
    src = [c for c in raw.columns if c != index_col]
    names = dedupe_headers([normalize_header(c) for c in src])
    if "sequence" not in names:
        raise ValueError("No sequence column found among headers: %r" % (src,))
    df = raw.select(F.col(index_col).cast("long").alias(index_col),
                    *[q(c).cast("string").alias(n) for c, n in zip(src, names)])
    if repair_cells:
        for n in names:
            df = repair_column(df, n)
    cells = [F.col(index_col)] + [clean_cell(q(n)).alias(n) for n in names]
    df = df.select(*cells)
    extra = [F.col("sequence").alias("sequence_raw"),
             normalize_sequence("sequence", cleaned=True).alias("sequence_clean")]
    df = df.select("*", *extra)
    out = [q(c) for c in df.columns]
    if "difficulty_prediction" in names:
        out = [lower_trim("difficulty_prediction").alias("difficulty_prediction")
               if c == "difficulty_prediction" else q(c) for c in df.columns]
    out.append(stable_id("pep", "sequence_clean").alias("sequence_id"))
    for role, derived, fn in DERIVED_NUMERIC:
        if role in names:
            out.append(fn(role).alias(derived))
    return df.select(*out)


def stored(clean: DataFrame) -> DataFrame:
    """``clean_wide`` for writing: the text of the sequence once (its raw form
    is the column ``sequence``, its clean form follows from it), and the KEY."""
    return clean.withColumn(KEY, F.sha1(F.col("sequence_clean"))).drop("sequence_raw", "sequence_clean")


def restored(written: DataFrame) -> DataFrame:
    """``clean_wide`` with KEY from what :func:`stored` wrote; columns in the
    order of :func:`ingest_wide`. Jobs that select no text do not read it."""
    at = written.columns.index("sequence_id")
    texts = [F.col("sequence").alias("sequence_raw"), normalize_sequence("sequence", cleaned=True).alias("sequence_clean")]
    return written.select(*[q(c) for c in written.columns[:at]], *texts, *[q(c) for c in written.columns[at:]])


@dataclass
class ConditionStats:
    column: str
    n_label: int
    n_nonempty: int
    name_hint: bool
    label_hint: bool

    @property
    def is_condition(self) -> bool:
        return self.name_hint or self.label_hint


def condition_candidates(clean: DataFrame) -> list[str]:
    """Every column but the metadata roles is a candidate (in order)."""
    return [c for c in clean.columns if c not in META_COLUMNS and c != KEY]


def condition_stats_frame(clean: DataFrame) -> DataFrame:
    """One-row frame: labelled and non-empty cell counts of every candidate."""
    aggs = []
    for i, c in enumerate(condition_candidates(clean)):
        v = q(c).cast("string")
        aggs.append(F.count(normalize_label(v, cleaned=True)).alias(f"l{i}"))
        aggs.append(F.count(v).alias(f"n{i}"))
    return clean.agg(*aggs)


def detect_condition_columns(clean: DataFrame) -> list[ConditionStats]:
    """A candidate is a condition when its name holds a hint, or when at
    least half of its non-empty cells parse as labels. One aggregate job;
    the single result row is read on the driver."""
    cands = condition_candidates(clean)
    row = condition_stats_frame(clean).first()
    out = []
    for i, c in enumerate(cands):
        n_label, n_nonempty = int(row[f"l{i}"]), int(row[f"n{i}"])
        name_hint = any(h in c.lower() for h in CONDITION_HINTS)
        label_hint = n_nonempty > 0 and n_label > 0 and n_label / n_nonempty >= 0.5
        out.append(ConditionStats(c, n_label, n_nonempty, name_hint, label_hint))
    return out


def condition_columns(clean: DataFrame) -> list[str]:
    found = [s.column for s in detect_condition_columns(clean) if s.is_condition]
    if not found:
        raise ValueError("No condition label columns detected.")
    return found


def ingest_quality_score(raw: DataFrame) -> DataFrame:
    """Score of one raw read: ``n_cols + 100*has_sequence +
    10*n_cols_with_any_label - 0.1*weird_chars_in_headers``; a read with
    at most one column scores its column count. One aggregate job."""
    cols = [c for c in raw.columns]
    n_cols = len(cols)
    if n_cols <= 1:
        return raw.sparkSession.range(1).select(F.lit(float(n_cols)).alias("score"))
    fixed = [normalize_header(c) for c in cols]
    has_seq = int("sequence" in fixed)
    labelled = [F.max(F.when(normalize_label(q(c).cast("string")).isNotNull(), 1).otherwise(0))
                for c in cols]
    n_label_cols = sum(labelled[1:], labelled[0])
    # header weird count is schema-only; computed with the same native rule
    weird = sum(weird_count(F.lit(h)) for h in fixed)
    return raw.agg(
        F.lit(n_cols).cast("long").alias("n_cols"),
        F.lit(has_seq).cast("int").alias("has_sequence"),
        n_label_cols.cast("long").alias("n_label_cols"),
        (F.lit(float(n_cols)) + F.lit(100.0 * has_seq) + n_label_cols * 10.0
         - weird.cast("double") * 0.1).alias("score"))
