"""QC and summary tables as grouped aggregates.

Scale notes: groupings carry numbers only (keys, counts, the smallest row
index), so they are hash aggregates with map-side partial aggregation, and a
key holding a third of the rows is combined per task before the shuffle; texts
are fetched afterwards, by row index, for the one row of each group that is
shown. Sequence grouping uses the full SHA-1 of the cleaned sequence as the key
(collision-safe, 40 bytes), taken from the column ``KEY`` where the table has
it, so that the text need not be read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conditions import PHYSICAL_COLUMNS, TEMPLATE_NOTE, condition_class_columns
from ..functions.sequence import (PEPTIDE_FEATURES, is_canonical, noncanonical_symbols,
                                  peptide_count_columns, peptide_descriptor_columns)
from ..functions.text import missing_sequence_flag, sha1_hex, slugify
from ..session import materialize
from .ingest import INDEX_COL, KEY
from .rows import exact_quantiles, running_sums


# ---------------------------------------------------------------------------
# Dimension of detected conditions (driver list -> tiny frame)
# ---------------------------------------------------------------------------
def condition_frame(spark: SparkSession, conditions: list[str]) -> DataFrame:
    """(solvent_order, solvent_name) for the detected condition columns;
    its size is the number of columns of the wide table."""
    schema = T.StructType([T.StructField("solvent_order", T.IntegerType(), False),
                           T.StructField("solvent_name", T.StringType(), False)])
    return spark.createDataFrame([(i, c) for i, c in enumerate(conditions)], schema)


def condition_summary(long: DataFrame, clean: DataFrame, conditions: list[str]) -> DataFrame:
    """Per detected condition (zero rows kept): labelled, soluble,
    insoluble, positive rate (null if none), missing cells (= wide rows -
    labelled) and distinct sequences."""
    n_total = clean.select(F.count(F.lit(1))).scalar()
    agg = long.groupBy("solvent_name").agg(
        F.count(F.lit(1)).alias("n_labeled_records"),
        F.count_if(F.col("y") == 1).alias("n_soluble"),
        F.count_if(F.col("y") == 0).alias("n_insoluble"),
        F.countDistinct("sequence_id").alias("n_unique_peptides"))
    dim = condition_frame(long.sparkSession, conditions)
    j = dim.join(F.broadcast(agg), "solvent_name", "left")  # one row per condition
    n_lab = F.coalesce(F.col("n_labeled_records"), F.lit(0)).cast("long")
    n_sol = F.coalesce(F.col("n_soluble"), F.lit(0)).cast("long")
    return j.select(
        "solvent_name", slugify("solvent_name").alias("solvent_id"),
        n_lab.alias("n_labeled_records"), n_sol.alias("n_soluble"),
        F.coalesce(F.col("n_insoluble"), F.lit(0)).cast("long").alias("n_insoluble"),
        F.try_divide(n_sol.cast("double"), n_lab.cast("double")).alias("positive_rate"),
        (n_total - n_lab).cast("long").alias("n_missing_cells"),
        F.coalesce(F.col("n_unique_peptides"), F.lit(0)).cast("long").alias("n_unique_peptides"))


def sequence_key(df: DataFrame) -> Column:
    """SHA-1 of the cleaned sequence: stored, or taken from the text."""
    return F.col(KEY) if KEY in df.columns else sha1_hex("sequence_clean")


def _texts(long: DataFrame, clean: DataFrame | None) -> DataFrame:
    """(row index, sequence_id, sequence_clean), one row per wide row."""
    t = (clean if clean is not None else long).select(INDEX_COL, "sequence_id", "sequence_clean")
    return t if clean is not None else t.dropDuplicates([INDEX_COL])


def label_variability(long: DataFrame, clean: DataFrame | None = None) -> DataFrame:
    """Per sequence: records, distinct conditions, positives, negatives and
    a discordant flag (both labels seen). ``clean``, the wide table, gives
    the texts of the sequences if it is at hand."""
    g = long.groupBy(sequence_key(long).alias("_k")).agg(
        F.min(INDEX_COL).alias("_first"),
        F.count(F.lit(1)).alias("n_records"),
        F.countDistinct("solvent_id").alias("n_solvents_tested"),
        F.count_if(F.col("y") == 1).alias("n_soluble"),
        F.count_if(F.col("y") == 0).alias("n_insoluble"))
    return _texts(long, clean).join(g, F.col(INDEX_COL) == F.col("_first")).select(
        "sequence_id", "sequence_clean", "n_records", "n_solvents_tested", "n_soluble",
        "n_insoluble",
        F.when((F.col("n_soluble") > 0) & (F.col("n_insoluble") > 0), 1).otherwise(0)
        .cast("int").alias("has_discordant_solvent_labels"))


def duplicate_groups(long: DataFrame) -> DataFrame:
    """Per (sequence, condition), as (_k, solvent_name): records, distinct
    labels (0 and 1) and their sorted list, duplicate and conflict flags, and
    ``_first``, the smallest row index. Numbers only."""
    g = long.groupBy(sequence_key(long).alias("_k"), "solvent_name").agg(
        F.min(INDEX_COL).alias("_first"), F.count(F.lit(1)).alias("n_records"),
        F.min("y").alias("_low"), F.max("y").alias("_high"))
    labels = F.array_distinct(F.array("_low", "_high"))
    return g.select(
        "_k", "solvent_name", "_first", "n_records", F.size(labels).cast("long").alias("n_unique_labels"),
        F.array_join(F.transform(labels, lambda v: v.cast("string")), ";").alias("labels_observed"),
        F.when(F.col("n_records") > 1, 1).otherwise(0).cast("int").alias("has_duplicate"),
        F.when(F.size(labels) > 1, 1).otherwise(0).cast("int").alias("has_conflict"))


def group_members(long: DataFrame, order_col: str = INDEX_COL) -> DataFrame:
    """The child table of :func:`duplicate_groups`: (_k, solvent_name, rank,
    observation_id), ranked from 1 in row order. Ranks come from ranges of
    (group, row), so a group with a third of all rows is many tasks' work."""
    rows = long.select(sequence_key(long).alias("_k"), "solvent_name", F.col(order_col).alias("_row"), "observation_id", F.lit(1).cast("long").alias("n"))
    return running_sums(rows, ["_k", "solvent_name"], "_row", ["n"]).select("_k", "solvent_name", (F.col("n_below") + 1).alias("rank"), "observation_id")


#: Ids that are joined to one piece of text before the pieces are.
IDS_A_PIECE = 1000


def member_lists(members: DataFrame) -> DataFrame:
    """For an export: the ids of each group joined by ';' in rank order,
    (_k, solvent_name, observation_ids). Pieces of at most IDS_A_PIECE ids are
    joined first, in many tasks; the whole string, which is what the export
    asks for, exists in one row only at the end."""
    def joined(order: str, text: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), ";")

    pieces = members.groupBy("_k", "solvent_name", F.expr(f"(rank - 1) div {IDS_A_PIECE}").alias("piece")).agg(joined("rank", "observation_id").alias("ids"))
    return pieces.groupBy("_k", "solvent_name").agg(joined("piece", "ids").alias("observation_ids"))


CONFLICT_COLUMNS = ["sequence_clean", "solvent_name", "n_records", "n_unique_labels", "labels_observed", "has_duplicate", "has_conflict"]


def named_groups(long: DataFrame, clean: DataFrame | None = None) -> DataFrame:
    """:func:`duplicate_groups` with the text of the sequence."""
    return _texts(long, clean).join(duplicate_groups(long), F.col(INDEX_COL) == F.col("_first")).select("_k", *CONFLICT_COLUMNS)


def duplicate_conflicts(long: DataFrame, clean: DataFrame | None = None) -> DataFrame:
    """Per (sequence, condition): records, distinct labels, the sorted
    labels joined by ';', duplicate and conflict flags, and the
    observation ids joined in source-row order."""
    lists = member_lists(group_members(long))
    return named_groups(long, clean).join(lists, ["_k", "solvent_name"]).select(*CONFLICT_COLUMNS, "observation_ids")


def sort_conflicts(dc: DataFrame) -> DataFrame:
    """Conflicts first, then duplicates, then larger groups; keys break ties."""
    return dc.orderBy(F.desc("has_conflict"), F.desc("has_duplicate"), F.desc("n_records"),
                      "sequence_clean", "solvent_name")


def top_conflicts(long: DataFrame, clean: DataFrame | None = None, n: int = 30) -> DataFrame:
    """The first ``n`` of :func:`sort_conflicts`; ids are listed for those
    groups only."""
    top = materialize(sort_conflicts(named_groups(long, clean)).limit(n), "top_conflicts")
    members = group_members(long).join(F.broadcast(top.select("_k", "solvent_name")), ["_k", "solvent_name"], "left_semi")  # n rows
    return sort_conflicts(top.join(member_lists(members), ["_k", "solvent_name"]).select(*CONFLICT_COLUMNS, "observation_ids"))


def report_examples(long: DataFrame, clean: DataFrame, unknown: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` cases of each kind that the report lists, as (kind,
    position, subject, detail): sequences that are not canonical, in row order,
    with their other symbols; conflicts, in the order of :func:`sort_conflicts`,
    with their labels; labels that are not understood, in row and column order.
    Each kind is a top-n, so no more than ``n`` rows of it are numbered."""
    def first(df: DataFrame, kind: str, order: list, subject: Column, detail: Column) -> DataFrame:
        top = df.select(F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), detail.alias("detail"), F.struct(*order).alias("_o")).orderBy("_o").limit(n)
        return top.select("kind", F.row_number().over(Window.partitionBy("kind").orderBy("_o")).alias("position"), "subject", "detail")

    seqs = distinct_by_key(clean, "sequence_id", [INDEX_COL, "sequence_clean"]).where(~is_canonical("sequence_clean"))
    groups = named_groups(long, clean).where("has_conflict = 1")
    return (first(seqs, "noncanonical", [F.col(INDEX_COL)], F.col("sequence_id"), noncanonical_symbols("sequence_clean"))
            .unionByName(first(groups, "conflict", [-F.col("n_records"), F.col("sequence_clean"), F.col("solvent_name")], F.col("solvent_name"), F.col("labels_observed")))
            .unionByName(first(unknown, "unknown_label", [F.col("row_index"), F.col("solvent_column")], F.col("row_index"), F.concat_ws(": ", "solvent_column", "raw_value"))))


def distinct_by_key(df: DataFrame, key: str, cols: list[str], order_col: str = INDEX_COL) -> DataFrame:
    """First row (lowest ``order_col``, unique) per key, deterministic. Only
    key and row number are grouped; the other columns are read for the rows
    that are kept and cross one exchange at most."""
    first = df.groupBy(key).agg(F.min(order_col).alias("_first")).select("_first")
    kept = df.join(first, F.col(order_col) == F.col("_first"), "left_semi")
    return kept.select(key, *cols)


def peptide_features(clean: DataFrame) -> DataFrame:
    """``peptide_features``: distinct sequence_id (first row wins) with the
    94 QC descriptors; ids first."""
    uniq = distinct_by_key(clean, "sequence_id", ["sequence_raw", "sequence_clean"])
    return features_of(uniq, "sequence_clean").select(
        "sequence_id", "sequence_raw", "sequence_clean", *PEPTIDE_FEATURES)


def features_of(df: DataFrame, seq_col: str) -> DataFrame:
    """Append the QC descriptors of ``seq_col`` to ``df``."""
    counts = df.select("*", *peptide_count_columns(seq_col))
    return counts.select("*", *peptide_descriptor_columns(seq_col))


def join_long_features(long: DataFrame, feats: DataFrame) -> DataFrame:
    """``features_for_model``: left join of long rows with the features on
    (sequence_id, sequence_clean). The text is compared through its SHA-1,
    so the join key stays 52 bytes whatever the sequence length."""
    f = feats.drop("sequence_raw").withColumn("_k", sequence_key(feats)).drop("sequence_clean", KEY)
    l = long.withColumn("_k", sequence_key(long))
    return l.join(f, ["sequence_id", "_k"], "left").drop("_k", KEY)


def sequence_qc(feats: DataFrame) -> DataFrame:
    return feats.select("sequence_id", "sequence_raw", "sequence_clean", "length_raw",
                        "length", "is_canonical_aa", "noncanonical_symbols",
                        missing_sequence_flag("sequence_clean").alias("missing_sequence"))


def join_mw_check(clean: DataFrame, feats: DataFrame) -> DataFrame:
    """First row per sequence_id with its stated mass, left-joined with the
    computed mass; absolute difference. Both sides are keyed by
    sequence_id, so the planner joins them without re-shuffling."""
    first = distinct_by_key(clean, "sequence_id", ["sequence_clean", "mw", "mw_num"])
    j = first.join(feats.select("sequence_id", "mw_calc_avg"), "sequence_id", "left")
    return j.select("sequence_id", "sequence_clean", "mw", "mw_num", "mw_calc_avg",
                    F.abs(F.col("mw_num") - F.col("mw_calc_avg")).alias("mw_abs_diff"))


def mw_discrepancies(clean: DataFrame, feats: DataFrame) -> DataFrame:
    return join_mw_check(clean, feats).orderBy(F.desc_nulls_last("mw_abs_diff"), "sequence_id")


def condition_metadata_template(spark: SparkSession, conditions: list[str]) -> DataFrame:
    """Keyword classes and flags per condition, blank physical columns."""
    dim = condition_frame(spark, conditions)
    return dim.select(
        "solvent_name", slugify("solvent_name").alias("solvent_id"),
        *condition_class_columns("solvent_name"),
        *[F.lit(None).cast("string").alias(c) for c in PHYSICAL_COLUMNS],
        F.lit(TEMPLATE_NOTE).alias("notes"))


def category_counts(df: DataFrame, col: str) -> DataFrame:
    """Value counts with null reported as 'missing'."""
    return (df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit("missing")).alias("value"))
            .agg(F.count(F.lit(1)).alias("count")))


# ---------------------------------------------------------------------------
# Numeric summaries
# ---------------------------------------------------------------------------
SUMMARY_FIELDS = ["mean", "std", "min", "q1", "median", "q3", "max"]


def numeric_summaries(df: DataFrame, cols: list[str]) -> DataFrame:
    """column_name, n, mean, sample std (0 when n = 1), min, q1, median, q3,
    max of each column, quantiles with linear interpolation; all null when
    n = 0.

    Moments are one grouped aggregate over (column, value) rows, quantiles
    are exact (:func:`assaykit.operators.rows.exact_quantiles`): the number
    of shuffles does not depend on the number of columns."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("v")) for c in cols])
    moments = df.select(F.explode(cells).alias("x")).groupBy("x.column_name").agg(
        F.count("x.v").alias("n"), F.avg("x.v").alias("mean"), F.stddev_samp("x.v").alias("std"), F.min("x.v").alias("min"), F.max("x.v").alias("max"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    # Both sides have one row per column of the list.
    out = names.join(F.broadcast(moments), "column_name", "left").join(F.broadcast(exact_quantiles(df, cols, [0.25, 0.5, 0.75])), "column_name", "left")
    return out.select("column_name", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean",
                      F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.col("std")).alias("std"), "min",
                      *[F.col("q")[k].alias(c) for k, c in enumerate(["q1", "median", "q3"])], "max")


def numeric_summary(df: DataFrame, col: str) -> DataFrame:
    """:func:`numeric_summaries` of one column, without its name."""
    return numeric_summaries(df, [col]).drop("column_name")
