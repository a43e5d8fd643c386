"""The dataset build job: raw wide table -> clean wide -> long table ->
features -> QC tables -> summary.

The clean wide table is written once to the shared folder (lineage is cut
there, for executor loss), with the text of the sequence once and the key of
the sequence, so that groupings read no text; the condition-detection
aggregate runs on it (one row); everything after that is lazy.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import normalize_label
from ..functions.sequence import is_canonical
from ..functions.text import slugify
from ..operators import qc
from ..operators.ingest import KEY, condition_columns, ingest_wide, q, restored, stored
from ..operators.reshape import unknown_label_values, wide_to_long
from ..session import materialize
from . import fixtures


class DatasetBuild:
    def __init__(self, spark: SparkSession, raw: DataFrame):
        self.spark = spark
        self.raw = raw

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str) -> "DatasetBuild":
        return cls(spark, fixtures.wide_raw(spark, sf_dir))

    @cached_property
    def keyed(self) -> DataFrame:
        """Cleaned wide table with the sequence key, written once to the shared
        folder: the detection aggregate and every downstream table read it
        instead of re-running the text cleaning (and lineage is cut there)."""
        return restored(materialize(stored(ingest_wide(self.raw)), "clean_wide"))

    @property
    def clean(self) -> DataFrame:
        return self.keyed.drop(KEY)

    @cached_property
    def conditions(self) -> list[str]:
        return condition_columns(self.keyed)

    @cached_property
    def cells(self) -> DataFrame:
        """The long table with the sequence key."""
        return wide_to_long(self.keyed, self.conditions)

    @property
    def long(self) -> DataFrame:
        return self.cells.drop(KEY)

    @cached_property
    def features(self) -> DataFrame:
        return qc.peptide_features(self.keyed)

    # QC tables -------------------------------------------------------------
    def features_for_model(self) -> DataFrame:
        return qc.join_long_features(self.cells, self.features)

    def condition_summary(self) -> DataFrame:
        return qc.condition_summary(self.cells, self.keyed, self.conditions)

    def label_variability(self) -> DataFrame:
        return qc.label_variability(self.cells, self.keyed)

    def duplicate_conflicts(self) -> DataFrame:
        return qc.duplicate_conflicts(self.cells, self.keyed)

    def sequence_qc(self) -> DataFrame:
        return qc.sequence_qc(self.features)

    def mw_discrepancies(self) -> DataFrame:
        return qc.mw_discrepancies(self.keyed, self.features)

    def unknown_label_values(self) -> DataFrame:
        return unknown_label_values(self.keyed, self.conditions)

    def condition_metadata_template(self) -> DataFrame:
        return qc.condition_metadata_template(self.spark, self.conditions)

    def top_conflicts(self, n: int = 30) -> DataFrame:
        return qc.top_conflicts(self.cells, self.keyed, n)

    def report_examples(self, n: int = 30) -> DataFrame:
        return qc.report_examples(self.cells, self.keyed, self.unknown_label_values(), n)

    @cached_property
    def per_sequence(self) -> DataFrame:
        """One row per sequence, numbers only, written: wide rows, labelled
        (``n{i}``) and positive (``p{i}``) cells of each condition, cells with an
        unknown label, and length and kind of the sequence. One scan of the wide
        table and one shuffle by key; every count of the summary follows."""
        counts = [F.count(F.lit(1)).alias("n_rows")]
        unknown = F.lit(0)
        for i, c in enumerate(self.conditions):
            y = normalize_label(q(c).cast("string"), cleaned=True)
            counts += [F.count(y).alias(f"n{i}"), F.count_if(y == 1).alias(f"p{i}")]
            unknown = unknown + F.when(q(c).isNotNull() & y.isNull(), 1).otherwise(0)
        letters = F.col("sequence_clean")
        counts += [F.sum(unknown).alias("n_unknown"), F.max(is_canonical(letters)).alias("canonical"), F.max(F.length(letters)).alias("length")]
        return materialize(self.keyed.groupBy(KEY).agg(*counts), "per_sequence")

    def _counts(self) -> dict[str, Column]:
        """Aggregates over :attr:`per_sequence`, by their names in the summary."""
        n = [F.col(f"n{i}") for i in range(len(self.conditions))]
        p = [F.col(f"p{i}") for i in range(len(self.conditions))]
        cells, positive = sum(n[1:], n[0]), sum(p[1:], p[0])
        tested = sum([(x > 0).cast("int") for x in n], F.lit(0))
        # Conditions whose names give one identifier are one.
        labelled = F.array_distinct(F.filter(F.array(*[F.when(F.max(x) > 0, slugify(F.lit(c))) for x, c in zip(n, self.conditions)]), lambda v: v.isNotNull()))
        ids = F.substring(KEY, 1, 12)
        return {
            "wide_peptide_rows": F.coalesce(F.sum("n_rows"), F.lit(0)),
            "labeled_peptide_solvent_records": F.coalesce(F.sum(cells), F.lit(0)),
            "unique_peptides_wide": F.countDistinct(ids),
            "unique_peptides_long": F.countDistinct(F.when(cells > 0, ids)),
            "n_detected_solvent_columns": F.lit(len(self.conditions)).cast("long"),
            "n_solvents_with_labels": F.size(labelled).cast("long"),
            "n_soluble": F.coalesce(F.sum(positive), F.lit(0)),
            "n_insoluble": F.coalesce(F.sum(cells - positive), F.lit(0)),
            "positive_rate": F.try_divide(F.sum(positive).cast("double"), F.sum(cells)),
            "canonical_sequence_count": F.count_if(F.col("canonical")),
            "noncanonical_or_missing_sequence_count": F.count_if(~F.col("canonical")),
            "sequences_tested_in_multiple_solvents": F.count_if(tested >= 2),
            "sequences_with_discordant_solvent_labels": F.count_if((positive > 0) & (cells > positive)),
            "duplicate_sequence_solvent_groups": sum([F.count_if(x > 1) for x in n], F.lit(0)).cast("long"),
            "conflicting_sequence_solvent_groups": sum([F.count_if((y > 0) & (x > y)) for x, y in zip(n, p)], F.lit(0)).cast("long"),
            "unknown_label_values_count": F.coalesce(F.sum("n_unknown"), F.lit(0)),
        }

    def summary(self) -> DataFrame:
        """One-row dataset summary of global counts: a single aggregate over
        :attr:`per_sequence`."""
        return self.per_sequence.agg(*[c.alias(name) for name, c in self._counts().items()])

    def summary_document(self, read_info: dict[str, str] | None = None, output_files: dict[str, str] | None = None) -> DataFrame:
        """The whole summary as one nested row: the counts, the label counts as
        a struct, statistics of lengths and of the three measured columns, the
        counts of difficulty classes as a map, the detected conditions as a
        list, and what the caller says of its input and output files.

        Three grains are read: sequences, wide rows for the statistics, and
        difficulty classes (one entry per class)."""
        counts = self.summary()
        measured = {"mw_input_stats": "mw_num", "quantity_total_mg_stats": "quantity_total_mg", "hplc_percent_stats": "hplc_percent"}
        present = {k: c for k, c in measured.items() if c in self.keyed.columns}
        lengths = self.per_sequence.select(F.when(F.col("canonical"), F.col("length")).alias("length"))
        stats = qc.numeric_summaries(lengths, ["length"])
        if present:
            stats = stats.unionByName(qc.numeric_summaries(self.keyed, list(present.values())))
        told = F.map_from_entries(F.collect_list(F.struct("column_name", F.struct("n", *qc.SUMMARY_FIELDS))))
        stats = materialize(stats.agg(told.alias("stats")), "summary_stats")  # one row with an entry per column
        kinds = "difficulty_prediction" in self.keyed.columns
        classes = qc.category_counts(self.keyed, "difficulty_prediction") if kinds else self.spark.createDataFrame([], "value string, count long")
        classes = materialize(classes.agg(F.map_from_entries(F.collect_list(F.struct("value", "count"))).alias("classes")), "summary_classes")

        def stat(column: str) -> Column:
            return F.element_at(stats.select("stats").scalar(), column)

        def texts(told: dict[str, str] | None) -> Column:
            entries = [F.lit(x) for kv in (told or {}).items() for x in kv]
            return F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")

        labels = {"soluble": "n_soluble", "insoluble": "n_insoluble", "positive_rate": "positive_rate"}
        plain = [c for c in counts.columns if c not in labels.values()]
        return counts.select(
            texts(read_info).alias("read_info"), *plain,
            F.array(*[F.lit(c) for c in self.conditions]).alias("detected_solvent_columns"),
            F.struct(*[F.col(c).alias(k) for k, c in labels.items()]).alias("label_counts"),
            stat("length").alias("peptide_length_stats"), *[stat(c).alias(k) for k, c in present.items()],
            classes.select("classes").scalar().alias("difficulty_prediction_counts"),
            texts(output_files).alias("output_files"))
