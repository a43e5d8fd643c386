"""Deterministic, leak-controlled splits.

Library random streams are not reproducible across engines, so the order
inside each stratum is an md5 digest of ``seed|id`` (ties by id): the
same ids always land in the same split, on any cluster layout, and the
rule can be checked in SQL. Sizes follow the usual conventions:

* holdout: ``n_test = ceil(15 N / 100)``, then ``n_val = ceil(3 N' / 17)``
  of the remaining ``N'`` (0.15 of the whole); per stratum the floor of
  the proportional share, remainders to the largest fractions (ties by
  stratum value);
* k-fold: fold = (start + rank - 1) mod k inside a stratum, strata in
  ascending order, ``start`` = size of the earlier strata;
* stratification only when >= 2 classes and every class reaches the
  minimum (2 for a holdout, k for k-fold), else one stratum.

Ranks come from :func:`assaykit.operators.rows.rank_within` (256 or more
digest buckets per stratum), so a stratum with a third of the data is never
one task. Ranking moves ids, digests and strata only; sequences and the rest
of the context are joined to the finished assignment. Driver-side work is
limited to per-stratum counts.

Records repeat long sequences, so they may be narrow: a reference (TEXT) in
place of the sequence, for group protocols with the sequence's key and digests
(:func:`keyed_texts`). ``texts`` (TEXT, sequence) are then joined to the finished
rows, so that a text is shuffled once and not once per record; without them
the tables keep the reference.
"""
from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .rows import digest, rank_within, running_sums, small_join

TEST_FRACTION = Fraction(15, 100)
VAL_FRACTION_OF_REST = Fraction(15, 85)


def stratum_counts(df: DataFrame, stratum: str) -> list[tuple]:
    """Sorted (stratum value, count), nulls first; one row per label class."""
    rows = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted(((r[0], int(r[1])) for r in rows), key=lambda kv: (kv[0] is not None, 0 if kv[0] is None else kv[0]))


def stratify_feasible(counts: list[tuple], min_count: int) -> bool:
    """>= 2 classes and the smallest reaches ``min_count``."""
    return len(counts) >= 2 and min(n for _, n in counts) >= min_count


def allocate(counts: list[tuple], n_draw: int) -> dict:
    """Per-stratum share of ``n_draw``: floors of the proportional share,
    the remainder to the largest fractional parts (ties by stratum)."""
    total = sum(n for _, n in counts)
    if total == 0:
        return {}
    exact = {k: Fraction(n * n_draw, total) for k, n in counts}
    out = {k: math.floor(v) for k, v in exact.items()}
    left = n_draw - sum(out.values())
    order = sorted(counts, key=lambda kv: (-(exact[kv[0]] - out[kv[0]]), kv[0] is not None, 0 if kv[0] is None else kv[0]))
    for k, _ in order[:left]:
        out[k] += 1
    return out


def _sizes_frame(spark, sizes: dict, stratum_type, col: str) -> DataFrame:
    schema = T.StructType([T.StructField("_stratum", stratum_type, True),
                           T.StructField(col, T.LongType(), False)])
    return spark.createDataFrame([(k, int(v)) for k, v in sizes.items()], schema)


def _stratum(col: str | None):
    """The stratum as text, a null as the empty one, so that no join loses it."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")) if col else F.lit("")


def holdout_assign(df: DataFrame, id_col: str, stratum: str | None, seed: int, digests: tuple | None = None) -> DataFrame:
    """70/15/15 holdout of the rows of ``df`` (unique ``id_col``):
    adds ``split`` in {train, val, test}. ``digests`` are the order keys of the
    test and the validation draw, if they are columns already."""
    first, second = digests or (digest(seed, id_col), digest(seed + 1, id_col))
    spark = df.sparkSession
    work = df.withColumn("_s", _stratum(stratum))
    counts = stratum_counts(work, "_s")
    n = sum(c for _, c in counts)
    if not stratify_feasible(counts, 2):
        work = work.withColumn("_s", _stratum(None))
        counts = [("", n)]
    stype = work.schema["_s"].dataType
    n_test = math.ceil(n * TEST_FRACTION)
    test_sz = allocate(counts, n_test)
    ranked = rank_within(work, "_s", first, id_col, "_r1", n_strata=len(counts), largest=max((c for _, c in counts), default=0))
    ranked = small_join(ranked, _sizes_frame(spark, test_sz, stype, "_nt").withColumnRenamed(
        "_stratum", "_s"), "_s", "left", rows=len(counts))
    ranked = ranked.withColumn("_is_test", F.col("_r1") <= F.coalesce(F.col("_nt"), F.lit(0)))
    rest_counts = [(k, c - test_sz.get(k, 0)) for k, c in counts]
    rest = ranked.where(~F.col("_is_test"))
    if len(counts) > 1 and not stratify_feasible([kv for kv in rest_counts if kv[1] > 0], 2):
        rest = rest.withColumn("_s", _stratum(None))
        rest_counts = [("", sum(c for _, c in rest_counts))]
    n_val = math.ceil((n - n_test) * VAL_FRACTION_OF_REST)
    val_sz = allocate(rest_counts, n_val)
    rest = rank_within(rest, "_s", second, id_col, "_r2", n_strata=len(rest_counts), largest=max((c for _, c in rest_counts), default=0))
    rest = small_join(rest, _sizes_frame(spark, val_sz, stype, "_nv").withColumnRenamed(
        "_stratum", "_s"), "_s", "left", rows=len(rest_counts))
    rest = rest.withColumn("split", F.when(F.col("_r2") <= F.coalesce(F.col("_nv"), F.lit(0)), "val")
                           .otherwise("train"))
    test = ranked.where(F.col("_is_test")).withColumn("split", F.lit("test"))
    cols = df.columns + ["split"]
    return test.select(*cols).unionByName(rest.select(*cols))


def kfold_assign(df: DataFrame, id_col: str, stratum: str | None, seed: int, k: int = 5, order=None) -> DataFrame:
    """Adds ``fold_id`` in [0, k): the test fold of each row. ``order`` is the
    order key, if it is a column already."""
    spark = df.sparkSession
    work = df.withColumn("_s", _stratum(stratum))
    counts = stratum_counts(work, "_s")
    if not stratify_feasible(counts, k):
        work = work.withColumn("_s", _stratum(None))
        counts = [("", sum(c for _, c in counts))]
    starts, acc = {}, 0
    for key, c in counts:
        starts[key] = acc
        acc += c
    stype = work.schema["_s"].dataType
    ranked = rank_within(work, "_s", digest(seed, id_col) if order is None else order, id_col, "_r", n_strata=len(counts), largest=max((c for _, c in counts), default=0))
    ranked = small_join(ranked, _sizes_frame(spark, starts, stype, "_start").withColumnRenamed(
        "_stratum", "_s"), "_s", "left", rows=len(counts))
    return ranked.withColumn("fold_id", F.pmod(F.col("_start") + F.col("_r") - 1, F.lit(k)).cast("int")) \
                 .select(*df.columns, "fold_id")


def kfold_table(assigned: DataFrame, k: int = 5) -> DataFrame:
    """One row per (fold, record): fold i tests fold_id i, validates on
    fold_id (i + 1) mod k, trains on the rest. Rows are generated per
    record (no join)."""
    f = F.col("fold")
    out = assigned.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    split = (F.when(F.col("fold_id") == f, "test")
             .when(F.col("fold_id") == F.pmod(f + 1, F.lit(k)), "val").otherwise("train"))
    return out.withColumn("split", split).drop("fold_id")


def group_label_class(df: DataFrame, group_col: str, label_col: str) -> DataFrame:
    """Per group: mean, count, distinct labels and the class mixed /
    positive (mean >= 0.5) / negative."""
    g = df.groupBy(group_col).agg(F.avg(label_col).alias("mean"),
                                  F.count(label_col).alias("count"),
                                  F.countDistinct(label_col).alias("nunique"))
    cls = (F.when(F.col("nunique") > 1, "mixed").when(F.col("mean") >= 0.5, "positive")
           .otherwise("negative"))
    return g.withColumn("group_label", cls)


# ---------------------------------------------------------------------------
# The five protocols. Input: records with record_id, sequence, solvent, label.
# Output columns: record_id, fold, split, sequence, solvent, label (+ held-out names).
# ---------------------------------------------------------------------------
CONTEXT = ["sequence", "solvent", "label"]
#: In narrow records, the reference to the sequence's text, and the sequence's key.
TEXT, KEY = "_text", "_seq_key"


def context(t: DataFrame) -> list[str]:
    """The context columns of records, narrow ones included."""
    return CONTEXT if "sequence" in t.columns else [c for c in (TEXT, KEY) if c in t.columns] + CONTEXT[1:]


def with_texts(t: DataFrame, texts: DataFrame | None) -> DataFrame:
    """Narrow rows with the sequence in place of its reference; one whose
    reference has no text has a null sequence."""
    return t if texts is None else t.join(texts, TEXT, "left").drop(TEXT, KEY)


def _digest_name(seed: int) -> str:
    return f"_digest_{seed}"


def keyed_texts(texts: DataFrame, seeds: list[int]) -> DataFrame:
    """(TEXT, KEY, digests of the sequence for ``seeds``) from (TEXT, sequence)."""
    return _keyed(texts).select(TEXT, KEY, *[digest(s, "sequence").alias(_digest_name(s)) for s in seeds])


def with_keys(rec: DataFrame, keys: DataFrame, seeds: list[int]) -> DataFrame:
    """Narrow records with the columns of :func:`keyed_texts`; a reference without text counts as a null sequence."""
    told = {KEY: F.lit("null")} | {_digest_name(s): F.md5(F.lit(str(s))) for s in seeds}
    return rec.join(keys, TEXT, "left").withColumns({c: F.coalesce(F.col(c), v) for c, v in told.items()})


def _finish(t: DataFrame, extra: list[str] | None = None) -> DataFrame:
    extra = extra or []
    return t.select("record_id", F.col("fold").cast("int").alias("fold"), "split", *extra, *context(t))


def _assigned(rec: DataFrame, assignment: DataFrame) -> DataFrame:
    """The records with their assignment (unique record ids)."""
    return rec.join(assignment, "record_id")


def pair_holdout_ids(rec: DataFrame, seed: int) -> DataFrame:
    """(record_id, split) of the pair holdout, without the context."""
    return holdout_assign(rec.select("record_id", "label"), "record_id", "label", seed).drop("label")


def split_pair_holdout(rec: DataFrame, seed: int, texts: DataFrame | None = None) -> DataFrame:
    return _finish(with_texts(_assigned(rec, pair_holdout_ids(rec, seed)), texts).withColumn("fold", F.lit(0)))


def pair_folds(rec: DataFrame, seed: int, k: int = 5) -> DataFrame:
    """The records with ``fold_id``, the fold that tests them."""
    return _assigned(rec, kfold_assign(rec.select("record_id", "label"), "record_id", "label", seed, k).drop("label"))


def split_pair_kfold(rec: DataFrame, seed: int, k: int = 5, texts: DataFrame | None = None) -> DataFrame:
    return _finish(kfold_table(with_texts(pair_folds(rec, seed, k), texts), k))


def _groups(rec: DataFrame, seeds: list[int]) -> DataFrame:
    """(_seq_key, _d0, _d1, .., group_label) per distinct sequence, with its
    digest for each seed. Keys, digests and label counts only: the (long)
    sequence text never crosses the shuffle."""
    narrow = "sequence" not in rec.columns
    digests = [(F.col(_digest_name(seed)) if narrow else digest(seed, "sequence")).alias(f"_d{i}") for i, seed in enumerate(seeds)]
    g = _keyed(rec).groupBy("_seq_key", *digests).agg(F.avg("label").alias("mean"), F.countDistinct("label").alias("nunique"))
    cls = (F.when(F.col("nunique") > 1, "mixed").when(F.col("mean") >= 0.5, "positive")
           .otherwise("negative"))
    return g.select("_seq_key", *[f"_d{i}" for i in range(len(seeds))], cls.alias("group_label"))


def _keyed(rec: DataFrame) -> DataFrame:
    """``rec`` with the key of its sequence; a null sequence is a group of its own."""
    if "sequence" not in rec.columns:
        return rec
    return rec.withColumn("_seq_key", F.coalesce(F.sha1(F.col("sequence")), F.lit("null")))


def group_holdout_keys(rec: DataFrame, seed: int) -> DataFrame:
    """(_seq_key, split) of the group holdout."""
    # Written, for counts and ranks read it again.
    groups = materialize(_groups(rec, [seed, seed + 1]), "groups")
    return holdout_assign(groups, "_seq_key", "group_label", seed, (F.col("_d0"), F.col("_d1"))).select("_seq_key", "split")


def split_group_holdout(rec: DataFrame, seed: int, texts: DataFrame | None = None) -> DataFrame:
    """Holdout on distinct sequences stratified by group class; records
    inherit their sequence's split (one join on the sequence key)."""
    return _finish(with_texts(_keyed(rec).join(group_holdout_keys(rec, seed), "_seq_key"), texts).withColumn("fold", F.lit(0)))


def split_group_kfold(rec: DataFrame, seed: int, k: int = 5, texts: DataFrame | None = None) -> DataFrame:
    g = kfold_assign(materialize(_groups(rec, [seed]), "groups"), "_seq_key", "group_label", seed, k, F.col("_d0")).select("_seq_key", "fold_id")
    return _finish(kfold_table(with_texts(_keyed(rec).join(g, "_seq_key"), texts), k))


def condition_ring(rec: DataFrame) -> DataFrame:
    """(fold, heldout_test_solvent, heldout_val_solvent): the conditions
    numbered in code-point order, each with the one that follows it in the ring.
    Numbers come from ranges of the names, the ring from one join on fold and
    fold + 1; no list of all names is made. Needs three conditions or more."""
    names = rec.select("solvent").where(F.col("solvent").isNotNull()).distinct().withColumn("n", F.lit(1).cast("long"))
    numbered = running_sums(names, [], "solvent", ["n"]).select("solvent", F.col("n_below").alias("fold"), F.col("n_total").alias("n"))
    n = numbered.count()
    if n < 3:
        raise ValueError(f"holding out conditions takes three of them; the records have {n}")
    after = numbered.select(F.pmod(F.col("fold") - 1, F.col("n")).alias("fold"), F.col("solvent").alias("heldout_val_solvent"))
    return numbered.join(after, "fold").select(F.col("fold").cast("int").alias("fold"), F.col("solvent").alias("heldout_test_solvent"), "heldout_val_solvent")


def split_leave_one_condition_out(rec: DataFrame) -> DataFrame:
    """Conditions in code-point order; fold i tests condition i and
    validates on condition (i + 1) mod n; needs >= 3 conditions. Every record
    is in every fold, as the protocol has it."""
    ring = condition_ring(rec)
    n = ring.count()
    t = small_join(rec.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), ring, "fold", rows=n)
    split = (F.when(F.col("solvent") == F.col("heldout_test_solvent"), "test")
             .when(F.col("solvent") == F.col("heldout_val_solvent"), "val").otherwise("train"))
    return _finish(t.withColumn("split", split), ["heldout_test_solvent", "heldout_val_solvent"])


def split_fold_extract(t: DataFrame, fold: int = 0) -> DataFrame:
    return t.where(F.col("fold") == fold)


def assign_splits(records: DataFrame, train_ids: DataFrame, val_ids: DataFrame,
                  test_ids: DataFrame, fold: int = 0) -> DataFrame:
    """One row per record from three id sets; on overlap test beats val
    beats train. Ids in no set are an error (checked by the caller with
    :func:`require_covered`)."""
    tagged = (test_ids.select("record_id").withColumn("_p", F.lit(3))
              .unionByName(val_ids.select("record_id").withColumn("_p", F.lit(2)))
              .unionByName(train_ids.select("record_id").withColumn("_p", F.lit(1))))
    best = tagged.groupBy("record_id").agg(F.max("_p").alias("_p"))
    j = records.select("record_id").join(best, "record_id", "left")
    split = (F.when(F.col("_p") == 3, "test").when(F.col("_p") == 2, "val")
             .when(F.col("_p") == 1, "train"))
    return j.select("record_id", F.lit(fold).cast("int").alias("fold"), split.alias("split"))


def require_covered(assigned: DataFrame) -> None:
    n = assigned.where(F.col("split").isNull()).count()
    if n:
        raise KeyError(f"no split holds {n} of the record ids")


def match_split(split: DataFrame, records: DataFrame) -> DataFrame:
    """The records of a split file, with their split; an id that the data or
    one fold of the file holds twice is an error."""
    for df, keys, what in ((records, ["record_id"], "data"), (split, [*{"fold"} & {*split.columns}, "record_id"], "split file")):
        twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()
        if twice:
            raise KeyError(f"{twice} record ids occur more than once in the {what}")
    return split.select("record_id", "split").join(records, "record_id")


def add_context(assigned: DataFrame, records: DataFrame) -> DataFrame:
    """Left join of assignments with (sequence, solvent, label) on record_id."""
    return assigned.join(records.select("record_id", *context(records)), "record_id", "left")


def split_summary(t: DataFrame) -> DataFrame:
    """Per (fold, split): records, positive rate, positives, negatives,
    distinct sequences and conditions."""
    key = F.nullif(F.col(KEY), F.lit("null")) if "sequence" not in t.columns else F.sha1(F.col("sequence"))
    return t.groupBy("fold", "split").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.avg(F.col("label").cast("double")).alias("positive_rate"),
        F.sum(F.col("label")).cast("long").alias("n_positive"),
        F.sum(1 - F.col("label")).cast("long").alias("n_negative"),
        F.countDistinct(key).alias("n_unique_sequences"),
        F.countDistinct("solvent").alias("n_unique_solvents"))
