"""Row position and ranking without a single-task window.

* :func:`with_file_row_index` gives the 0-based position of each row in
  its source files (Parquet ``_metadata.row_index`` plus per-file
  offsets), so the index is a pure function of the data, not of how the
  scan was split.
* :func:`with_partition_row_index` is the general fallback for any input:
  per-partition counts become offsets (one row per partition, a proven
  size bound) and ``monotonically_increasing_id`` gives the in-partition
  position.
* :func:`rank_within` ranks rows inside (possibly huge, few) strata by a
  hex digest. Ranking with ``row_number`` partitioned by a two-valued
  label would put each stratum in one task, so rows are first spread over
  buckets by as many leading digits of the digest as the largest stratum
  asks for; per-(stratum, bucket) counts give each bucket its starting
  rank, and ``row_number`` runs per (stratum, bucket).
* :func:`running_sums` does the same for any order (scores, measured
  values), whose spread is not known: the splitters are sampled by
  ``repartitionByRange`` over (group, value).
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Offsets tables above this many rows are joined with a shuffle instead of
# being broadcast.
BROADCAST_ROW_LIMIT = 200_000


def small_join(big: DataFrame, small: DataFrame, on, how: str = "inner",
               rows: int | None = None, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Join ``small`` into ``big``, broadcasting it only when its row count
    (``rows`` when the caller knows a bound, else counted) is within
    ``limit``; above it, an ordinary shuffle join."""
    n = small.count() if rows is None else rows
    side = F.broadcast(small) if n <= limit else small
    return big.join(side, on, how)


def with_file_row_index(scan: DataFrame, name: str = "source_row_index") -> DataFrame:
    """Position of each row in its Parquet source files, files in path order.

    ``scan`` must be a direct file scan (``spark.read.parquet(...)``) so
    the hidden ``_metadata`` column is available."""
    cols = scan.columns
    tagged = scan.select("*", F.col("_metadata.file_path").alias("_file"),
                         F.col("_metadata.row_index").alias("_pos"))
    per_file = tagged.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    offsets = per_file.select(
        "_file",
        (F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    out = small_join(tagged, offsets, "_file", rows=len(scan.inputFiles()))
    return out.select(*[F.col(f"`{c}`") for c in cols],
                      (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_pos")).cast("long").alias(name))


def with_partition_row_index(df: DataFrame, name: str = "row_index",
                             materialize: bool = False) -> DataFrame:
    """Contiguous 0-based index in partition order.

    Deterministic for file scans. When the input ends in a shuffle, pass
    ``materialize=True``: the tagged rows are checkpointed into the shared
    checkpoint folder so both uses see the same partitions."""
    tagged = (df.withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    if materialize:
        from ..session import shared_dir
        shared_dir(df.sparkSession)  # reliable checkpoint under spark.checkpoint.dir
        tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid")  # one row per partition
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_off") + local).cast("long").alias(name))


def digest(seed, id_col) -> Column:
    """Deterministic, partition-independent order key: md5 of 'seed|id'."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


#: Rows that one (stratum, bucket) of a ranking is meant to hold.
ROWS_A_BUCKET = 100_000


def prefix_digits(n: int) -> int:
    """Leading hex digits that part ``n`` digests into buckets of about
    ROWS_A_BUCKET; at least two, at most eight (4 x 10^9 buckets)."""
    return min(8, max(2, math.ceil(math.log(max(n, 1) / ROWS_A_BUCKET, 16)) if n > ROWS_A_BUCKET else 2))


def rank_within(df: DataFrame, stratum: str | None, key: Column, tie: str,
                name: str = "rank", n_strata: int | None = None, largest: int | None = None) -> DataFrame:
    """1-based rank of each row by (``key``, ``tie``) inside its stratum.

    ``key`` must be a hex digest; its first digits pick the bucket, which
    keeps the order. Work per task is one (stratum, bucket), so a stratum
    holding a third of all rows is spread over 256 tasks, or over more if
    ``largest``, the row count of the largest stratum, asks for them.
    ``n_strata`` (known to callers that allocated sizes per stratum) bounds
    the offsets table at that many rows times the buckets."""
    s = F.col(stratum) if stratum else F.lit(0)
    digits = prefix_digits(largest or 0)
    # Half as long in bytes, in the same order.
    tagged = df.withColumn("_hex", key).withColumn("_key", F.unhex("_hex")).withColumn("_stratum", s) \
               .withColumn("_bucket", F.conv(F.substring("_hex", 1, digits), 16, 10).cast("long")).drop("_hex")
    counts = tagged.groupBy("_stratum", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.partitionBy("_stratum").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_stratum", "_bucket",
                            F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    bound = None if n_strata is None else 16 ** digits * max(n_strata, 1)
    joined = small_join(tagged, offsets, ["_stratum", "_bucket"], rows=bound)
    w = Window.partitionBy("_stratum", "_bucket").orderBy("_key", tie)
    out = joined.withColumn(name, (F.col("_off") + F.row_number().over(w)).cast("long"))
    return out.drop("_key", "_stratum", "_bucket", "_off")


def running_sums(df: DataFrame, keys: list[str], order: str, sums: list[str]) -> DataFrame:
    """``df`` with, for each of ``sums``, ``{s}_below`` (its sum over the rows
    of the group with a smaller ``order``) and ``{s}_total`` (over the group).

    (keys, order) must be unique: count equal values first. Rows are dealt by
    ranges of (keys, order) whose splitters Spark samples, so a group with all
    rows, or values crowded in one spot, still spread over the tasks; a group's
    totals per range (one row for each range it touches) give the offsets."""
    from ..session import materialize
    # Written, for both uses have to see the same ranges.
    dealt = materialize(df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*keys, "_part").agg(*[F.sum(s).alias(s) for s in sums])
    group = Window.partitionBy(*keys)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_part", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_{s}_before") for s in sums],
                            *[F.sum(s).over(group).alias(f"{s}_total") for s in sums])
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_{s}_inside") for s in sums])
    # Null keys are groups as well, as in groupBy.
    offsets = offsets.select(*[F.col(k).alias(f"_{k}_key") for k in [*keys, "_part"]], *[c for c in offsets.columns if c not in (*keys, "_part")])
    same = F.lit(True)
    for k in [*keys, "_part"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}_key"))
    joined = placed.join(offsets, same)
    return joined.select(*df.columns, *[(F.col(f"_{s}_before") + F.col(f"_{s}_inside")).alias(f"{s}_below") for s in sums], *[f"{s}_total" for s in sums])


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], weight: str | None = None) -> DataFrame:
    """(column_name, q): for each column with a value the exact quantiles at
    ``probs``, with linear interpolation between order statistics. ``weight``
    names a column of counts where a row stands for several.

    All columns go through one shuffle of counted (column, value) pairs and one
    range partition of them, whatever their number; nulls and NaN count as
    missing, infinities are values. One row per column."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(cols)])
    each = df.select(F.explode(cells).alias("x"), *([F.col(weight).alias("n")] if weight else [])).where("x.v is not null and not isnan(x.v)")
    counted = each.groupBy("x.i", "x.v").agg((F.sum("n") if weight else F.count(F.lit(1))).alias("n"))
    placed = running_sums(counted, ["i"], "v", ["n"])

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("n_below") <= rank) & (rank < F.col("n_below") + F.col("n")), F.col("v")))

    ends = []
    for k, p in enumerate(probs):
        at = (F.col("n_total") - 1) * F.lit(float(p))
        ends += [value_at(F.floor(at)).alias(f"lo{k}"), value_at(F.ceil(at)).alias(f"hi{k}"), F.max(at - F.floor(at)).alias(f"part{k}")]
    found = placed.groupBy("i").agg(*ends)
    # Equal neighbours are taken as they are: infinity minus infinity is no number.
    between = [F.when(F.col(f"lo{k}") == F.col(f"hi{k}"), F.col(f"lo{k}")).otherwise(F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * F.col(f"part{k}"))
               for k in range(len(probs))]
    return found.select(F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i") + 1).alias("column_name"), F.array(*between).alias("q"))
