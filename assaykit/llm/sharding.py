"""Sharding by sampled splitters: shards of near equal bytes, in key order.

The key is the text's hash, then a row number, so equal texts stand together
and share a shard unless a boundary falls among them. Size-weighted samples of
the keys give quantile boundaries; records are range-partitioned by them; a
range that holds over ``OVERFULL`` times the mean of rows or bytes (one text
repeated without end, say) is sampled again by rows and subdivided, until none is.
Exact sums per range then give every record its place in the whole order, and
the place in bytes its shard: shards differ by less than the largest record.

Only samples (``OVERSAMPLE`` a range) and one row a range reach the driver; both
grow with the number of ranges, ``RANGE_ROWS`` records each, not with the texts.

Defined cases: a null text has size 1 and the digest of the empty text; rows
that repeat are separate records; ties in the hash are ordered by row number;
an empty table gives an empty result; fewer records than shards leave shards
empty; columns with any name come through ``sharded`` unchanged.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import whole
from assaykit.session import materialize

SHARDS, SEED = 16, 7
RANGE_ROWS, LEAST_RANGES, OVERSAMPLE, OVERFULL = 1_000_000, 64, 32, 2.0



def _keys(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """16-byte strings that sort as (h, row) do."""
    flip = np.uint64(1 << 63)
    pair = np.stack([np.asarray(h, np.int64).view(np.uint64) ^ flip, np.asarray(row, np.int64).view(np.uint64) ^ flip], axis=1)
    # Hexadecimal digits: NumPy cuts byte strings at trailing zeros.
    digits = (pair[:, :, None] >> np.arange(60, -4, -4, dtype=np.uint64)) & np.uint64(15)
    return (digits.astype(np.uint8) + np.uint8(65)).reshape(len(pair), 32).view("S32").ravel()


def _sample(base: DataFrame, rate: str) -> pd.DataFrame:
    """Rows kept with probability ``rate`` (at least once if it is over 1), with
    the weight that the rest of the rate is worth."""
    chance = (F.pmod(F.xxhash64(F.lit(SEED), "row"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    return base.withColumn("rate", F.expr(rate)).where(chance < F.col("rate")).select("h", "row", F.greatest(F.lit(1.0), F.col("rate")).alias("w")).toPandas()


def _boundaries(sample: pd.DataFrame, parts: int) -> np.ndarray:
    """The keys at the weighted quantiles 1/parts, 2/parts, ..."""
    if not len(sample) or parts < 2:
        return np.array([], "S32")
    keys = _keys(sample["h"].to_numpy(), sample["row"].to_numpy())
    order = np.argsort(keys)
    share = np.cumsum(sample["w"].to_numpy()[order])
    at = np.searchsorted(share, share[-1] * np.arange(1, parts) / parts)
    return np.unique(keys[order][np.minimum(at, len(keys) - 1)])


def _ranged(base: DataFrame, bounds: np.ndarray) -> DataFrame:
    sent = base.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def of(h: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sent.value, _keys(h.to_numpy(), row.to_numpy()), side="right").astype(np.int32))

    return base.withColumn("range", of("h", "row"))


def ranges(base: DataFrame) -> tuple[DataFrame, pd.DataFrame]:
    """``base`` has h, row and size. Returns it with ``range``, none of them
    overfull, and the exact rows and bytes of each range."""
    rows, total = base.agg(F.count(F.lit(1)), F.sum("size")).first()
    total = total or 0
    parts = max(LEAST_RANGES, -(-rows // RANGE_ROWS))
    bounds = _boundaries(_sample(base, f"{OVERSAMPLE * parts} * size / {max(total, 1)}"), parts)
    while True:
        ranged = _ranged(base, bounds)
        sums = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).toPandas().sort_values("range")
        full = sums[(sums["rows"] > 1) & ((sums["rows"] > OVERFULL * max(rows / parts, OVERSAMPLE)) | ((sums["bytes"] > OVERFULL * total / parts) & (sums["rows"] > OVERSAMPLE)))]
        if not len(full):
            return ranged, sums
        more = [bounds]
        for r in full.itertuples():
            pieces = int(max(r.rows * parts / rows, r.bytes * parts / total)) + 1
            more.append(_boundaries(_sample(ranged.where(F.col("range") == int(r.range)), f"{OVERSAMPLE * pieces} / {r.rows}"), pieces))
        grown = np.unique(np.concatenate(more))
        if len(grown) == len(bounds):  # a single record is larger than a range may be
            return ranged, sums
        bounds = grown


def assign(base: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``base`` with shard and slot."""
    ranged, sums = ranges(base)
    total = int(sums["bytes"].sum())
    sums["rows_before"], sums["bytes_before"] = sums["rows"].cumsum() - sums["rows"], sums["bytes"].cumsum() - sums["bytes"]
    before = base.sparkSession.createDataFrame([tuple(map(int, x)) for x in sums[["range", "rows_before", "bytes_before"]].itertuples(index=False)], "range int, rows_before long, bytes_before long")
    order = Window.partitionBy("range").orderBy("h", "row")
    placed = ranged.select("*", F.row_number().over(order).alias("n"), F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    placed = placed.join(F.broadcast(before), "range")  # one row a range
    # The shard in which the middle of the record lies.
    middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle / F.lit(2.0 * max(total, 1)) * shards)).cast("int"))
    placed = materialize(placed.withColumn("rank", F.col("rows_before") + F.col("n")).drop("range", "rows_before", "bytes_before", "n", "upto"), "shards")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("rank") - F.col("first")).drop("rank", "first")


def _base(docs: DataFrame, text: str, keep: list[str | Column]) -> DataFrame:
    t = whole(F.col(f"`{text}`"))
    return docs.select(*keep, (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("crc"), F.xxhash64(t).alias("h"), F.monotonically_increasing_id().alias("row"))


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, digest, law, shard and slot."""
    base = materialize(_base(docs, "text", ["doc_id"]), "sizes")
    return assign(base, shards).select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """The documents with ``_shard`` and ``_slot``, to be written with
    ``partitionBy("_shard")``."""
    all_rows = materialize(_base(docs, text, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")]), "rows")
    placed = assign(all_rows.select("size", "crc", "h", "row"), shards).select("row", "shard", "slot")
    both = all_rows.join(placed, "row")
    return both.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns], F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
