import tempfile

from pyspark.sql import functions as F

from assaykit.plans import fixtures as fx
from assaykit.streaming.ingest import long_rows_stream, read_wide_stream

from .conftest import SF_SMALL


def test_stream_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="assaykit-stream-")
    raw = fx.wide_raw(spark, SF_SMALL)
    cols = [c for c in raw.columns if c != "source_row_index"]
    raw.select(*[F.col(f"`{c}`") for c in cols]).coalesce(1).write.parquet(f"{base}/in")
    q = long_rows_stream(read_wide_stream(spark, f"{base}/in", cols),
                         ["Ultrapure water", "1X DPBS", "DMSO", "Saline", "Lot note"],
                         f"{base}/out", f"{base}/ckpt")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{base}/out")
    from assaykit.plans.build import DatasetBuild
    want = DatasetBuild.from_tables(spark, SF_SMALL).long
    assert got.count() == want.count()
    assert got.groupBy("y").count().orderBy("y").collect() == want.groupBy("y").count().orderBy("y").collect()
