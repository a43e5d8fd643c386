"""Session helpers: a configured local session for tests/bench and the
shared scratch folder (``spark.checkpoint.dir``) used to cut lineage."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "assaykit") -> SparkSession:
    """Local session for tests and the bench. On a cluster the caller's
    session (and its spark-defaults) is used as is."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    parts = shuffle_partitions or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ASSAYKIT_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide scratch folder named by ``spark.checkpoint.dir``.

    Read from the session; only when it is unset (local tests) a folder is
    created and registered, so checkpoints and scratch tables always land
    in the one place the cluster shares. On a cluster an unset folder is an
    error: a folder of the driver's own disk is not seen by executors."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # The setting is a static one; the folder is registered with the context, which is asked above.
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="assaykit-ckpt-"))
        d = spark.sparkContext.getCheckpointDir()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for an intermediate table."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/assaykit/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str):
    """Write ``df`` once to the shared folder and return the read-back.

    Used before iterative work (model fits read their input many times)
    and to cut long lineages: a lost executor then re-reads the table
    instead of recomputing the whole plan."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
