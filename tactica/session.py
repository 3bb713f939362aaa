"""Session construction and cluster-level settings.

Everything here is plain SparkSession configuration. The library never
creates a session behind the caller's back: operators take DataFrames and
return DataFrames; only tests, the bench and the driver entry build one.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale as much as locally: adaptive execution
# (coalescing, skew-join splitting, runtime broadcast conversion) and UTC
# so timestamps compare equal to the DuckDB oracle.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "tactica", cpus: int | str | None = None,
              shuffle_partitions: int | None = None,
              driver_memory: str = "16g") -> SparkSession:
    """Local session for tests and the bench (a cluster passes its own)."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions",
                             str(shuffle_partitions or cpus))
    builder = builder.config("spark.driver.memory", driver_memory)
    event_dir = os.environ.get("TACTICA_EVENT_LOG_DIR")
    if event_dir:  # stage/task times for offline inspection (no UI, no server)
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` names a shared, fault-tolerant
    folder and is used as is. Only a local master, where driver and executors
    are one process, gets a scratch folder when nothing is configured; on a
    cluster the missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="tactica-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
