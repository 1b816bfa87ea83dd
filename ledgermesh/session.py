"""Spark session helpers.

Library operators never create a session; they take DataFrames. These helpers
exist for tests, the bench and the entry module. All timestamps in this
library are UTC wall-clock values, so the session time zone must be UTC.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(app: str = "ledgermesh", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return (or create) a session configured for this library.

    On a cluster, ``master`` stays unset so the launcher decides. AQE is on so
    shuffle partitions coalesce at runtime and skewed join partitions split.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):  # single JVM: the driver heap is the executor heap
            builder = builder.config("spark.driver.memory", os.environ.get("LEDGERMESH_DRIVER_MEMORY", "12g"))
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; set one only if unset.

    A local master falls back to a temporary folder (tests). Any other master
    must name a shared folder: executors cannot see the driver's disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ledgermesh-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
