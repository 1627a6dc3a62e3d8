"""Session factory with the settings the engine expects."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; partitions only for local runs."""
    b = SparkSession.builder.appName("switchback")
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",  # small stages here are few bytes and much work
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        base["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach, named by spark.checkpoint.dir; a local one only for a local master.

    A cluster that names none is refused: each machine would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return (root or f"file://{tempfile.gettempdir()}/switchback-{spark.sparkContext.applicationId}").rstrip("/")
