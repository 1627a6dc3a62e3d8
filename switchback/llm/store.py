"""Tables written to the folder that all executors and the driver share.

Every stage boundary of the operators is a Parquet table there, so a lost
executor costs a re-run of tasks and no lineage grows over iterations.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, with its scheme; a local one only for a local master, as in tests.

    A cluster that names none is refused: each machine would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        root = f"file://{tempfile.gettempdir()}/switchback-{spark.sparkContext.applicationId}"
    if ":" not in root.split("/")[0]:  # a path of the default file system, which tasks can't tell from a local one
        p = spark._jvm.org.apache.hadoop.fs.Path(root)
        root = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return root.rstrip("/")


BATCH_ROWS = 1000
BATCH_BYTES = 1 << 24


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS texts and BATCH_BYTES: with long texts Spark's defaults take much memory."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PARTITIONS = "spark.sql.shuffle.partitions"


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions of a shuffle of so many rows, about `each` a task: no more than the session's."""
    return max(1, min(int(spark.conf.get(PARTITIONS)), -(-rows // each)))


class Workspace:
    """A fresh folder under the shared root for one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def write(self, df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
        """Write a table and read it back; the shuffle files behind it go at once.

        tasks, if given, is the number of partitions of its shuffles.
        """
        want = {CLEANUP: "true"} | ({PARTITIONS: str(tasks)} if tasks else {})
        before = {k: self.spark.conf.get(k) for k in want}
        try:
            for k, v in want.items():
                self.spark.conf.set(k, v)
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.at(name))
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.at(name))
            p.getFileSystem(conf).delete(p, True)


def open_fs(uri: str):
    """(pyarrow file system, path) of a shared URI, for use inside a task."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
