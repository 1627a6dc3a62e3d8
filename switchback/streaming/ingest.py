"""Point ingest as a stream: idempotent append, reprocessing of touched sessions, session windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "2 days"
STORE_PARTS = 64  # folders of a batch in the store


def read_points(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduped(points: DataFrame, time: str = "ts", key: tuple[str, ...] = ("user_id", "ts"), late: str = LATE) -> DataFrame:
    """Each (session, time) once inside the watermark; state is bounded by it."""
    return points.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def windowed(points: DataFrame, time: str = "ts", window: str = "1 day", late: str = LATE) -> DataFrame:
    """Counts and sums by window and type."""
    return points.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_windows(points: DataFrame, time: str = "ts", gap: str = "12 hours", late: str = LATE) -> DataFrame:
    """Runs of a user's points with no gap over `gap`."""
    return points.withWatermark(time, late).groupBy("user_id", F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def reprocess_touched(points: DataFrame, store: str, result: str, recompute: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "user_id"):
    """foreachBatch: append the batch's new rows, then compute anew the sessions it touched.

    Late data only makes a session touched again. Rows are written under the batch's number, so
    a batch that is run again after a failure replaces what it wrote and adds nothing twice. The
    store has folders by a hash of the key: a batch opens those of its own sessions only, and
    rows of other sessions there go before duplicates are looked for.
    """

    def step(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("part", F.pmod(F.xxhash64(key), F.lit(STORE_PARTS)).cast("int"))
        batch.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{store}/batch={no}")
        written = spark.read.schema(batch.schema).parquet(f"{store}/batch={no}")
        touched = written.select(key, "part").distinct()
        parts = [r.part for r in touched.select("part").distinct().collect()]
        known = spark.read.schema(batch.schema).option("basePath", store).parquet(store).where(F.col("part").isin(parts))
        known = known.join(touched.select(key), key, "left_semi").drop("part", "batch").dropDuplicates([key, "ts"])
        recompute(known).withColumn("version", F.lit(no)).write.mode("overwrite").parquet(f"{result}/batch={no}")

    return points.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, result: str, key: list[str]) -> DataFrame:
    """The newest version of each key among the batches' results."""
    got = spark.read.option("basePath", result).parquet(result).drop("batch")
    newest = got.groupBy(*key).agg(F.max("version").alias("version"))
    return got.join(newest, [*key, "version"]).drop("version")


def delta_join(batch: DataFrame, static: DataFrame, on: list[str]) -> DataFrame:
    """What a batch of new rows matches in a table; the transition table of a statement trigger."""
    return batch.join(static, on)
