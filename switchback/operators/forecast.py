"""Forecast operators: sample cells, hour merges, strips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchback.functions import geo, times


def sample_cells(plans: DataFrame, places: DataFrame) -> DataFrame:
    """Distinct grid cells of plans: the first place (plan_id, ordinal, lat, lng), else the plan's own point."""
    w = W.partitionBy("plan_id").orderBy("ordinal", "lat", "lng")
    first = places.withColumn("n", F.row_number().over(w)).where("n = 1").select("plan_id", F.col("lat").alias("plat"), F.col("lng").alias("plng"))
    at = plans.join(first, "plan_id", "left").select(F.coalesce("plat", "lat").alias("lat"), F.coalesce("plng", "lng").alias("lng")).dropna()
    return at.select(geo.snap_cell("lat", "lng").alias("cell_key")).distinct()


def merge_hours(baseline: DataFrame, smoke: DataFrame, offset_hours: Column) -> DataFrame:
    """Per local day the highest value; smoke hours replace baseline hours. Inputs: place, hour (timestamp), value."""
    b = baseline.select("place", "hour", F.col("value").alias("b"))
    s = smoke.select("place", "hour", F.col("value").alias("s"))
    m = b.join(s, ["place", "hour"], "full").select("place", "hour", F.coalesce("s", "b").alias("value"), F.when(F.col("s").isNull(), "baseline").otherwise("smoke").alias("source"))
    m = m.where("value is not null").withColumn("day", F.to_date(times.local_time("hour", offset_hours)))
    out = m.groupBy("place", "day").agg(F.max("value").alias("top"), F.collect_set("source").alias("sources"), F.count(F.lit(1)).alias("hours"))
    return out.select("place", "day", "top", "hours", times.pm25_band("top").alias("band"), F.when(F.size("sources") == 2, "mixed").otherwise(F.element_at("sources", 1)).alias("source"))


def daily_strip(forecast: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """Seven days from today; a place and day without a forecast has nulls."""
    first = today
    all_days = forecast.select("place").distinct().withColumn("day", F.explode(F.sequence(first, F.date_add(first, days - 1))))
    return all_days.join(forecast, ["place", "day"], "left")
