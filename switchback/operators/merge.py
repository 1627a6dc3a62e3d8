"""Writes as pure functions of tables: idempotent appends, latest-wins merges, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_new(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the batch whose key isn't in the target, once each."""
    return batch.dropDuplicates(key).join(target.select(*key), key, "left_anti")


def latest_wins(target: DataFrame, batch: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row a key: that of the newest version; the batch wins ties."""
    cols = target.columns
    rest = [c for c in cols if c not in key]
    both = target.withColumn("__new", F.lit(0)).unionByName(batch.select(*cols).withColumn("__new", F.lit(1)))
    best = both.groupBy(*key).agg(F.max(F.struct(F.col(version).alias("__v"), "__new", *[F.col(c).alias(f"v_{c}") for c in rest])).alias("x"))
    return best.select(*key, *[F.col(f"x.v_{c}").alias(c) for c in rest]).select(*cols)


def changed_only(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the batch that are new or differ from the target's in any column, nulls compared as values."""
    rest = [c for c in batch.columns if c not in key]
    old = target.select(*key, F.struct(*rest).alias("__old"), F.lit(True).alias("__has"))
    got = batch.join(old, key, "left")
    return got.where(F.col("__has").isNull() | ~F.struct(*rest).eqNullSafe(F.col("__old"))).select(*batch.columns)


def update_from(target: DataFrame, source: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Target with columns taken from the source where the key matches."""
    s = source.select(*key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    got = target.join(s, key, "left")
    return got.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def replace_auto(current: DataFrame, auto: DataFrame, rejected: DataFrame, key: list[str]) -> DataFrame:
    """Manual rows stay; automatic rows are those just computed, without rejected keys or keys of manual rows."""
    manual = current.where("source = 'manual'")
    fresh = auto.join(rejected.select(*key), key, "left_anti").join(manual.select(*key), key, "left_anti")
    return manual.unionByName(fresh.select(*current.columns))


def prune(df: DataFrame, time: str, now: Column, keep_s: int) -> DataFrame:
    return df.where(F.col(time) >= now - keep_s)


def merge_histograms(a: Column, b: Column) -> Column:
    """Sum of two counter maps by key; a missing map is an empty one."""
    empty = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def merge_samples(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Samples by key; an existing one wins."""
    cols = existing.columns
    rest = [c for c in cols if c not in key]
    both = existing.withColumn("__p", F.lit(0)).unionByName(incoming.select(*cols).withColumn("__p", F.lit(1)))
    return both.groupBy(*key).agg(F.min_by(F.struct(*rest), "__p").alias("x")).select(*key, "x.*").select(*cols)


def resolve_leaves(candidates: DataFrame, key: list[str]) -> DataFrame:
    """One candidate a leaf: the highest priority, then the latest date, then the source's name."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*key).orderBy(F.desc_nulls_last("priority"), F.desc_nulls_last("observed"), F.asc_nulls_last("source"))
    return candidates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def diff(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """added, removed, moved or same for every key of either side."""
    a = old.select(*key, F.col(order).alias("__a"), F.lit(True).alias("__in_a"))
    b = new.select(*key, F.col(order).alias("__b"), F.lit(True).alias("__in_b"))
    change = F.when(F.col("__in_a").isNull(), "added").when(F.col("__in_b").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "moved").otherwise("same")
    return a.join(b, key, "full").select(*key, change.alias("change"))


TRANSITIONS = {"idle": {"pending"}, "pending": {"processing"}, "processing": {"completed", "failed", "pending"}, "failed": {"pending"}, "completed": {"pending"}}


def can_move(state: Column, to: Column) -> Column:
    """Whether a job may go from one state to another."""
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in sorted(v)]))])
    return F.coalesce(F.array_contains(F.element_at(table, state), to), F.lit(False))


def stuck(jobs: DataFrame, now: Column, after_s: int = 600) -> DataFrame:
    """Pending jobs, and processing ones whose claim is older than after_s."""
    return jobs.where((F.col("state") == "pending") | ((F.col("state") == "processing") & (F.col("claimed") < now - after_s)))
