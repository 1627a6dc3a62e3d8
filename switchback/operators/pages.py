"""What a viewer gets to see: their plans, reports and sessions, with nested parts, a page each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import settled

PLAN_PAGE, PLAN_MOST = 50, 250


def ordered_ids(bridge: DataFrame, key: str, value: str, order: list[str], name: str) -> DataFrame:
    """(key, name, name_count): an array of a bridge table's values in an order; nulls come last in it."""
    item = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"{c}_none"), F.col(c).alias(f"{c}_order"))], F.col(value).alias("__v"))
    ids = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["__v"])
    return bridge.groupBy(key).agg(ids.alias(name), F.count(F.lit(1)).alias(f"{name}_count"))


def visible(viewer: Column, owner: str = "user_id", public: str = "is_public") -> Column:
    """Whether a viewer may see a row: they own it or it is public; a null viewer sees public rows."""
    return F.coalesce(F.col(owner) == viewer, F.lit(False)) | F.coalesce(F.col(public), F.lit(False))


def masked(column: str, viewer: Column, owner: str = "user_id") -> Column:
    """A column's value for the row's owner, null for others."""
    return F.when(F.col(owner) == viewer, F.col(column))


def plan_pages(plans: DataFrame, parts: dict[str, DataFrame], party: DataFrame, limit: int = PLAN_PAGE, offset: int = 0) -> DataFrame:
    """(viewer, place, plan columns, ids and counts of each part and of the party): a page of every user's plans.

    A viewer sees plans that are theirs and those whose party they joined, newest update first,
    then by plan_id. parts: {value column: bridge (plan_id, value, ordinal)}; party: plan_id,
    user_id, joined_at. limit is 1 to PLAN_MOST, offset 0 or more; values outside are brought in.
    """
    limit, offset = max(1, min(limit, PLAN_MOST)), max(0, offset)
    seen = plans.select("plan_id", F.col("user_id").alias("viewer")).unionByName(party.select("plan_id", F.col("user_id").alias("viewer"))).distinct()
    w = W.partitionBy("viewer").orderBy(F.desc_nulls_last("updated_at"), "plan_id")
    page = seen.join(plans.select("plan_id", "updated_at"), "plan_id").withColumn("place", F.row_number().over(w)).where((F.col("place") > offset) & (F.col("place") <= offset + limit)).drop("updated_at")
    got = settled(page).join(plans, "plan_id")
    for value, bridge in parts.items():
        got = got.join(ordered_ids(bridge, "plan_id", value, ["ordinal", value], f"{value}s"), "plan_id", "left")
    got = got.join(ordered_ids(party, "plan_id", "user_id", ["joined_at", "user_id"], "party"), "plan_id", "left")
    empty = [c for c in got.columns if c in [*[f"{v}s" for v in parts], "party"]]
    counts = [f"{c}_count" for c in empty]
    fill = lambda c: F.coalesce(c, F.array().cast(got.schema[c].dataType)).alias(c) if c in empty else F.coalesce(c, F.lit(0).cast("long")).alias(c) if c in counts else F.col(c)
    return got.select("viewer", "place", *[fill(c) for c in got.columns if c not in ("viewer", "place")])


def reports(rows: DataFrame, sessions: DataFrame, nested: dict[str, tuple[DataFrame, dict[str, str], list[str]]], ids: dict[str, tuple[DataFrame, str]], viewer: Column) -> DataFrame:
    """Reports (report_id, session_id, user_id, ...) with JSON arrays of their parts, id lists, and whether the session is still there.

    nested: {name: (rows, {field: column}, order)}; ids: {name: (bridge, column)}, ascending. A
    report without parts has empty arrays.
    """
    from .documents import nested as documents

    got = rows.join(sessions.select(F.col("id").alias("session_id"), F.lit(True).alias("session_available")), "session_id", "left")
    got = got.withColumns({"session_available": F.coalesce("session_available", F.lit(False)), "is_owner": F.coalesce(F.col("user_id") == viewer, F.lit(False))})
    for name, (part, fields, order) in nested.items():
        got = got.join(documents(part, ["report_id"], fields, [F.asc(c) for c in order], name), "report_id", "left").withColumn(name, F.coalesce(name, F.lit("[]")))
    for name, (bridge, column) in ids.items():
        some = bridge.groupBy("report_id").agg(F.array_sort(F.collect_list(column)).alias(name))
        got = got.join(some, "report_id", "left").withColumn(name, F.coalesce(name, F.array().cast(some.schema[name].dataType)))
    return got


def list_members(members: DataFrame, routes: DataFrame, histogram: DataFrame) -> DataFrame:
    """Members (list_id, destination_id, ordinal) with their best route and their busiest months.

    routes: destination_id, route_id, completion, distance: the best has the highest completion,
    then the shortest distance, then the smallest id. histogram: destination_id, month, n: all
    months with the highest count, ascending.
    """
    best = routes.groupBy("destination_id").agg(F.min(F.struct((-F.col("completion")).alias("c"), "distance", "route_id")).alias("b")).select("destination_id", F.col("b.route_id").alias("best_route"), F.col("b.distance").alias("route_distance"))
    top = histogram.withColumn("m", F.max("n").over(W.partitionBy("destination_id"))).where("n = m and n > 0").groupBy("destination_id").agg(F.array_sort(F.collect_list("month")).alias("peak_months"))
    return members.join(best, "destination_id", "left").join(top, "destination_id", "left")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their number from 1 in an order, without one task for all: ranges are numbered by themselves and moved by the rows before them.

    Rows equal in all of `order` are numbered in any order among themselves.
    """
    dealt = settled(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")  # a row a partition
    at = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__at", at).join(F.broadcast(before), "__part").select(*df.columns, (F.col("__at") + F.col("__before")).alias(name))


def overlapping(a: DataFrame, b: DataFrame, on: list[str], width: float) -> DataFrame:
    """Rows of a (lo, hi) and b (lo2, hi2) of one group whose intervals share more than a point, by buckets of a width.

    An interval is copied to the buckets it touches; a pair is kept in the bucket where its shared
    part begins, so it comes out once and a group is as many join keys as it has buckets.
    """
    spread = lambda df, lo, hi: df.where(F.col(hi) > F.col(lo)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    got = spread(a, "lo", "hi").join(spread(b, "lo2", "hi2"), [*on, "__b"])
    start = F.greatest("lo", "lo2")
    return got.where((F.least("hi", "hi2") > start) & (F.col("__b") == F.floor(start / width))).drop("__b")
