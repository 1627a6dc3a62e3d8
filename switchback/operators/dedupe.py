"""Duplicate places merged into one, with all tables that refer to them; merges of contributed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spatial import near_components


def duplicates(places: DataFrame, radius_m: float, max_lat: float = 80.0) -> DataFrame:
    """(id, keep): places (id, name, state, lat, lng) that a place of the same name and state replaces.

    Places no farther apart than the radius are the same, and so are chains of them; the smallest
    id stays. Names are compared trimmed and in lower case, empty ones are no names; null states
    are one state. A common name makes no pairs of all its places (see near_components).
    """
    name = F.lower(F.trim("name"))
    p = places.where((name != "") & F.col("lat").isNotNull() & F.col("lng").isNotNull()).select("id", name.alias("name"), F.coalesce("state", F.lit("")).alias("state"), "lat", "lng")
    return near_components(p, radius_m, ["name", "state"], max_lat).where("node <> root").select(F.col("node").alias("id"), F.col("root").alias("keep"))


def merged_places(places: DataFrame, dup: DataFrame, ids: str = "external_ids") -> DataFrame:
    """Places without duplicates; the map column `ids` of a place takes in those of its duplicates.

    Of one key the place's own value stays, else that of the duplicate with the largest id.
    """
    to = places.join(dup, "id", "left").withColumn("keep", F.coalesce("keep", "id"))
    entry = to.select("keep", "id", F.explode(ids).alias("k", "v"))
    best = entry.groupBy("keep", "k").agg(F.max_by("v", F.struct((F.col("id") == F.col("keep")).alias("own"), "id")).alias("v"))
    joined = best.groupBy("keep").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("__ids")).withColumnRenamed("keep", "id")
    stay = places.join(dup, "id", "left_anti").join(joined, "id", "left")
    return stay.select(*[F.coalesce("__ids", ids).alias(c) if c == ids else F.col(c) for c in places.columns])


def rekeyed(bridge: DataFrame, dup: DataFrame, parent: list[str], place: str = "destination_id") -> DataFrame:
    """Rows of a table that refers to places, moved from duplicates to the places that stay.

    Where rows meet under one (parent, place), the row that was there already wins, then that of
    the smallest duplicate; other columns come from the row that wins.
    """
    b = bridge.join(dup.select(F.col("id").alias(place), "keep"), place, "left").withColumn("__to", F.coalesce("keep", place))
    w = W.partitionBy(*parent, "__to").orderBy(F.col("keep").isNotNull(), place)
    one = b.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return one.select(*[F.col("__to").alias(c) if c == place else F.col(c) for c in bridge.columns])


# The columns that make two contributions the same.
SCOPE = ["source", "external_id", "original_start_date", "original_end_date", "fragment_start_date", "fragment_end_date"]


def merged_contributions(existing: DataFrame, incoming: DataFrame, key: str = "session_id") -> DataFrame:
    """Contributions (key, place, SCOPE, contribution_types, summary, ...) after incoming ones came in; place is their order.

    An incoming one with the scope of an existing one updates it: types are joined and sorted,
    other values are taken where they are set; the first of several existing ones of a scope is
    the one updated. Others are appended in order; several incoming ones of a scope are one.
    Missing scope values are one value. Places are numbered anew from 0.
    """
    cols = existing.columns
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.select(*cols).withColumn("__new", F.lit(1)))
    scope = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SCOPE]
    both = both.withColumn("__scope", F.struct(*[s.alias(c) for s, c in zip(scope, SCOPE, strict=True)]))
    order = W.partitionBy(key, "__scope").orderBy("__new", "place")
    both = both.withColumn("__n", F.row_number().over(order))
    alone = (F.col("__new") == 0) & (F.col("__n") > 1)
    both = both.withColumn("__g", F.when(alone, F.col("__n")).otherwise(1))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("__new", "place"))).alias(c)
    types = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("contribution_types", F.array().cast("array<string>")))))).alias("contribution_types")
    one = both.groupBy(key, "__scope", "__g").agg(F.min(F.struct("__new", "place")).alias("__at"), F.count(F.lit(1)).alias("__rows"), F.first("contribution_types").alias("__types"), types, *[last(c) for c in cols if c not in (key, "place", "contribution_types")])
    numbered = one.withColumn("place", (F.row_number().over(W.partitionBy(key).orderBy("__at")) - 1).cast(existing.schema["place"].dataType))
    kept = F.when(F.col("__rows") == 1, F.col("__types")).otherwise(F.col("contribution_types"))  # a contribution that nothing met stays as it is
    return numbered.withColumn("contribution_types", kept).select(*cols)


def merged_amenities(current: DataFrame, incoming: DataFrame, managed: list[str], deferring: list[str]) -> DataFrame:
    """Leaves (place_id, block, leaf, value, kind) after an import, each with its outcome.

    applied: the incoming leaf took the place; preserved: the current one is from a source that
    the importer doesn't manage; deferred: the incoming one is of a deferring kind and the current
    one isn't; kept: nothing came in. A current leaf without a kind is overwritten.
    """
    on = ["place_id", "block", "leaf"]
    old = current.select(*on, F.struct("value", "kind").alias("old"))
    new = incoming.select(*on, F.struct("value", "kind").alias("new"))
    got = old.join(new, on, "full")
    was, now = F.col("old.kind"), F.col("new.kind")
    known = F.col("old").isNotNull() & was.isNotNull()
    outcome = F.when(F.col("new").isNull(), "kept").when(known & ~was.isin(managed), "preserved").when(known & F.coalesce(now.isin(deferring), F.lit(False)) & ~was.isin(deferring), "deferred").otherwise("applied")
    got = got.withColumn("outcome", outcome)
    take = F.when(F.col("outcome") == "applied", F.col("new")).otherwise(F.col("old"))
    return got.select(*on, take["value"].alias("value"), take["kind"].alias("kind"), "outcome")


def id_backfills(matches: DataFrame, near_m: float = 30.0, named_m: float = 500.0) -> tuple[DataFrame, DataFrame]:
    """(selected, ambiguous) external ids for places without one, from matches (destination_id, name, external_id, ref_id, ref_name, distance_m, flags).

    A match is safe by an equal name within named_m, or within near_m without the flags of a
    subpeak or a generic name. One safe match is taken; of several the only one with an equal
    name; other places are ambiguous. Names come normalised; a place that has an id needs none.
    """
    m = matches.where("external_id is null and ref_id is not null and distance_m is not null").withColumn("same", F.coalesce(F.col("name") == F.col("ref_name"), F.lit(False)))
    doubt = F.arrays_overlap(F.coalesce("flags", F.array().cast("array<string>")), F.array(F.lit("possible_subpeak"), F.lit("generic_name")))
    m = m.where((F.col("same") & (F.col("distance_m") <= named_m)) | ((F.col("distance_m") <= near_m) & ~doubt))
    per = m.groupBy("destination_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("named"), F.max_by(F.struct("ref_id", "distance_m"), F.struct("same", "ref_id")).alias("x"))
    clear = (F.col("n") == 1) | (F.col("named") == 1)
    return per.where(clear).select("destination_id", F.col("x.ref_id").alias("ref_id"), F.col("x.distance_m").alias("distance_m")), per.where(~clear).select("destination_id")


def health_summary(heart: Column, calories: Column) -> Column:
    """Struct (average, maximum, active_calories) of arrays of heart rates and of calories: rounded, halves up; null where no value counts.

    Sums are of decimals, so that a half is one whatever the order of the values; values over 26 digits are added as doubles.
    """
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    rates = F.filter(heart, lambda v: finite(v) & (v > 0))
    burnt = F.filter(calories, lambda v: finite(v) & (v >= 0))
    exact = lambda a: F.aggregate(a, F.lit(0).cast("decimal(36,10)"), lambda s, v: F.try_add(s, v.try_cast("decimal(36,10)")).try_cast("decimal(36,10)"))
    total = lambda a: F.coalesce(exact(a).cast("double"), F.aggregate(a, F.lit(0.0), lambda s, v: s + v))
    whole = lambda v: F.floor(v + 0.5).cast("long")
    return F.struct(
        F.when(F.size(rates) > 0, whole(total(rates) / F.size(rates))).alias("average"),
        F.when(F.size(rates) > 0, whole(F.array_max(rates))).alias("maximum"),
        F.when(F.size(burnt) > 0, whole(total(burnt))).alias("active_calories"),
    )
