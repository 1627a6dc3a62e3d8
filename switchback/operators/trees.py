"""Nested documents level by level: every member with its path, and changes of single members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import settled

MOST_LEVELS = 100
MEMBER = "depth int, path string, member string, kind string, value string"


def kind(v: str) -> Column:
    """OBJECT, ARRAY, or the type of a scalar."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def walk(docs: DataFrame, key: str, document: str, most: int = MOST_LEVELS) -> DataFrame:
    """(key, depth, path, member, kind, value) of all members of JSON documents (key, document), array items too.

    path is like $.a[0].b, member the object key (null for an item), value a scalar's text. A level
    is one explode over all documents; levels end where none has members. A text that isn't JSON
    has none; documents deeper than `most` levels are an error, not cut.
    """
    spark = docs.sparkSession
    level = docs.select(F.col(key).alias("__id"), F.lit("$").alias("path"), F.try_parse_json(document).alias("v")).where("v is not null")
    out, depth = spark.createDataFrame([], f"{key} {docs.schema[key].dataType.simpleString()}, {MEMBER}"), 0
    while True:
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        inner = settled(inner.select("__id", F.concat("path", step).alias("path"), F.col("key").alias("member"), F.col("value").alias("v")))
        if inner.isEmpty():
            return out
        depth += 1
        if depth > most:
            raise ValueError(f"documents nested deeper than {most} levels")
        scalar = F.when(~kind("v").isin("OBJECT", "ARRAY"), F.try_variant_get("v", "$", "string"))
        out = out.unionByName(inner.select(F.col("__id").alias(key), F.lit(depth).alias("depth"), "path", "member", kind("v").alias("kind"), scalar.alias("value")))
        level = inner.where(kind("v").isin("OBJECT", "ARRAY")).select("__id", "path", "v")


def ancestors(nodes: DataFrame, node: str, parent: str, most: int = MOST_LEVELS) -> DataFrame:
    """(node, ancestor, depth): a row for each node and each of its parents, their parents and so on.

    Rounds of joins until no row has a parent; a ring of parents is an error.
    """
    up = settled(nodes.where(F.col(parent).isNotNull()).select(F.col(node).alias("__n"), F.col(parent).alias("__p")))
    level, depth, out = up.select(F.col("__n").alias("node"), F.col("__p").alias("ancestor")), 0, None
    while True:
        level = settled(level)
        depth += 1
        rows = level.select("node", "ancestor", F.lit(depth).alias("depth"))
        out = rows if out is None else out.unionByName(rows)
        if level.isEmpty():
            return out
        if depth > most:
            raise ValueError(f"parents nested deeper than {most} levels")
        level = level.join(up, F.col("ancestor") == F.col("__n")).select("node", F.col("__p").alias("ancestor"))


def with_member(document: Column, name: str, value: Column) -> Column:
    """A JSON object with one member set to a value (JSON text); a null value removes it, null documents count as empty."""
    old = F.from_json(F.coalesce(document, F.lit("{}")), "map<string,variant>")
    rest = F.map_filter(old, lambda k, _: k != name)
    new = F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), F.try_parse_json(value))))
    return F.to_json(new)


def without_nulls(document: Column) -> Column:
    """A JSON object without its members that are null; members inside members stay."""
    return F.to_json(F.map_filter(F.from_json(document, "map<string,variant>"), lambda _, v: v.isNotNull() & ~F.is_variant_null(v)))
