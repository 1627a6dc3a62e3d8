"""Nested documents and filters put together from optional parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nested(rows: DataFrame, key: list[str], fields: dict[str, str], order: list[Column], name: str) -> DataFrame:
    """One row a key with a JSON array of objects {field: column} in an order; a null field is left out of its object.

    The place in the order is a window's row number, so ties are the order's own business.
    """
    n = rows.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    item = F.struct("place", F.struct(*[F.col(c).alias(f) for f, c in fields.items()]).alias("item"))
    return n.groupBy(*key).agg(F.to_json(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"])).alias(name))


def all_of(parts: dict[str, Callable[[object], Column]], **values) -> Column:
    """The conjunction of the parts whose value is given and not None; no value gives true. An unknown name is an error."""
    out = F.lit(True)
    for name, value in values.items():
        if value is not None:
            out = out & parts[name](value)
    return out


def merged(old: Column, new: Column) -> Column:
    """Two maps as one, in which the new one's entries win; entries of null are removed."""
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.map_filter(F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), F.coalesce(new, F.create_map().cast("map<string,string>"))), lambda _, v: v.isNotNull())


def in_order(rows: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows of a list of keys, with their place in it, sorted by that; keys without a row are left out, a repeated key counts at its first place.

    The list comes from a caller, so it is small: a table of two columns, broadcast.
    """
    first = {v: k for k, v in reversed(list(enumerate(ids, 1)))}
    kind = rows.schema[key].dataType.simpleString()
    wanted = rows.sparkSession.createDataFrame([(v, k) for v, k in first.items()], f"{key} {kind}, place long")
    return rows.join(F.broadcast(wanted), key).select(*rows.columns, "place").orderBy("place")
