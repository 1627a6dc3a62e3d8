"""Places along a plan: its routes merged to one line, places in reach, numbered in the line's direction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchback.functions import geo

from .spatial import points_near_lines

POINT = "struct<lng:double,lat:double>"


def chain(parts: list[np.ndarray]) -> np.ndarray | None:
    """One line through all parts, (n, 2) arrays that meet at equal ends; it runs the way of the first part.

    None if they don't make one line: a gap, a fork, or a ring with more than itself. Parts
    under two vertices are left out.
    """
    left = [p for p in parts if len(p) > 1]
    if not left:
        return None
    ends: dict[tuple, list[int]] = {}
    for k, p in enumerate(left):
        for end in (p[0], p[-1]):
            ends.setdefault(tuple(end), []).append(k)
    if any(len(v) > 2 for v in ends.values()):
        return None
    line, used = left[0], {0}
    for ahead in (True, False):
        while True:
            at = tuple(line[-1] if ahead else line[0])
            nxt = [k for k in ends[at] if k not in used]
            if not nxt:
                break
            p = left[nxt[0]]
            used.add(nxt[0])
            if ahead:
                line = np.concatenate([line, (p if tuple(p[0]) == at else p[::-1])[1:]])
            else:
                line = np.concatenate([(p if tuple(p[-1]) == at else p[::-1])[:-1], line])
    return line if len(used) == len(left) else None


def merged_lines(parts: DataFrame, key: str, order: str, line: str = "path") -> DataFrame:
    """(key, piece, path, whole): the parts (key, order, line) of each key as one line; else one row a part, and whole is false.

    How parts join depends on all of one key, so a key is a grouped call: a plan's few routes, not
    a table. A key without a part of two vertices has no row.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        each = [p for p in (np.array([(p["lng"], p["lat"]) for p in x], float).reshape(-1, 2) for x in pdf[line] if x is not None) if len(p) > 1]
        got = chain(each)
        rows = [got] if got is not None else each
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(rows), "piece": range(len(rows)), "path": pd.Series([[{"lng": x, "lat": y} for x, y in r.tolist()] for r in rows], dtype=object), "whole": got is not None})

    kind = parts.schema[key].dataType.simpleString()
    return parts.select(key, order, line).groupBy(key).applyInPandas(fold, f"{key} {kind}, piece int, path array<{POINT}>, whole boolean")


def places_along(plans: DataFrame, places: DataFrame, max_lat: float = 80.0) -> DataFrame:
    """(plan_id, destination_id, ordinal, fraction): places within their reach of a plan's line, from 0 in its direction.

    plans: plan_id, user_id, piece, path, whole; places: destination_id, owner, features, lat, lng.
    A place of the catalogue ('peaks') counts for all, another for its owner's plans. Along lines
    that aren't whole the fraction is 0; ties go by destination_id. A place that a line passes
    twice counts at the nearer pass, the first of equals.
    """
    lines = plans.select(F.struct("plan_id", "piece").alias("line"), "path")
    near = points_near_lines(places.select("destination_id", "owner", "features", "lat", "lng"), lines, float(geo.MAX_REACH_M), "line", max_lat=max_lat)
    near = near.where(F.col("distance_m") <= geo.reach_radius_m(F.col("features"))).select(F.col("line.plan_id").alias("plan_id"), F.col("line.piece").alias("piece"), "destination_id", "owner", "fraction")
    got = near.join(plans.select("plan_id", "piece", "user_id", "whole").hint("merge"), ["plan_id", "piece"]).where((F.col("owner") == "peaks") | (F.col("owner") == F.col("user_id")))
    got = got.groupBy("plan_id", "destination_id").agg(F.min(F.when(F.col("whole"), F.col("fraction")).otherwise(0.0)).alias("fraction"))
    w = W.partitionBy("plan_id").orderBy("fraction", "destination_id")
    return got.select("plan_id", "destination_id", (F.row_number().over(w) - 1).alias("ordinal"), "fraction")
