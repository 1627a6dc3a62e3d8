"""Areas: footprint shares, parents, rings from linework, replacement of routes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchback.functions import geo

from .spatial import box_cells
from .tracks import stitch

PARENT_SHARE = 0.9
LATTICE = 24


def footprint_share(child: str, parent: str, n: int = LATTICE) -> Column:
    """Share of a polygon's footprint inside another, on an n x n lattice of its box.

    An estimate: its standard error is under 1 / n of the share's spread. Cells whose centre is
    outside the child don't count; a child that no centre hits has no share.
    """
    ring = F.element_at(F.col(child), 1)
    lngs, lats = F.transform(ring, lambda p: p["lng"]), F.transform(ring, lambda p: p["lat"])
    at = lambda a, k: F.array_min(a) + (F.array_max(a) - F.array_min(a)) * (k + 0.5) / n
    cells = F.sequence(F.lit(0), F.lit(n * n - 1))
    inside = F.filter(cells, lambda k: geo.in_polygon(at(lats, F.floor(k / n)), at(lngs, k % n), child))
    both = F.filter(inside, lambda k: geo.in_polygon(at(lats, F.floor(k / n)), at(lngs, k % n), parent))
    return F.when(F.size(inside) > 0, F.size(both) / F.size(inside))


def parents(areas: DataFrame, parks: DataFrame, least: float = PARENT_SHARE, size_deg: float = 0.25) -> DataFrame:
    """(area_id, parent_id): the park with most of an area's footprint, if it has `least` of it; ties by id.

    Areas and parks have boxes and rings; boxes that share a cell meet by an equi-join.
    """
    a = box_cells(areas.select("area_id", "south", "north", "west", "east", "rings"), size_deg)
    p = box_cells(parks.select(F.col("area_id").alias("parent_id"), *[F.col(c).alias(c) for c in ("south", "north", "west", "east")]), size_deg).select("parent_id", "__row", "__col")
    pairs = a.select("area_id", "__row", "__col").join(p, ["__row", "__col"]).select("area_id", "parent_id").distinct().where("area_id <> parent_id")
    both = pairs.join(areas.select("area_id", "rings"), "area_id").join(parks.select(F.col("area_id").alias("parent_id"), F.col("rings").alias("park")), "parent_id")
    share = both.withColumn("share", footprint_share("rings", "park")).where(F.col("share") >= least)
    w = W.partitionBy("area_id").orderBy(F.desc("share"), "parent_id")
    return share.withColumn("n", F.row_number().over(w)).where("n = 1").select("area_id", "parent_id", "share")


def rings_from_lines(lines: DataFrame, join_m: float = 20.0, key: str = "lake_id") -> DataFrame:
    """Closed rings (key, ring) put together from pieces (key, seq, path) end to end; open chains are dropped.

    The order of joining matters within one lake, so a lake is one grouped call.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.array([(p["lat"], p["lng"]) for p in x], float) for x in pdf.sort_values("seq")["path"]]
        out = []
        for c in stitch(parts, join_m):
            gap = np.hypot((c[0][0] - c[-1][0]), (c[0][1] - c[-1][1]) * np.cos(np.radians(c[0][0]))) * geo.DEGREE_M
            if len(c) >= 4 and gap <= join_m:
                out.append({key: pdf[key].iloc[0], "ring": [{"lng": float(x), "lat": float(y)} for y, x in c]})
        return pd.DataFrame(out, columns=[key, "ring"])

    return lines.groupBy(key).applyInPandas(fold, f"{key} long, ring array<struct<lng:double,lat:double>>")


def settle_replacements(ledger: DataFrame, checks: DataFrame, live: DataFrame) -> DataFrame:
    """New states of a replacement ledger (old_id, new_id, state).

    A queued row is covered when its new route passes all checks; a covered row is retired
    when its old route is no longer live. Other rows stay as they are.
    """
    ok = checks.where("passes").select(F.col("route_id").alias("new_id"), F.lit(True).alias("ok"))
    on = live.select(F.col("route_id").alias("old_id"), F.lit(True).alias("on"))
    got = ledger.join(ok, "new_id", "left").join(on, "old_id", "left")
    state = F.when((F.col("state") == "queued") & F.col("ok"), "covered").when((F.col("state") == "covered") & F.col("on").isNull(), "retired").otherwise(F.col("state"))
    return got.select("old_id", "new_id", state.alias("state"))
