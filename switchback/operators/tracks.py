"""Ordered-track operators: windows where the rule is local, grouped pandas where it folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchback.functions import elevation, geo

# Spacing of samples; length and drift of a camp.
SAMPLE_M = 25.0
CAMP_GAP_S = 4 * 3600
CAMP_DRIFT_M = 500.0


def _track(order=("time", "event_id")):
    return W.partitionBy("session_id").orderBy(*order)


def altitude_time(points: DataFrame, thresholds: dict[str, float], max_gap_s: int = 60) -> DataFrame:
    """Seconds above each height; a crossing shares its interval by linear interpolation."""
    w = W.partitionBy("session_id").orderBy("time")
    p = points.select("session_id", "time", "segment_number", "elevation", F.lead("time").over(w).alias("t2"), F.lead("segment_number").over(w).alias("g2"), F.lead("elevation").over(w).alias("z2"))
    p = p.where((F.col("t2") > F.col("time")) & (F.col("t2") - F.col("time") <= max_gap_s) & (F.col("g2") == F.col("segment_number")) & F.col("elevation").isNotNull() & F.col("z2").isNotNull())
    secs, z, z2 = (F.col("t2") - F.col("time")).cast("double"), F.col("elevation"), F.col("z2")

    def share(t: float) -> Column:
        up = F.when((z > t) & (z2 > t), 1.0).when((z <= t) & (z2 > t), (z2 - t) / (z2 - z)).when((z > t) & (z2 <= t), (z - t) / (z - z2)).otherwise(0.0)
        return F.sum(secs * up)

    return p.groupBy("session_id").agg(*[share(t).alias(k) for k, t in thresholds.items()])


def cumulative_distance(points: DataFrame, reset_gap_s: int | None = None) -> DataFrame:
    """Adds step_m and total_m; the first point, and a point after a longer gap or in a new segment, adds nothing."""
    w = _track()
    lag = lambda c: F.lag(c).over(w)
    same = lag("segment_number") == F.col("segment_number")
    if reset_gap_s is not None:
        same = same & (F.col("time") - lag("time") <= reset_gap_s)
    step = F.when(same, geo.haversine_m(lag("lat"), lag("lng"), F.col("lat"), F.col("lng"))).otherwise(0.0)
    return points.withColumn("step_m", F.coalesce(step, F.lit(0.0))).withColumn("total_m", F.sum("step_m").over(w.rowsBetween(W.unboundedPreceding, 0)))


def lines(points: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """One line a group, vertices in time order; sort_array on a struct keeps the order whatever the shuffle."""
    v = F.sort_array(F.collect_list(F.struct("time", "event_id", "lng", "lat", "elevation")))
    path = F.transform(v, lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"), p["elevation"].alias("z")))
    return points.groupBy(*by).agg(path.alias("path"))


def elevation_gain(points: DataFrame, band: float = elevation.DEAD_BAND_M) -> DataFrame:
    """Gain and loss of each session's profile by reversals over the dead band."""
    g = elevation.gain_loss(F.transform("path", lambda p: p["z"]), band)
    return lines(points).select("session_id", g.alias("g")).select("session_id", F.col("g.gain").alias("gain"), F.col("g.loss").alias("loss"))


def mile_splits(points: DataFrame, mile_m: float = 1609.344) -> DataFrame:
    """Seconds of each full mile, with the time of a mark interpolated between points."""
    t = cumulative_distance(points)
    w = _track()
    t = t.select("session_id", "time", "total_m", F.lag("total_m", 1, 0.0).over(w).alias("m0"), F.lag("time").over(w).alias("t0"))
    marks = F.sequence(F.floor(F.col("m0") / mile_m) + 1, F.floor(F.col("total_m") / mile_m))
    crossed = t.where((F.col("total_m") > F.col("m0")) & (F.floor(F.col("total_m") / mile_m) > F.floor(F.col("m0") / mile_m))).withColumn("mile", F.explode(marks))
    at = F.col("t0") + (F.col("time") - F.col("t0")) * (F.col("mile") * mile_m - F.col("m0")) / (F.col("total_m") - F.col("m0"))
    first = points.groupBy("session_id").agg(F.min("time").cast("double").alias("start"))
    crossed = crossed.select("session_id", "mile", at.alias("at")).join(first, "session_id")
    before = F.coalesce(F.lag("at").over(W.partitionBy("session_id").orderBy("mile")), F.col("start"))
    return crossed.select("session_id", "mile", (F.col("at") - before).alias("seconds"))


def nearest_in_time(samples: DataFrame, marks: DataFrame) -> DataFrame:
    """For each mark (session_id, time) the sample (session_id, time, value) nearest in time; ties take the earlier.

    As-of from both sides over one union and one sort; no range join.
    """
    s = samples.select("session_id", "time", F.struct("time", "value").alias("hit"), F.lit(0).alias("mark"))
    m = marks.select("session_id", "time", F.lit(None).cast("struct<time:bigint,value:double>").alias("hit"), F.lit(1).alias("mark"))
    u = s.unionByName(m)
    back = W.partitionBy("session_id").orderBy("time", "mark").rowsBetween(W.unboundedPreceding, 0)
    fwd = W.partitionBy("session_id").orderBy("time", F.desc("mark")).rowsBetween(0, W.unboundedFollowing)
    u = u.withColumns({"a": F.last("hit", True).over(back), "b": F.first("hit", True).over(fwd)}).where("mark = 1")
    take = F.when(F.col("b").isNull() | (F.col("time") - F.col("a.time") <= F.col("b.time") - F.col("time")), F.col("a")).otherwise(F.col("b"))
    return u.select("session_id", "time", take.alias("x")).select("session_id", "time", F.col("x.time").alias("sample_time"), F.col("x.value").alias("value"))


def _haversine(lat1, lng1, lat2, lng2):
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * geo.EARTH_M * np.arcsin(np.sqrt(np.minimum(a, 1)))


def thinned(lat: np.ndarray, lng: np.ndarray, spacing: float = SAMPLE_M, ahead: int = 64) -> np.ndarray:
    """Indexes of points of which each is the next one out of reach of the last, and of the last point.

    Reach is 0.99 of the spacing; `ahead` points are looked at once.
    """
    n, at = len(lat), [0]
    lo = 1
    while lo < n:
        hi = min(lo + ahead, n)
        out = np.flatnonzero(_haversine(lat[at[-1]], lng[at[-1]], lat[lo:hi], lng[lo:hi]) >= 0.99 * spacing)
        if len(out):
            at.append(lo + int(out[0]))
        lo = at[-1] + 1 if len(out) else hi
    if n and at[-1] != n - 1:
        at.append(n - 1)
    return np.array(at[: max(n, 0)], np.int64)


def sampled(points: DataFrame, spacing: float = SAMPLE_M) -> DataFrame:
    """Thinned tracks: (session_id, time, lat, lng, elevation, speed, cum_m). Each sample depends on the one before, so grouped pandas."""

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["time", "event_id"])
        out = pdf.iloc[thinned(pdf["lat"].to_numpy(), pdf["lng"].to_numpy(), spacing)][["session_id", "time", "lat", "lng", "elevation", "speed"]].copy()
        lat, lng = out["lat"].to_numpy(), out["lng"].to_numpy()
        out["cum_m"] = np.concatenate([[0.0], np.cumsum(_haversine(lat[:-1], lng[:-1], lat[1:], lng[1:]))])
        return out

    return points.groupBy("session_id").applyInPandas(thin, "session_id long, time long, lat double, lng double, elevation double, speed double, cum_m double")


def import_stats(points: DataFrame) -> DataFrame:
    """Per session: points, metres, seconds, mean speed (null where no time passed). A gap between points counts as travelled."""
    w = _track()
    step = F.when(F.lag("lat").over(w).isNull(), 0.0).otherwise(geo.haversine_m(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng")))
    s = points.withColumn("m", step).groupBy("session_id").agg(F.count(F.lit(1)).alias("points"), F.sum("m").alias("metres"), (F.max("time") - F.min("time")).alias("seconds"))
    return s.withColumn("mean_mps", F.when(F.col("seconds") > 0, F.col("metres") / F.col("seconds")))


# Metres by a highest point, and how closed a track is and how well its ways match to be of a shape.
TOP_M = 20.0
CLOSED_SHARE = 0.05
MATCH_M = 100.0
MATCH_SAMPLES = 20


def phases(points: DataFrame) -> DataFrame:
    """(session_id, highest, ascent_s, still_s, descent_s): the time before, by and after the highest point.

    By it means from the first to the last point within TOP_M of it; of equal heights the first
    is the highest. The three add up to the whole time. Points without a height can't be it; a
    session without any has no row.
    """
    order = F.struct("time", "event_id")
    ends = points.groupBy("session_id").agg(F.min("time").alias("t0"), F.max("time").alias("t1"))
    z = F.when(F.col("elevation").isNotNull() & ~F.isnan("elevation"), F.struct("elevation", (-F.col("time")).alias("t"), (-F.col("event_id")).alias("e")))
    top = points.groupBy("session_id").agg(F.max_by(F.struct("lat", "lng", "elevation"), z).alias("top"), F.count(z).alias("n")).where("n > 0")
    near = points.join(top, "session_id").where((geo.haversine_m("lat", "lng", "top.lat", "top.lng") < TOP_M))
    at = near.groupBy("session_id").agg(F.first("top.elevation").alias("highest"), F.min_by("time", order).alias("a"), F.max_by("time", order).alias("b"))
    return at.join(ends, "session_id").select("session_id", "highest", (F.col("a") - F.col("t0")).alias("ascent_s"), (F.col("b") - F.col("a")).alias("still_s"), (F.col("t1") - F.col("b")).alias("descent_s"))


def shapes(points: DataFrame) -> DataFrame:
    """(session_id, shape, turn): out_and_back with the number of its turning point, loop, or point_to_point.

    A track that ends within CLOSED_SHARE of its length from its start is out and back if it has ten
    points and the way back from the farthest point, at MATCH_SAMPLES places by number, is MATCH_M
    from the way out on average or less, with some confidence; else a loop.
    """
    w = _track()
    m = F.when(F.lag("lat").over(w).isNotNull(), geo.haversine_m(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))).otherwise(0.0)
    t = points.select("session_id", "lat", "lng", (F.row_number().over(w) - 1).alias("i"), m.alias("m"))
    s = t.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("total"), F.min_by(F.struct("lat", "lng"), "i").alias("a"), F.max_by(F.struct("lat", "lng"), "i").alias("z"))
    closed = F.when(F.col("total") > 0, geo.haversine_m("a.lat", "a.lng", "z.lat", "z.lng") / F.col("total"))
    s = s.withColumn("ratio", closed)
    can = s.where((F.col("n") >= 10) & (F.col("ratio") < CLOSED_SHARE))
    far = t.join(can, "session_id").groupBy("session_id", "n", "ratio").agg(F.max_by("i", F.struct(geo.haversine_m("a.lat", "a.lng", "lat", "lng"), -F.col("i"))).alias("turn"))
    k = F.least(F.lit(MATCH_SAMPLES).cast("long"), F.col("turn") + 1, F.col("n") - F.col("turn"))
    each = far.withColumn("k", k).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    each = each.select("session_id", "n", "ratio", "turn", F.floor(F.col("j") / F.col("k") * (F.col("turn") + 1)).alias("out"), (F.col("n") - 1 - F.floor(F.col("j") / F.col("k") * (F.col("n") - F.col("turn")))).alias("back"))
    at = lambda c: t.select("session_id", F.col("i").alias(c), F.struct("lat", "lng").alias(f"p_{c}"))
    gap = each.join(at("out"), ["session_id", "out"]).join(at("back"), ["session_id", "back"]).groupBy("session_id", "ratio", "turn").agg(F.avg(geo.haversine_m("p_out.lat", "p_out.lng", "p_back.lat", "p_back.lng")).alias("gap"))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - F.col("ratio") / 0.1) * 0.5 + (1 - F.col("gap") / 200) * 0.5))
    back = gap.where((F.col("gap") < MATCH_M) & (sure > 0.5)).select("session_id", "turn")
    shape = F.when((F.col("n") < 4) | F.col("ratio").isNull() | (F.col("ratio") >= CLOSED_SHARE), "point_to_point").when(F.col("turn").isNotNull(), "out_and_back").otherwise("loop")
    return s.join(back, "session_id", "left").select("session_id", shape.alias("shape"), F.when(shape == "out_and_back", F.col("turn")).alias("turn"))


def coverage(points: DataFrame, routes: DataFrame, radius_m: float = 30.0, least: float = 0.7) -> DataFrame:
    """Routes (route_id, vertex, vlat, vlng) whose vertices a session's points cover: share of vertices in reach."""
    from .spatial import within_distance

    near = within_distance(points.select("session_id", "lat", "lng"), routes.select("route_id", "vertex", "vlat", "vlng"), radius_m, right_xy=("vlat", "vlng"))
    hit = near.groupBy("session_id", "route_id").agg(F.count_distinct("vertex").alias("hit"))
    total = routes.groupBy("route_id").agg(F.count_distinct("vertex").alias("vertices"))
    return hit.join(total, "route_id").withColumn("share", F.col("hit") / F.col("vertices")).where(F.col("share") >= least)


def camp_free_seconds(points: DataFrame) -> DataFrame:
    """Elapsed seconds of a session without overnight camps: long gaps in which it hardly moved."""
    w = _track()
    dt = F.col("time") - F.lag("time").over(w)
    d = geo.haversine_m(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    camp = F.when((dt >= CAMP_GAP_S) & (d <= CAMP_DRIFT_M), dt).otherwise(0)
    return points.select("session_id", "time", camp.alias("camp")).groupBy("session_id").agg((F.max("time") - F.min("time") - F.sum("camp")).alias("seconds"), F.sum("camp").alias("camp_seconds"))


def simplify(points: DataFrame, tolerance_m: float) -> DataFrame:
    """Douglas-Peucker line of each session: grouped, since the split points depend on each other."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["time", "event_id"]).reset_index(drop=True)
        lat, lng = pdf["lat"].to_numpy(), pdf["lng"].to_numpy()
        keep, todo = {0, len(pdf) - 1}, [(0, len(pdf) - 1)]
        k = np.cos(np.radians(lat.mean()))
        x, y = lng * k * geo.DEGREE_M, lat * geo.DEGREE_M
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            dx, dy = x[b] - x[a], y[b] - y[a]
            sq = dx * dx + dy * dy
            px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
            t = np.clip((px * dx + py * dy) / sq, 0, 1) if sq > 0 else 0.0
            d = np.hypot(px - t * dx, py - t * dy)
            i = int(d.argmax())
            if d[i] > tolerance_m:
                keep.add(a + 1 + i)
                todo += [(a, a + 1 + i), (a + 1 + i, b)]
        return pdf.iloc[sorted(keep)][["session_id", "time", "lat", "lng"]]

    return points.groupBy("session_id").applyInPandas(fold, "session_id long, time long, lat double, lng double")


def hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    """Discrete Hausdorff distance of two (n, 2) arrays of vertices, in their own unit."""
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    return float(max(d.min(axis=1).max(), d.min(axis=0).max()))


def stitch(parts: list[np.ndarray], join_m: float = 20.0) -> list[np.ndarray]:
    """Chains of (lat, lng) arrays joined end to end within join_m, turned where needed; first parts lead."""
    left = [p for p in parts if len(p)]
    out = []
    while left:
        chain = left.pop(0)
        grown = True
        while grown:
            grown = False
            for k, p in enumerate(left):
                for q in (p, p[::-1]):
                    if _haversine(*chain[-1], *q[0]) <= join_m:
                        chain, grown = np.concatenate([chain, q[1:] if (chain[-1] == q[0]).all() else q]), True
                    elif _haversine(*chain[0], *q[-1]) <= join_m:
                        chain, grown = np.concatenate([q[:-1] if (chain[0] == q[-1]).all() else q, chain]), True
                    if grown:
                        break
                if grown:
                    left.pop(k)
                    break
        out.append(chain)
    return out


def sub_line(line: Column, start_m: float, end_m: float) -> Column:
    """The part of a line between two distances from its start: vertices (m, lat, lng), the cut ends by interpolation.

    Distances beyond the line's ends are its ends; a line under two vertices gives an empty part.
    """
    legs = F.transform(geo.edges(line), lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), geo.haversine_m(e["a"]["lat"], e["a"]["lng"], e["b"]["lat"], e["b"]["lng"]).alias("m")))
    upto = lambda k: F.aggregate(F.slice(legs, 1, k), F.lit(0.0), lambda s, e: s + e["m"])
    placed = F.transform(legs, lambda e, k: F.struct(e["a"].alias("a"), e["b"].alias("b"), e["m"].alias("m"), upto(k).alias("at")))

    def point(e, m):
        f = F.when(e["m"] > 0, (m - e["at"]) / e["m"]).otherwise(0.0)
        return F.struct(m.alias("m"), *[(e["a"][c] + f * (e["b"][c] - e["a"][c])).alias(c) for c in ("lat", "lng")])

    kept = F.filter(placed, lambda e: (e["at"] + e["m"] >= start_m) & (e["at"] <= end_m))
    ends = F.transform(kept, lambda e: F.array(point(e, F.greatest(e["at"], F.lit(float(start_m)))), point(e, F.least(e["at"] + e["m"], F.lit(float(end_m))))))
    return F.array_distinct(F.flatten(ends))
