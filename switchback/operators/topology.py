"""Simplified boundaries that still fit together: borders that areas share are cut out and simplified once.

1. A vertex where the rings that pass it don't all go to the same two neighbours is a junction;
2. rings are cut into arcs at junctions; an arc that several rings follow, either way, is one;
3. each arc is simplified by Douglas and Peucker's rule with the smallest tolerance that its areas
   ask for, its ends kept, so both sides of a border get the same line;
4. where simplified arcs cross, coincide, or a ring falls together, the tolerance of those arcs is
   halved and they are simplified again from their original; after ROUNDS they keep all vertices;
5. rings are put together again.

So neighbours have no gap and no overlap, and no border crosses another that it didn't cross before
(arcs that cross already in the original stay as they are). A task holds one ring or one arc.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import settled
from .overlay import pieces

POINT = "struct<lng:double,lat:double>"
# The tolerance is a share of an area's longer side, within limits in degrees.
SHARE, LEAST, MOST = 1500.0, 0.00005, 0.02
ROUNDS = 8
CELL_DEG = 0.05


def tolerance(rings: str) -> Column:
    """Degrees by which an area's boundary may be off: 1 / SHARE of its longer side, within limits."""
    ys = F.flatten(F.transform(F.col(rings), lambda r: F.transform(r, lambda p: p["lat"])))
    xs = F.flatten(F.transform(F.col(rings), lambda r: F.transform(r, lambda p: p["lng"])))
    side = F.greatest(F.array_max(ys) - F.array_min(ys), F.array_max(xs) - F.array_min(xs))
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), side / SHARE))


def thinned(line: np.ndarray, limit: float) -> np.ndarray:
    """Douglas and Peucker's choice of an (n, 2) line, ends kept; of a closed one also the vertex farthest from its start."""
    n = len(line)
    keep = np.zeros(n, bool)
    keep[[0, n - 1]] = True
    todo = [(0, n - 1)]
    if n > 3 and (line[0] == line[-1]).all():
        far = int(np.hypot(*(line - line[0]).T).argmax())
        keep[far] = True
        todo = [(0, far), (far, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, p = line[b] - line[a], line[a + 1 : b] - line[a]
        sq = d @ d
        t = np.clip(p @ d / sq, 0, 1) if sq else np.zeros(len(p))
        off = np.hypot(*(p - t[:, None] * d).T)
        k = int(off.argmax())
        if off[k] > limit:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[keep]


def _xy(points) -> np.ndarray:
    return np.array([(p["lng"], p["lat"]) for p in points], float).reshape(-1, 2)


def _points(line: np.ndarray) -> list[dict]:
    return [{"lng": x, "lat": y} for x, y in line.tolist()]


def _ring_vertices(areas: DataFrame, rings: str) -> DataFrame:
    """(area_id, ring, k, p, q): vertices of open rings without repeats, and the neighbour pair in a fixed order."""
    r = areas.select("area_id", F.posexplode(rings).alias("ring", "v"))
    same = lambda a, b: (a["lng"] == b["lng"]) & (a["lat"] == b["lat"])
    v = F.filter(F.col("v"), lambda p, i: (i == 0) | ~same(p, F.element_at("v", F.greatest(i, F.lit(1)))))
    r = r.withColumn("v", v).withColumn("v", F.when(same(F.element_at("v", 1), F.element_at("v", -1)), F.slice("v", 1, F.size("v") - 1)).otherwise(F.col("v"))).where(F.size("v") >= 3)
    n = F.size("v")
    around = F.transform(F.col("v"), lambda p, i: F.struct(p.alias("p"), F.array_sort(F.array(F.element_at("v", F.pmod(i - 1, n) + 1), F.element_at("v", F.pmod(i + 1, n) + 1))).alias("q")))
    return r.select("area_id", "ring", F.posexplode(around).alias("k", "x")).select("area_id", "ring", "k", "x.p", "x.q")


def arcs(areas: DataFrame, rings: str = "rings") -> tuple[DataFrame, DataFrame]:
    """(uses, arcs): uses has (area_id, ring, seq, arc, back), arcs has (arc, path); arc is a hash of its vertices."""
    v = settled(_ring_vertices(areas, rings))
    junction = v.groupBy("p").agg(F.count_distinct("q").alias("n")).select("p", (F.col("n") > 1).alias("cut"))
    w = F.array_sort(F.collect_list(F.struct("k", "p", "cut")))
    ring = v.join(junction, "p").groupBy("area_id", "ring").agg(w.alias("v"))

    def cut(batches):
        for pdf in batches:
            out = []
            for area, no, vs in zip(pdf["area_id"], pdf["ring"], pdf["v"], strict=True):
                xy = _xy([x["p"] for x in vs])
                at = [k for k, x in enumerate(vs) if x["cut"]]
                first = at[0] if at else int(np.lexsort((xy[:, 1], xy[:, 0]))[0])  # a ring by itself begins at its smallest vertex
                xy = np.concatenate([np.roll(xy, -first, axis=0), xy[first : first + 1]])
                ends = [*[k - first for k in at], len(xy) - 1] if at else [0, len(xy) - 1]
                for seq, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                    line = xy[a : b + 1]
                    back = tuple(map(tuple, line[::-1].tolist())) < tuple(map(tuple, line.tolist()))
                    out.append((area, no, seq, back, _points(line[::-1] if back else line)))
            yield pd.DataFrame({"area_id": [r[0] for r in out], "ring": [r[1] for r in out], "seq": [r[2] for r in out], "back": [r[3] for r in out], "path": pd.Series([r[4] for r in out], dtype=object)})

    kind = areas.schema["area_id"].dataType.simpleString()
    got = ring.mapInPandas(cut, f"area_id {kind}, ring int, seq int, back boolean, path array<{POINT}>")
    got = settled(got.withColumn("arc", F.sha2(F.to_json("path"), 256)))
    return got.select("area_id", "ring", "seq", "arc", "back"), got.groupBy("arc").agg(F.first("path").alias("path"))


def _simplified(lines: DataFrame) -> DataFrame:
    """(arc, path, limit) with `made`, the thinned path; a limit of 0 keeps all."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(made=pd.Series([_points(thinned(_xy(p), t)) if t > 0 else list(p) for p, t in zip(pdf["path"], pdf["limit"], strict=True)], index=pdf.index, dtype=object))

    return lines.mapInPandas(run, f"arc string, path array<{POINT}>, limit double, made array<{POINT}>")


def _edges(lines: DataFrame, path: str) -> DataFrame:
    n = F.size(path) - 1
    e = lines.select("arc", F.posexplode(F.zip_with(F.slice(path, 1, n), F.slice(path, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("k", "e"))
    return e.select("arc", "k", F.col("e.a.lng").alias("ax"), F.col("e.a.lat").alias("ay"), F.col("e.b.lng").alias("bx"), F.col("e.b.lat").alias("by"))


def crossing(lines: DataFrame, path: str, size: float = CELL_DEG) -> DataFrame:
    """(arc): arcs with an edge that crosses or equals another edge, of theirs or of another arc."""
    e = pieces(_edges(lines, path), size).drop("t0", "t1")
    other = e.select(*[F.col(c).alias(f"{c}_2") for c in ("arc", "k", "ax", "ay", "bx", "by")], "__row", "__col")
    a, b, c, d = ((F.col(x), F.col(y)) for x, y in (("ax", "ay"), ("bx", "by"), ("ax_2", "ay_2"), ("bx_2", "by_2")))
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    cross = (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)
    ends = lambda *of: F.array_sort(F.array(*[F.struct(p[0].alias("x"), p[1].alias("y")) for p in of]))
    pair = e.join(other, ["__row", "__col"]).where("arc < arc_2 or (arc = arc_2 and k < k_2)").where(cross | (ends(a, b) == ends(c, d)))
    return pair.select(F.explode(F.array("arc", "arc_2")).alias("arc")).distinct()


def simplified_areas(areas: DataFrame, rings: str = "rings", limit: Column | None = None) -> DataFrame:
    """(area_id, rings) of areas (area_id, rings), simplified together; rings are closed and keep their order.

    limit: degrees for each area, `tolerance` if not given. Rings under three vertices are left out.
    """
    uses, lines = arcs(areas, rings)
    limits = areas.select("area_id", (limit if limit is not None else tolerance(rings)).alias("limit"))
    per_arc = uses.join(limits, "area_id").groupBy("arc").agg(F.min("limit").alias("limit"))
    before = crossing(lines, "path").withColumn("limit", F.lit(0.0))
    start = lines.join(per_arc, "arc").join(before.withColumnRenamed("limit", "as_is"), "arc", "left")
    made = settled(_simplified(start.select("arc", "path", F.coalesce("as_is", "limit").alias("limit"))))
    for step in range(1, ROUNDS + 1):
        flat = uses.join(made.select("arc", F.size("made").alias("n")), "arc").groupBy("area_id", "ring").agg(F.sum(F.col("n") - 1).alias("n")).where("n < 3")
        small = uses.join(flat, ["area_id", "ring"], "left_semi").select("arc").distinct()
        bad = settled(crossing(made, "made").unionByName(small).distinct().join(made.where("limit > 0").select("arc"), "arc", "left_semi"))
        if bad.isEmpty():
            break
        shrink = F.lit(0.0) if step == ROUNDS else F.col("limit") / 2
        again = made.join(bad, "arc", "left_semi").select("arc", "path", shrink.alias("limit"))
        made = settled(made.join(bad, "arc", "left_anti").unionByName(_simplified(again)))
    part = uses.join(made.select("arc", "made"), "arc").select("area_id", "ring", "seq", F.when(F.col("back"), F.reverse("made")).otherwise(F.col("made")).alias("p"))
    whole = F.array_sort(F.collect_list(F.struct("seq", "p")))
    ring = part.groupBy("area_id", "ring").agg(whole.alias("w"))
    joined = F.flatten(F.transform("w", lambda x, i: F.when(i == 0, x["p"]).otherwise(F.slice(x["p"], 2, F.size(x["p"])))))
    return ring.select("area_id", "ring", joined.alias("r")).groupBy("area_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "r"))), lambda x: x["r"]).alias("rings"))
