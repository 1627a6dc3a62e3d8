"""Queries over a road graph made of parts: nodes on a grid, an edge east and one north of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchback.operators import graph, roads

from .composed import plan

STEP = 0.0145
WIDE = 40


def road_graph(spark, sf):
    """(edges, nodes, trailheads): ranks and lengths come from parts, trailheads from suppliers."""
    p = spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_partkey") - 1).alias("node"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    nodes = p.select("node", (46.0 + F.floor(F.col("node") / WIDE) * STEP).alias("lat"), (-115.0 + F.col("node") % WIDE * STEP).alias("lng"))
    rank = lambda k: F.when((F.col("size") * k) % 7 == 6, None).otherwise((F.col("size") * k) % 7 + 1).cast("int")
    ends = F.array(
        F.struct((F.col("node") * 2).alias("edge_id"), F.when(F.col("node") % WIDE < WIDE - 1, F.col("node") + 1).alias("to_node"), rank(1).alias("rank")),
        F.struct((F.col("node") * 2 + 1).alias("edge_id"), (F.col("node") + WIDE).alias("to_node"), rank(3).alias("rank")),
    )
    e = p.select(F.col("node").alias("from_node"), "size", "price", F.explode(ends).alias("x")).where("x.to_node is not null")
    e = e.join(nodes.select(F.col("node").alias("__to")).hint("merge"), F.col("x.to_node") == F.col("__to"), "left_semi")
    e = e.select("x.edge_id", "from_node", "x.to_node", "x.rank", (0.8 + (F.col("price") - 900) / 200).alias("miles"), ((F.col("size") == 50) & (F.col("x.edge_id") % 2 == 0)).alias("anchor"))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    s = spark.read.parquet(f"{sf}/supplier.parquet").crossJoin(F.broadcast(n)).select(F.col("s_suppkey").alias("origin"), (F.col("s_suppkey") * 37 % F.col("n")).alias("node"))
    off = F.when(F.col("origin") % 11 == 0, 0.5).otherwise(0.0)
    t = s.join(nodes.hint("merge"), "node").select("origin", (F.col("lat") + off * STEP + 0.0003).alias("lat"), (F.col("lng") + (0.25 + off / 5) * STEP).alias("lng"))
    return e, nodes, t


def snapped(e, nodes, t, radius_m: float = 250.0):
    """Trailheads with the nearest edge in reach, if there is one, and where on it."""
    at = lambda c: nodes.select(F.col("node").alias(c), F.struct("lng", "lat").alias(f"p_{c}")).hint("merge")
    lines = e.join(at("from_node"), "from_node").join(at("to_node"), "to_node").select("edge_id", F.array("p_from_node", "p_to_node").alias("path"))
    got = graph.snap(t, lines, radius_m, "origin", "edge_id").select("origin", "edge_id", F.col("fraction").alias("share"))
    return t.join(got, "origin", "left")


_SQL = f"""WITH RECURSIVE p AS (SELECT p_partkey - 1 AS node, p_size AS size, p_retailprice AS price FROM part), e0 AS (
    SELECT node * 2 AS edge_id, node AS a, node + 1 AS b, size % 7 AS r, size, price FROM p WHERE node % {WIDE} < {WIDE - 1} UNION ALL SELECT node * 2 + 1, node, node + {WIDE}, (size * 3) % 7, size, price FROM p),
    e AS (SELECT edge_id, a, b, CASE WHEN r = 6 THEN 7 ELSE r + 1 END AS rank, 8e-1 + (price - 900) / 200 AS miles, size = 50 AND edge_id % 2 = 0 AS anchor FROM e0 WHERE b IN (SELECT node FROM p)),
    w AS (SELECT edge_id, a, b, rank, miles FROM e UNION ALL SELECT edge_id, b, a, rank, miles FROM e), an AS (SELECT node, min(edge_id) AS anchor_edge FROM (SELECT a AS node, edge_id FROM e WHERE anchor UNION ALL SELECT b, edge_id FROM e WHERE anchor) x GROUP BY node),
    o AS (SELECT s_suppkey AS origin, s_suppkey * 37 % (SELECT count(*) FROM p) AS node, s_suppkey % 11 = 0 AS far FROM supplier),
    sn AS (SELECT o.origin, e.*, o.far FROM o LEFT JOIN e ON e.edge_id = o.node * 2 AND NOT o.far),
    lab(origin, top, node, miles, snap) USING KEY (origin, top, node) AS (
        SELECT origin, t, node, min(m), any_value(edge_id) FROM (SELECT origin, t, a AS node, miles * 25e-2 AS m, edge_id FROM sn, range(1, 8) r(t) WHERE NOT anchor AND rank <= t UNION ALL SELECT origin, t, b, miles * 75e-2, edge_id FROM sn, range(1, 8) r(t) WHERE NOT anchor AND rank <= t) x GROUP BY origin, t, node
        UNION SELECT n.origin, n.top, n.node, n.m, n.snap FROM (SELECT lab.origin, lab.top, w.b AS node, min(lab.miles + w.miles) AS m, any_value(snap) AS snap FROM lab JOIN w ON w.a = lab.node AND w.rank <= lab.top AND w.edge_id <> lab.snap
            WHERE lab.miles + w.miles <= 60 AND lab.node NOT IN (SELECT node FROM an) GROUP BY lab.origin, lab.top, w.b) n LEFT JOIN recurring.lab k ON k.origin = n.origin AND k.top = n.top AND k.node = n.node WHERE k.miles IS NULL OR n.m < k.miles - 1e-12),
    best AS (SELECT origin, top, min(miles) AS miles FROM lab JOIN an ON an.node = lab.node GROUP BY origin, top),
    one AS (SELECT origin, min(top) AS rank, arg_min(miles, top) AS miles FROM best GROUP BY origin)
    SELECT sn.origin, round(CASE WHEN anchor THEN 0e0 ELSE one.miles END, 6) AS miles, CASE WHEN anchor THEN sn.rank ELSE one.rank END AS worst,
        CASE WHEN sn.edge_id IS NULL THEN 'no_snap' WHEN NOT anchor AND one.rank IS NULL THEN 'no_anchor' WHEN CASE WHEN anchor THEN sn.rank ELSE one.rank END = 7 THEN 'unranked_path' WHEN CASE WHEN anchor THEN sn.rank ELSE one.rank END >= 5 THEN 'not_car_passable' END AS skip_reason
    FROM sn LEFT JOIN one ON one.origin = sn.origin"""


@plan(_SQL)
def approach_derivation(spark, sf):
    """Each trailhead's way to a maintained road: the least worst rank, then miles, or why there is no answer."""
    e, nodes, t = road_graph(spark, sf)
    o = snapped(e, nodes, t)
    paths = roads.approach_paths(o.where("edge_id is not null"), e, nodes)
    got = roads.approach_answers(o, paths)
    return got.join(paths.select("origin", F.col("rank").alias("worst")), "origin", "left").select("origin", F.round("miles", 6).alias("miles"), "worst", "skip_reason")

