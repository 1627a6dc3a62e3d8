"""Approach paths over a road graph: frontier rounds as joins, answers and reasons for none.

A path's cost is its worst vehicle rank, then its miles. A label is (origin, node, rank, miles);
of one origin and node only labels that no other beats in both are kept, at most one a rank, so
a detour that is gentler and one that is shorter are both followed and the bounds on miles and
distance lose no path. Each round extends the labels that the last one added by one edge, drops
what is dominated or can't beat the origin's best anchor, and is written; rounds end when none is
added. Edges meet the frontier by an equi-join on the node: no task holds a graph, and an origin
in a crowded region is as many rows as it has labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchback.functions import geo

from .graph import adjacency, settled

# What the ranks of vehicles say; a rank that isn't known counts as the last in a search.
VEHICLES = ["passenger_car", "high_clearance", "four_wheel_drive", "four_wheel_drive_high_clearance", "atv_only", "not_maintained"]
UNRANKED = 7
REACH_M = 40_000.0
MAX_MILES = 60.0
METRES_A_MILE = 1609.344


def measured(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (edge_id, from_node, to_node, rank, miles, anchor) whose missing miles are the straight distance of their nodes."""
    at = lambda n: nodes.select(F.col("node").alias(f"{n}_node"), F.col("lat").alias(f"{n}_lat"), F.col("lng").alias(f"{n}_lng")).hint("merge")
    e = edges.join(at("from"), "from_node", "left").join(at("to"), "to_node", "left")
    straight = geo.haversine_m("from_lat", "from_lng", "to_lat", "to_lng") / METRES_A_MILE
    return e.select("edge_id", "from_node", "to_node", "rank", F.coalesce("miles", straight).alias("miles"), F.coalesce("anchor", F.lit(False)).alias("anchor"))


def _least(labels: DataFrame) -> DataFrame:
    """Labels that no other of their origin and node beats in rank and miles; of equals the older, then the smaller edge."""
    w = W.partitionBy("origin", "node").orderBy("rank", "miles", F.desc("age"), "limiting")
    before = F.min("miles").over(w.rowsBetween(W.unboundedPreceding, -1))
    return labels.withColumn("__m", before).where(F.col("__m").isNull() | (F.col("miles") < F.col("__m"))).drop("__m")


def approach_paths(origins: DataFrame, edges: DataFrame, nodes: DataFrame, reach_m: float = REACH_M, max_miles: float = MAX_MILES) -> DataFrame:
    """Best path of each origin to an anchor edge: (origin, node, anchor_edge, rank, miles, limiting).

    origins: origin, lat, lng, edge_id (the snapped edge), share (of it, from its from_node);
    nodes: node, lat, lng. The way starts at both ends of the snapped edge, each at its share of
    the miles, and ends at a node with an anchor edge; an origin on an anchor edge is there
    already. limiting is the first edge from the origin with the worst rank; rank UNRANKED means
    that an edge of the best path has none. Nodes farther than reach_m from the origin in a
    straight line are not entered, the snapped edge is not driven again.
    """
    e = settled(measured(edges, nodes))
    rank = F.coalesce(F.col("rank"), F.lit(UNRANKED)).cast("int")
    snapped = origins.join(e, "edge_id").withColumn("rank", rank)
    here = snapped.where("anchor").select("origin", F.lit(None).cast("long").alias("node"), F.col("edge_id").alias("anchor_edge"), "rank", F.lit(0.0).alias("miles"), F.col("edge_id").alias("limiting"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("share")))
    ends = F.array(F.struct(F.col("from_node").alias("node"), (F.col("miles") * share).alias("miles")), F.struct(F.col("to_node").alias("node"), (F.col("miles") * (1 - share)).alias("miles")))
    start = snapped.where("not anchor").select("origin", F.col("lat").alias("olat"), F.col("lng").alias("olng"), F.col("edge_id").alias("snap"), "rank", F.col("edge_id").alias("limiting"), F.explode(ends).alias("x"))
    ways = e.where("from_node <> to_node").select("edge_id", "from_node", "to_node", rank.alias("edge_rank"), F.col("miles").alias("edge_miles"))
    ways = adjacency(ways).join(nodes.select(F.col("node").alias("to_node"), F.col("lat").alias("nlat"), F.col("lng").alias("nlng")).hint("merge"), "to_node")
    ways = settled(ways.withColumnRenamed("from_node", "node"))
    both = e.where("anchor").select("edge_id", F.explode(F.array("from_node", "to_node")).alias("node"))
    anchors = settled(both.groupBy("node").agg(F.min("edge_id").alias("anchor_edge")))
    cols = ["origin", "olat", "olng", "snap", "node", "rank", "miles", "limiting", "age"]
    labels = start.select("origin", "olat", "olng", "snap", F.col("x.node").alias("node"), "rank", F.col("x.miles").alias("miles"), "limiting", F.lit(0).alias("age")).where(F.col("miles") <= max_miles)
    labels = _least(labels).join(anchors, "node", "left").select(*cols, "anchor_edge")
    labels, age = settled(labels), 0
    best_of = lambda df: df.where("anchor_edge is not null").groupBy("origin").agg(F.min(F.struct("rank", "miles")).alias("best"))
    while True:
        front = labels.where((F.col("age") == age) & F.col("anchor_edge").isNull())
        if front.isEmpty():
            break
        age += 1
        go = front.join(ways, "node").where(F.col("edge_id") != F.col("snap"))
        go = go.where(geo.haversine_m("olat", "olng", "nlat", "nlng") <= reach_m).withColumn("miles", F.col("miles") + F.col("edge_miles")).where(F.col("miles") <= max_miles)
        limiting = F.when(F.col("edge_rank") > F.col("rank"), F.col("edge_id")).otherwise(F.col("limiting"))
        new = go.select("origin", "olat", "olng", "snap", F.col("to_node").alias("node"), F.greatest("rank", "edge_rank").alias("rank"), "miles", limiting.alias("limiting"), F.lit(age).alias("age"))
        new = new.groupBy("origin", "olat", "olng", "snap", "node", "rank", "age").agg(F.min(F.struct("miles", "limiting")).alias("x")).select(*cols[:6], "x.*", "age")
        new = new.join(anchors, "node", "left").select(*cols, "anchor_edge")
        all_labels = _least(labels.withColumn("age", -F.col("age")).unionByName(new.withColumn("age", -F.col("age")))).withColumn("age", -F.col("age"))
        cost = F.struct("rank", "miles")
        all_labels = all_labels.join(best_of(all_labels), "origin", "left").where(F.col("best").isNull() | (cost <= F.col("best"))).drop("best")
        labels = settled(all_labels)
    w = W.partitionBy("origin").orderBy("rank", "miles", "node")
    ended = labels.where("anchor_edge is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return here.unionByName(ended.select("origin", "node", "anchor_edge", "rank", "miles", "limiting"))


def vehicle(rank) -> Column:
    """The vehicle that a rank of 1 to 6 asks for; null for others."""
    return F.try_element_at(F.array(*map(F.lit, VEHICLES)), F.when(F.col(rank).between(1, len(VEHICLES)), F.col(rank)).otherwise(99))


def approach_answers(origins: DataFrame, paths: DataFrame) -> DataFrame:
    """One row an origin: vehicle, high_clearance, four_wheel_drive, miles, limiting, or the reason for no answer.

    Reasons: no_snap (no edge near it), no_anchor (no path in bounds), unranked_path (an edge
    without a rank on it), not_car_passable.
    """
    got = origins.select("origin", "edge_id").join(paths, "origin", "left")
    v = vehicle("rank")
    car = v.isin(*VEHICLES[:4])
    reason = F.when(F.col("edge_id").isNull(), "no_snap").when(F.col("rank").isNull(), "no_anchor").when(v.isNull(), "unranked_path").when(~car, "not_car_passable")
    clear = F.when(v == VEHICLES[0], "not_required").when(car, "required")
    four = F.when(v == VEHICLES[0], False).when(v.isin(*VEHICLES[2:4]), True)
    return got.select("origin", v.alias("vehicle"), clear.alias("high_clearance"), four.alias("four_wheel_drive"), "miles", "limiting", reason.alias("skip_reason"))
