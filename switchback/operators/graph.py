"""Graph operators: components, endpoint clusters, snapping and bounded best paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchback.functions import geo
from switchback.session import shared_folder

from .spatial import points_near_lines, within_distance


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the folder that the cluster names; a local one only where unset."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) with the smallest node of each component, by large-star and small-star rounds."""
    e = settled(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = settled(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now


def cluster_endpoints(points: DataFrame, radius_m: float) -> DataFrame:
    """Points (id, lat, lng) with their cluster's smallest id and its centroid; chains of close points are one cluster."""
    other = points.select(F.col("id").alias("id2"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    near = within_distance(points.select("id", "lat", "lng"), other, radius_m, right_xy=("lat2", "lng2")).where("id < id2")
    roots = components(near.select(F.col("id").alias("a"), F.col("id2").alias("b"))).withColumnRenamed("node", "id")
    got = points.join(roots, "id", "left").withColumn("cluster", F.coalesce("root", "id")).drop("root")
    centre = got.groupBy("cluster").agg(F.avg("lat").alias("node_lat"), F.avg("lng").alias("node_lng"), F.count(F.lit(1)).alias("members"))
    return got.join(centre, "cluster")


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; a loop once."""
    turned = {"from_node": "to_node", "to_node": "from_node"}
    return edges.unionByName(edges.where("from_node <> to_node").select(*[F.col(turned.get(c, c)).alias(c) for c in edges.columns]))


def node_edges(vertices: DataFrame, junctions: DataFrame, snap_m: float = 1.0) -> DataFrame:
    """Split edges (edge_id, seq, lat, lng) at their vertices closest to junctions (node_id, lat, lng).

    Adds node_id (null off junctions) and piece; a junction takes one vertex of an edge.
    """
    j = junctions.select("node_id", F.col("lat").alias("jlat"), F.col("lng").alias("jlng"))
    near = within_distance(vertices, j, snap_m, right_xy=("jlat", "jlng"))
    one = near.withColumn("__n", F.row_number().over(W.partitionBy("edge_id", "node_id").orderBy("distance_m", "seq"))).where("__n = 1").select("edge_id", "seq", "node_id")
    one = one.groupBy("edge_id", "seq").agg(F.min("node_id").alias("node_id"))
    w = W.partitionBy("edge_id").orderBy("seq")
    got = vertices.join(one, ["edge_id", "seq"], "left")
    inner = F.col("node_id").isNotNull() & F.lag("seq").over(w).isNotNull()
    return got.withColumn("__cut", inner.cast("int")).withColumn("piece", F.sum("__cut").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("__cut")).drop("__cut")


def snap(points: DataFrame, lines: DataFrame, radius_m: float, key: str, line_id: str) -> DataFrame:
    """The nearest line of each point inside the radius, with the fraction along it; ties by line id."""
    near = points_near_lines(points, lines, radius_m, line_id)
    return near.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy("distance_m", line_id))).where("__n = 1").drop("__n")


ALIKE_DEG = 0.003  # fixed values: how far two lines of one outing may be apart, and their starts
START_M = 10_000.0


def attempt_groups(bridge: DataFrame, least: int = 2, owner: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """(session_id, attempt_group): sessions of one user with `least` or more shared places, in components.

    With lines (session_id, path), a session that reached fewer than `least` places is tried by its
    line: against all of its user's that start within START_M, alike if the Hausdorff distance is
    below ALIKE_DEG. The group is its smallest session, so the order of matching doesn't matter.
    """
    from .overlay import hausdorff_within

    b = bridge.select("session_id", "destination_id").distinct()
    many = b.groupBy("session_id").agg(F.count(F.lit(1)).alias("places"))
    owners = owner if owner is not None else b.select("session_id").distinct().withColumn("user_id", F.lit(0))
    b = b.join(many.where(F.col("places") >= least).select("session_id"), "session_id", "left_semi").join(owners, "session_id")
    o = b.select(F.col("session_id").alias("s2"), "destination_id", "user_id")
    pairs = b.join(o, ["destination_id", "user_id"]).where("session_id < s2").groupBy("session_id", "s2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("session_id", "s2")
    if lines is not None:
        starts = lines.join(owners, "session_id").where(F.size("path") > 0).select("session_id", "user_id", F.element_at("path", 1).alias("p")).select("session_id", "user_id", F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"))
        few = starts.join(many, "session_id", "left").where(F.coalesce("places", F.lit(0)) < least).select(F.col("session_id").alias("b"), F.col("user_id").alias("user_b"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
        close = within_distance(starts.withColumnRenamed("session_id", "a"), few, START_M, right_xy=("lat2", "lng2")).where("user_id = user_b and a <> b").select("a", "b")
        pairs = pairs.unionByName(hausdorff_within(lines, settled(close), ALIKE_DEG, "session_id").select(F.col("a").alias("session_id"), F.col("b").alias("s2")))
    return components(pairs, "session_id", "s2").select(F.col("node").alias("session_id"), F.col("root").alias("attempt_group"))


def edge_length(df: DataFrame) -> DataFrame:
    """Adds share: an edge piece's part of its whole edge by planar length."""
    m = geo.equirectangular_m("lat1", "lng1", "lat2", "lng2")
    return df.withColumn("metres", m).withColumn("share", F.col("metres") / F.sum("metres").over(W.partitionBy("edge_id")))
