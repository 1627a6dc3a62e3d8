"""Queries of merged places, nested documents, tile profiles, and shapes and phases of walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchback.operators import dedupe, raster, topology, tracks, trees

from .composed import _route_lines, hav, plan
from .fixtures import table
from .overlays import polygons
from .repeats import REP, walks

# duplicate places

_D = "d AS (SELECT id, name, state, lat, lng FROM destinations)"
_DUP = f"""{_D}, e AS (SELECT x.id AS a, y.id AS b FROM d x JOIN d y ON x.name = y.name AND x.state = y.state AND x.id <> y.id WHERE {hav('x.lat', 'x.lng', 'y.lat', 'y.lng')} <= 60000e0),
    w(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.node WHERE w.root < e.b), dup AS (SELECT node AS id, min(root) AS keep FROM w GROUP BY node HAVING min(root) < node)"""


def _dup(spark, sf):
    return dedupe.duplicates(table(spark, sf, "destinations").select("id", "name", "state", "lat", "lng"), 60_000.0, max_lat=50)


@plan(f"WITH RECURSIVE {_DUP} SELECT d.id, d.name, (SELECT count(*) FROM dup WHERE dup.keep = d.id) AS taken_in FROM d WHERE d.id NOT IN (SELECT id FROM dup)")
def merged_destinations(spark, sf):
    """Places of one name and state within 60 km are one; each takes in the external ids of its duplicates."""
    d = table(spark, sf, "destinations").select("id", "name", F.create_map(F.col("id").cast("string"), F.col("name")).alias("external_ids"))
    got = dedupe.merged_places(d, _dup(spark, sf))
    return got.select("id", "name", (F.size("external_ids") - 1).cast("long").alias("taken_in"))


@plan(f"""WITH RECURSIVE {_DUP} SELECT session_id, coalesce(keep, destination_id) AS destination_id, arg_min(relation, CASE WHEN keep IS NULL THEN -1 ELSE destination_id END) AS relation
    FROM session_destinations sd LEFT JOIN dup ON dup.id = sd.destination_id GROUP BY ALL""")
def rekeyed_session_destinations(spark, sf):
    """Sessions' places after the merge: no reference to a place that is gone, none twice."""
    return dedupe.rekeyed(table(spark, sf, "session_destinations").select("session_id", "destination_id", "relation"), _dup(spark, sf), ["session_id"])


# contributions and amenities


@plan("""SELECT l_orderkey AS session_id, l_shipmode_key AS external_id, CAST(array_to_string(list_sort(list(DISTINCT t)), ',') AS VARCHAR) AS types, arg_max(n, n) AS summary FROM (
    SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) AS l_shipmode_key, l_returnflag AS t, CAST(l_linenumber AS BIGINT) AS n FROM lineitem UNION ALL SELECT l_orderkey, CAST(l_suppkey AS VARCHAR), l_linestatus, CAST(l_linenumber AS BIGINT) FROM lineitem) x GROUP BY l_orderkey, l_shipmode_key""")
def contribution_merge(spark, sf):
    """Contributions of an order's lines by supplier: types joined, the newest summary taken."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    none = {c: F.lit(None).cast("string") for c in dedupe.SCOPE[2:]}
    c = li.select(F.col("l_orderkey").alias("session_id"), F.lit("lines").alias("source"), F.col("l_suppkey").cast("string").alias("external_id"), F.col("l_linenumber").cast("long").alias("place"), F.array("l_returnflag", "l_linestatus").alias("contribution_types"), F.col("l_linenumber").cast("long").alias("summary")).withColumns(none)
    first = c.groupBy("session_id", "source", "external_id", *dedupe.SCOPE[2:]).agg(F.min("place").alias("place"), F.lit(None).cast("array<string>").alias("contribution_types"), F.lit(None).cast("long").alias("summary"))
    got = dedupe.merged_contributions(first, c)
    return got.select("session_id", "external_id", F.array_join("contribution_types", ",").alias("types"), "summary")


@plan("""SELECT id AS place_id, leaf, CASE WHEN k IS NULL THEN 'kept' WHEN cur = 'human' THEN 'preserved' WHEN k = 'park' AND cur = 'forest' THEN 'deferred' ELSE 'applied' END AS outcome,
    CASE WHEN k IS NULL OR cur = 'human' OR (k = 'park' AND cur = 'forest') THEN 'old' ELSE 'new' END AS value FROM (SELECT id, leaf, CASE id % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'forest' ELSE 'park' END AS cur, CASE WHEN leaf = 'fee' THEN CASE WHEN size % 2 = 0 THEN 'park' ELSE 'forest' END END AS k FROM destinations, (VALUES ('fee'), ('water')) l(leaf)) x""")
def amenity_merge(spark, sf):
    """Leaves of places after an import: what another source wrote stays, a park's claim doesn't replace a forest's."""
    d = table(spark, sf, "destinations")
    kinds = F.when(F.col("id") % 3 == 0, "human").when(F.col("id") % 3 == 1, "forest").otherwise("park")
    cur = d.select(F.col("id").alias("place_id"), F.lit("access").alias("block"), F.explode(F.array(F.lit("fee"), F.lit("water"))).alias("leaf"), F.lit("old").alias("value"), kinds.alias("kind"))
    new = d.select(F.col("id").alias("place_id"), F.lit("access").alias("block"), F.lit("fee").alias("leaf"), F.lit("new").alias("value"), F.when(F.col("size") % 2 == 0, "park").otherwise("forest").alias("kind"))
    return dedupe.merged_amenities(cur, new, ["forest", "park"], ["park"]).select("place_id", "leaf", "outcome", "value")


@plan(f"""WITH m AS (SELECT d.id AS destination_id, d.name, r.id AS ref_id, r.name AS ref_name, d.name = r.name AS same, {hav('d.lat', 'd.lng', 'r.lat', 'r.lng')} AS m FROM destinations d JOIN (SELECT id, name, state, lat + (id % 5) * 1e-4 AS lat, lng FROM destinations) r ON abs(d.lat - r.lat) < 4e-2 AND abs(d.lng - r.lng) < 6e-2 WHERE d.id % 4 <> 0),
    s AS (SELECT * FROM m WHERE (same AND m <= 3000e0) OR m <= 300e0), g AS (SELECT destination_id, count(*) AS n, count(*) FILTER (same) AS named FROM s GROUP BY destination_id)
    SELECT g.destination_id, CASE WHEN n = 1 OR named = 1 THEN (SELECT arg_max(ref_id, (CASE WHEN same THEN 1 ELSE 0 END, ref_id)) FROM s WHERE s.destination_id = g.destination_id) END AS ref_id FROM g""")
def id_backfill(spark, sf):
    """External ids for places without one; null where several fit."""
    from switchback.operators.spatial import within_distance

    d = table(spark, sf, "destinations")
    p = d.select(F.col("id").alias("destination_id"), "name", F.when(F.col("id") % 4 == 0, "known").alias("external_id"), "lat", "lng")
    r = d.select(F.col("id").alias("ref_id"), F.col("name").alias("ref_name"), (F.col("lat") + (F.col("id") % 5) * 1e-4).alias("rlat"), F.col("lng").alias("rlng"))
    near = within_distance(p, r, 300.0, right_xy=("rlat", "rlng"), max_lat=50)
    named = within_distance(p, r, 3000.0, right_xy=("rlat", "rlng"), max_lat=50).where("name = ref_name and distance_m > 300")  # the name is a join key
    m = near.unionByName(named).withColumn("flags", F.array().cast("array<string>"))
    selected, unclear = dedupe.id_backfills(m, 300.0, 3000.0)
    return selected.select("destination_id", "ref_id").unionByName(unclear.select("destination_id", F.lit(None).cast("long").alias("ref_id")))


@plan("""SELECT user_id, CAST(floor(avg(value) FILTER (event_type = 'view' AND value > 0) + 5e-1) AS BIGINT) AS average, CAST(floor(max(value) FILTER (event_type = 'view' AND value > 0) + 5e-1) AS BIGINT) AS maximum,
    CAST(floor(sum(value) FILTER (event_type = 'click') + 5e-1) AS BIGINT) AS active_calories FROM events GROUP BY user_id""")
def session_health(spark, sf):
    """Average and highest heart rate and calories of a session, from its samples."""
    e = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(*[F.collect_list(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in ("view", "click")])
    return e.select("user_id", dedupe.health_summary(F.col("view"), F.col("click")).alias("h")).select("user_id", "h.*")


# nested documents

_DOC = "SELECT o_orderkey AS id, lines FROM (SELECT l_orderkey AS o_orderkey, list({'part': l_partkey, 'z': {'gain_m': l_linenumber, 'tags': [l_returnflag, l_linestatus]}} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS lines FROM lineitem GROUP BY l_orderkey) x"


@plan(f"""WITH RECURSIVE docs AS ({_DOC}), walk(id, depth, path, member, value) AS (SELECT id, 0, '$', CAST(NULL AS VARCHAR), CAST(to_json({{'lines': lines}}) AS JSON) FROM docs
    UNION ALL SELECT id, depth + 1, concat(path, step), k, v FROM (SELECT id, depth, path, concat('.', k) AS step, k, json_extract(value, concat('$."', k, '"')) AS v FROM (SELECT *, unnest(json_keys(value)) AS k FROM walk WHERE json_type(value) = 'OBJECT') o
        UNION ALL SELECT id, depth, path, concat('[', i, ']'), NULL, json_extract(value, concat('$[', i, ']')) FROM (SELECT *, unnest(range(0, CAST(json_array_length(value) AS BIGINT))) AS i FROM walk WHERE json_type(value) = 'ARRAY') a) x)
    SELECT id, depth, path, json_extract_string(value, '$') AS value FROM walk WHERE member IN ('gain_m', 'part')""")
def document_members(spark, sf):
    """Members of nested documents of orders, at any depth, whose key tells a height or a place."""
    item = F.struct(F.col("l_partkey").alias("part"), F.struct(F.col("l_linenumber").alias("gain_m"), F.array("l_returnflag", "l_linestatus").alias("tags")).alias("z"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    docs = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("x")))), lambda y: y["x"]).alias("lines"))
    got = trees.walk(docs.select("id", F.to_json(F.struct("lines")).alias("doc")), "id", "doc")
    return got.where(F.col("member").rlike("(?i)(gain|part)")).select("id", "depth", "path", "value")


@plan("""WITH RECURSIVE n AS (SELECT CONCAT('u', c_custkey) AS node, CONCAT('n', c_nationkey) AS parent FROM customer UNION ALL SELECT CONCAT('n', n_nationkey), CONCAT('r', n_regionkey) FROM nation UNION ALL SELECT CONCAT('r', r_regionkey), 'world' FROM region),
    up(node, ancestor, depth) AS (SELECT node, parent, 1 FROM n UNION ALL SELECT up.node, n.parent, depth + 1 FROM up JOIN n ON n.node = up.ancestor) SELECT node, ancestor, depth FROM up""")
def recursive_areas(spark, sf):
    """Every customer, nation and region with all that they lie in."""
    read = lambda name, a, b, c, d: spark.read.parquet(f"{sf}/{name}.parquet").select(F.concat(F.lit(a), F.col(b)).alias("node"), (F.concat(F.lit(c), F.col(d)) if d else F.lit(c)).alias("parent"))
    n = read("customer", "u", "c_custkey", "n", "c_nationkey").unionByName(read("nation", "n", "n_nationkey", "r", "n_regionkey")).unionByName(read("region", "r", "r_regionkey", "world", None))
    return trees.ancestors(n, "node", "parent")


# tiles


def _png(x: int, y: int) -> bytes:
    """A tile whose heights follow from its number and the pixel's."""
    import struct
    import zlib

    import numpy as np

    px, py = np.meshgrid(np.arange(256), np.arange(256))
    v = (((x * 256 + px) * 7 + (y * 256 + py) * 3) % 4000 + 32668) * 256 + 64
    rgb = np.stack([v >> 16, (v >> 8) & 255, v & 255], 2).astype(np.uint8).reshape(256, -1)
    raw = np.concatenate([np.zeros((256, 1), np.uint8), rgb], 1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 256, 256, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 1)) + part(b"IEND", b"")


_G = "SELECT route_id, seq, CAST(floor((lng + 180e0) / 360e0 * 4194304e0) AS BIGINT) AS gx, CAST(floor((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2e0 * 4194304e0) AS BIGINT) AS gy FROM (SELECT id AS route_id, k AS seq, lng + k * 1e-2 AS lng, lat + (k % 2) * 8e-3 AS lat FROM routes, range(0, 5) t(k)) p"


@plan(f"WITH g AS ({_G}) SELECT route_id, seq, CAST((gx * 7 + gy * 3) % 4000 - 100 AS DOUBLE) + 25e-2 AS z FROM g WHERE route_id NOT IN (SELECT route_id FROM g WHERE ((gx // 256) * 31 + gy // 256) % 17 = 0)")
def tile_profiles(spark, sf):
    """Heights of routes' vertices from tiles, each decoded once; routes over a tile that is missing have none."""
    import pandas as pd

    v = _route_lines(spark, sf).select("route_id", F.posexplode("path").alias("seq", "p")).select("route_id", F.col("seq").cast("long").alias("seq"), F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"))
    need = raster.pixels(v.select(F.struct("route_id", "seq").alias("k"), "lat", "lng"), "k", False).select("x", "y").distinct().where((F.col("x") * 31 + F.col("y")) % 17 != 0)

    def made(batches):
        for pdf in batches:
            yield pdf.assign(data=pd.Series([_png(int(x), int(y)) for x, y in zip(pdf["x"], pdf["y"], strict=True)], index=pdf.index, dtype=object))

    return raster.profile(v, need.mapInPandas(made, "x int, y int, data binary"))


# walks

_FAR = hav("a_lat", "a_lng", "lat", "lng")


@plan(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY time, event_id) - 1 AS k FROM {REP} r), a AS (SELECT session_id, count(*) AS n, arg_min(lat, k) AS a_lat, arg_min(lng, k) AS a_lng, arg_max(lat, k) AS z_lat, arg_max(lng, k) AS z_lng FROM t GROUP BY session_id),
    l AS (SELECT session_id, sum(m) AS total FROM (SELECT session_id, CASE WHEN lag(lat) OVER w IS NULL THEN 0e0 ELSE {hav('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')} END AS m FROM t WINDOW w AS (PARTITION BY session_id ORDER BY k)) x GROUP BY session_id),
    s AS (SELECT a.*, {hav('a_lat', 'a_lng', 'z_lat', 'z_lng')} / total AS ratio FROM a JOIN l USING (session_id)), f AS (SELECT session_id, n, ratio, k AS turn FROM (SELECT s.*, t.k, row_number() OVER (PARTITION BY s.session_id ORDER BY {_FAR} DESC, t.k) AS p FROM s JOIN t USING (session_id)) y WHERE p = 1),
    e AS (SELECT *, least(20, turn + 1, n - turn) AS c FROM f), j AS (SELECT e.session_id, ratio, turn, avg({hav('o.lat', 'o.lng', 'b.lat', 'b.lng')}) AS gap FROM e, range(0, 20) q(j) JOIN t o ON TRUE JOIN t b ON TRUE
        WHERE j < c AND o.session_id = e.session_id AND b.session_id = e.session_id AND o.k = floor(CAST(j AS DOUBLE) / c * (turn + 1)) AND b.k = n - 1 - floor(CAST(j AS DOUBLE) / c * (n - turn)) GROUP BY ALL)
    SELECT s.session_id, CASE WHEN n < 4 OR s.ratio >= 5e-2 THEN 'point_to_point' WHEN n >= 10 AND gap < 100 AND (1 - s.ratio / 1e-1) * 5e-1 + (1 - gap / 200) * 5e-1 > 5e-1 THEN 'out_and_back' ELSE 'loop' END AS shape,
        CASE WHEN n >= 10 AND s.ratio < 5e-2 AND gap < 100 AND (1 - s.ratio / 1e-1) * 5e-1 + (1 - gap / 200) * 5e-1 > 5e-1 THEN turn END AS turn FROM s LEFT JOIN j ON j.session_id = s.session_id""")
def walk_shapes(spark, sf):
    """Out and back with its turning point, loop, or point to point."""
    return tracks.shapes(walks(spark, sf))


@plan(f"""WITH t AS (SELECT * FROM {REP} r), top AS (SELECT session_id, lat AS a_lat, lng AS a_lng, elevation AS highest FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY elevation DESC, time, event_id) AS p FROM t) x WHERE p = 1),
    n AS (SELECT session_id, any_value(highest) AS highest, min(time) AS a, max(time) AS b FROM t JOIN top USING (session_id) WHERE {_FAR} < 20 GROUP BY session_id) SELECT n.session_id, highest, a - min(time) AS ascent_s, b - a AS still_s, max(time) - b AS descent_s FROM n JOIN t USING (session_id) GROUP BY n.session_id, highest, a, b""")
def walk_phases(spark, sf):
    """Seconds before, by and after the highest point."""
    return tracks.phases(walks(spark, sf))


@plan()
def area_display(spark, sf):
    """Boundaries for a map: simplified together, with a tolerance by their size."""
    got = topology.simplified_areas(polygons(spark, sf))
    return got.select("area_id", F.size("rings").alias("rings"), F.aggregate("rings", F.lit(0), lambda s, r: s + F.size(r)).alias("vertices"))
