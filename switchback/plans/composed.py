"""Queries built from the operator library, each with a brute-force twin in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchback.functions import elevation, geo, text, times
from switchback.operators import graph, merge, spatial, tracks
from switchback.session import shared_folder

from .dialect import Duck
from .fixtures import table, with_views

COMPOSED: dict = {}
COMPOSED_SQL: dict[str, str] = {}
D = Duck()


def plan(sql: str | None = None):
    def add(f):
        COMPOSED[f.__name__] = f
        if sql is not None:
            COMPOSED_SQL[f.__name__] = with_views(D, sql)
        return f

    return add


def hav(a: str, b: str, c: str, d: str, r: str = "6371000e0") -> str:
    return f"(2 * {r} * asin(least(1e0, sqrt(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2)))))"


def grams(x: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), i, 3)))))"


def sim(a: str, b: str) -> str:
    return f"(len(list_intersect({grams(a)}, {grams(b)})) / CAST(len(list_distinct(list_concat({grams(a)}, {grams(b)}))) AS DOUBLE))"


# text search


@plan(f"SELECT id, round({sim('name', chr(39) + 'red wigdet' + chr(39))}, 6) AS score FROM destinations WHERE {sim('name', chr(39) + 'red wigdet' + chr(39))} >= 0.3")
def trigram_search(spark, sf):
    s = text.similarity("name", F.lit("red wigdet"))
    return table(spark, sf, "destinations").where(s >= text.SIMILAR).select("id", F.round(s, 6).alias("score"))


@plan(f"""SELECT id, round(score, 6) AS score FROM (SELECT id, {sim("name", "'small gadget'")} * 55e-2 + CASE WHEN lower(name) LIKE 'small gadget%' THEN 15e-2 ELSE 0e0 END + exp(-1e0 * {hav("lat", "lng", "45e0", "-119e0")} / 5e5) * 15e-2
    + least(coalesce(elevation, 0e0), 9e3) / 9e3 * 1e-1 + least(coalesce(prominence, 0e0), 9e3) / 9e3 * 5e-2 AS score, {sim("name", "'small gadget'")} AS s, name FROM destinations) x WHERE s >= 0.3 OR lower(name) LIKE 'small gadget%'""")
def destination_search_geo(spark, sf):
    d = table(spark, sf, "destinations")
    s = text.similarity("name", F.lit("small gadget"))
    hit = text.prefix_match("name", "small gadget")
    score = s * 0.55 + F.when(hit, 0.15).otherwise(0.0) + F.exp(-geo.haversine_m("lat", "lng", 45.0, -119.0) / 500000.0) * 0.15 + F.least(F.coalesce("elevation", F.lit(0.0)), F.lit(9000.0)) / 9000.0 * 0.10 + F.least(F.coalesce("prominence", F.lit(0.0)), F.lit(9000.0)) / 9000.0 * 0.05
    return d.where((s >= text.SIMILAR) | hit).select("id", F.round(score, 6).alias("score"))


@plan("""SELECT id, round(CASE WHEN regexp_matches(lower(name), '(^|[^a-z0-9])wi') THEN 6e-1 ELSE 0e0 END + CASE WHEN lower(name) LIKE 'wi%' THEN 15e-2 ELSE 0e0 END + CASE WHEN lower(name) = 'wi' THEN 1e-1 ELSE 0e0 END + least(coalesce(elevation, 0e0), 9e3) / 9e3 * 1e-1
    + least(coalesce(prominence, 0e0), 9e3) / 9e3 * 5e-2, 6) AS score FROM destinations WHERE regexp_matches(lower(name), '(^|[^a-z0-9])wi')""")
def destination_search_short(spark, sf):
    d = table(spark, sf, "destinations")
    score = F.lit(0.60) + F.when(text.prefix_match("name", "wi"), 0.15).otherwise(0.0) + F.when(F.lower("name") == "wi", 0.10).otherwise(0.0) + F.least(F.coalesce("elevation", F.lit(0.0)), F.lit(9000.0)) / 9000.0 * 0.10 + F.least(F.coalesce("prominence", F.lit(0.0)), F.lit(9000.0)) / 9000.0 * 0.05
    return d.where(text.token_prefix_match("name", "wi")).select("id", F.round(score, 6).alias("score"))


@plan(f"""SELECT kind, id, round(score, 6) AS score FROM (SELECT 'route' AS kind, id, {sim("name", "'Supplier 12'")} * 7e-1 + CASE WHEN lower(name) LIKE 'supplier 12%' THEN 2e-1 ELSE 0e0 END + least(coalesce(gain, 0e0), 3e3) / 3e3 * 5e-2 + least(coalesce(distance, 0e0), 5e4) / 5e4 * 5e-2 AS score FROM routes
    UNION ALL SELECT 'area', id, {sim("name", "'Supplier 12'")} * 7e-1 FROM areas) x""")
def mixed_search(spark, sf):
    r = table(spark, sf, "routes")
    s = text.similarity("name", F.lit("Supplier 12"))
    route = s * 0.7 + F.when(text.prefix_match("name", "supplier 12"), 0.2).otherwise(0.0) + F.least(F.coalesce("gain", F.lit(0.0)), F.lit(3000.0)) / 3000.0 * 0.05 + F.least(F.coalesce("distance", F.lit(0.0)), F.lit(50000.0)) / 50000.0 * 0.05
    a = table(spark, sf, "areas").select(F.lit("area").alias("kind"), F.col("id").cast("long").alias("id"), F.round(s * 0.7, 6).alias("score"))
    return r.select(F.lit("route").alias("kind"), "id", F.round(route, 6).alias("score")).unionByName(a)


@plan("SELECT id, CASE WHEN id % 2 = 0 THEN concat('mount ', lower(name), ' creek') ELSE concat('lake ', lower(name), ' north') END AS n FROM destinations")
def search_names(spark, sf):
    raw = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Mt "), "name", F.lit(" Crk"))).otherwise(F.concat(F.lit("LK  "), "name", F.lit(" North")))
    return table(spark, sf, "destinations").select("id", text.search_name(raw).alias("n"))


@plan("SELECT id, concat('eclat ', lower(replace(name, '-', ' ')), ' 7') AS n, 2e0 / 3e0 AS dice, TRUE AS contained FROM destinations")
def peak_names(spark, sf):
    d = table(spark, sf, "destinations")
    return d.select("id", text.peak_name(F.concat(F.lit("Éclat "), "name", F.lit(" #7"))).alias("n"), text.token_dice(F.lit("high rock"), F.lit("high rock tower peak")).alias("dice"), text.tokens_contained(F.lit("rock high"), F.lit("high rock peak")).alias("contained"))


@plan("SELECT id, concat('r-', substr(sha1(concat(CAST(id AS VARCHAR), '|', name)), 1, 16)) AS stable FROM destinations")
def stable_ids(spark, sf):
    return table(spark, sf, "destinations").select("id", text.stable_id("r-", "id", "name").alias("stable"))


# scalar geometry


@plan(f"""SELECT id, round({hav("lat", "lng", "45e0", "-119e0")}, 3) AS asin_m, round({hav("lat", "lng", "45e0", "-119e0")}, 3) AS atan2_m, round(sqrt(pow((-119e0 - lng) * 11132e1 * cos(radians((lat + 45e0) / 2)), 2) + pow((45e0 - lat) * 11132e1, 2)), 3) AS plane_m,
    round({hav("lat", "0e0", "45e0", "(-119e0 + 360e0 - lng) - 360e0")}, 3) AS wrapped_m FROM destinations""")
def distances(spark, sf):
    args = ("lat", "lng", 45.0, -119.0)
    return table(spark, sf, "destinations").select("id", F.round(geo.haversine_m(*args), 3).alias("asin_m"), F.round(geo.haversine_atan2_m(*args), 3).alias("atan2_m"), F.round(geo.equirectangular_m(*args), 3).alias("plane_m"), F.round(geo.haversine_wrapped_m("lat", "lng", 45.0, 241.0), 3).alias("wrapped_m"))


@plan("""SELECT id, concat(CAST(CAST(floor(lat / 3e-2 + 5e-1) AS BIGINT) AS VARCHAR), ':', CAST(CAST(floor(lng / 3e-2 + 5e-1) AS BIGINT) AS VARCHAR)) AS cell, CAST(floor((lng + 180e0) / 360e0 * 4096e0) AS INTEGER) AS tx,
    CAST(floor((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2e0 * 4096e0) AS INTEGER) AS ty FROM destinations""")
def cells_and_tiles(spark, sf):
    t = geo.tile("lat", "lng", 12)
    return table(spark, sf, "destinations").select("id", geo.snap_cell("lat", "lng").alias("cell"), t["x"].alias("tx"), t["y"].alias("ty"))


@plan("SELECT id, CASE WHEN list_contains(features, 'summit') THEN 30e0 WHEN list_contains(features, 'trailhead') THEN 100e0 WHEN list_contains(features, 'waterfall') THEN 200e0 ELSE 50e0 END AS reach FROM destinations")
def reach_radius(spark, sf):
    return table(spark, sf, "destinations").select("id", geo.reach_radius_m("features").alias("reach"))


@plan("SELECT event_id, CASE WHEN value <= 9e0 THEN 'good' WHEN value <= 354e-1 THEN 'moderate' WHEN value <= 554e-1 THEN 'unhealthy_sensitive' WHEN value <= 1254e-1 THEN 'unhealthy' WHEN value <= 2254e-1 THEN 'very_unhealthy' ELSE 'hazardous' END AS band FROM events")
def air_bands(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", times.pm25_band("value").alias("band"))


@plan("SELECT id, CASE WHEN id % 366 < 100 THEN 1 ELSE 0 END AS early, strftime(start_time, '%m') AS mm, CAST(floor(epoch(start_time) / 21600) * 21600 AS BIGINT) AS cycle, CAST(dayofyear(make_date(2024, month(start_time), day(start_time))) AS INTEGER) AS doy FROM sessions")
def calendar_fields(spark, sf):
    s = table(spark, sf, "sessions")
    ts = F.col("start_time").cast("timestamp")
    return s.select("id", F.when(F.col("id") % 366 < 100, 1).otherwise(0).alias("early"), F.date_format(ts, "MM").alias("mm"), F.unix_seconds(F.element_at(times.forecast_cycles(ts), 1)).alias("cycle"), times.day_of_year(F.month(ts), F.dayofmonth(ts)).alias("doy"))


@plan("SELECT id, 135 + id % 40 AS opens, 300 AS closes FROM destinations")
def season_windows(spark, sf):
    d = table(spark, sf, "destinations")
    w = F.array(F.struct((F.lit(135) + F.col("id").cast("int") % 40).alias("opens"), F.lit(10).alias("closes")), F.struct(F.lit(100).alias("opens"), F.lit(300).alias("closes")))
    return d.select("id", times.longest_window(times.season_intersection(w)).alias("w")).select("id", "w.opens", "w.closes")


# spatial joins


@plan(f"SELECT d.id, r.id AS route_id, round({hav('d.lat', 'd.lng', 'r.lat', 'r.lng')}, 3) AS metres FROM destinations d, routes r WHERE {hav('d.lat', 'd.lng', 'r.lat', 'r.lng')} <= 1500e0")
def distance_join(spark, sf):
    r = table(spark, sf, "routes").select(F.col("id").alias("route_id"), F.col("lat").alias("rlat"), F.col("lng").alias("rlng"))
    return spatial.within_distance(table(spark, sf, "destinations").select("id", "lat", "lng"), r, 1500.0, right_xy=("rlat", "rlng"), max_lat=50).select("id", "route_id", F.round("distance_m", 3).alias("metres"))


@plan(f"""SELECT id, route_id, round(m, 3) AS metres FROM (SELECT d.id, r.id AS route_id, {hav('d.lat', 'd.lng', 'r.lat', 'r.lng')} AS m, row_number() OVER (PARTITION BY d.id ORDER BY {hav('d.lat', 'd.lng', 'r.lat', 'r.lng')}, r.id) AS n FROM destinations d, routes r
    WHERE {hav('d.lat', 'd.lng', 'r.lat', 'r.lng')} <= 3000e0) x WHERE n <= 2""")
def nearest_candidates(spark, sf):
    r = table(spark, sf, "routes").select(F.col("id").alias("route_id"), F.col("lat").alias("rlat"), F.col("lng").alias("rlng"))
    got = spatial.nearest_within(table(spark, sf, "destinations").select("id", "lat", "lng"), r, 3000.0, "id", "route_id", 2, right_xy=("rlat", "rlng"), max_lat=50)
    return got.select("id", "route_id", F.round("distance_m", 3).alias("metres"))


@plan(f"SELECT id, round({hav('lat', 'lng', '45e0', '-119e0')}, 3) AS metres FROM destinations WHERE {hav('lat', 'lng', '45e0', '-119e0')} <= 20000e0 ORDER BY {hav('lat', 'lng', '45e0', '-119e0')}, id LIMIT 30")
def nearby_places(spark, sf):
    return spatial.nearby(table(spark, sf, "destinations"), 45.0, -119.0, 20000.0, 30).select("id", F.round("distance_m", 3).alias("metres"))


@plan(f"""SELECT id, round(rank, 9) AS rank FROM (SELECT id, coalesce(prominence, 100e0) / greatest(m, 500e0) AS rank FROM (SELECT *, {hav('lat', 'lng', '45e0', '-119e0')} AS m FROM destinations) y WHERE m <= 80000e0 AND elevation IS NOT NULL AND m <= 4123 * (sqrt(greatest(2e0, 0e0)) + sqrt(greatest(elevation, 0e0)))) x
    ORDER BY x.rank DESC, id LIMIT 30""")
def nearby_by_apparent_size(spark, sf):
    return spatial.nearby(table(spark, sf, "destinations"), 45.0, -119.0, 80000.0, 30, eye=2.0).select("id", F.round("rank", 9).alias("rank"))


@plan("SELECT d.id, a.id AS area_id FROM destinations d JOIN areas a ON d.lat BETWEEN a.south AND a.north AND d.lng BETWEEN a.west AND a.east")
def places_in_areas(spark, sf):
    a = table(spark, sf, "areas").select(F.col("id").alias("area_id"), "south", "north", "west", "east")
    return spatial.points_in_areas(table(spark, sf, "destinations").select("id", "lat", "lng"), a).select("id", "area_id")


def _triangles(spark, sf):
    p = lambda x, y: F.struct((F.col(x) + 0.00037).alias("lng"), (F.col(y) + 0.00041).alias("lat"))  # noqa: E731  no point lies on an edge
    a = table(spark, sf, "areas")
    return a.select(F.col("id").alias("area_id"), "south", "north", "west", "east", F.array(F.array(p("west", "south"), p("east", "south"), p("west", "north"))).alias("rings"))


@plan("SELECT d.id, a.id AS area_id FROM destinations d JOIN areas a ON d.lat > a.south + 41e-5 AND d.lng > a.west + 37e-5 AND (d.lng - a.west - 37e-5) / (a.east - a.west) + (d.lat - a.south - 41e-5) / (a.north - a.south) < 1e0 AND d.lat <= a.north AND d.lng <= a.east")
def places_in_polygons(spark, sf):
    return spatial.points_in_areas(table(spark, sf, "destinations").select("id", "lat", "lng"), _triangles(spark, sf), rings="rings").select("id", "area_id")


def _route_lines(spark, sf):
    r = table(spark, sf, "routes")
    v = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct((F.col("lng") + k * 0.01).alias("lng"), (F.col("lat") + (k % 2) * 0.008).alias("lat")))
    return r.select(F.col("id").alias("route_id"), v.alias("path"))


_EDGE = """(SELECT id AS route_id, k, lat + (k % 2) * 8e-3 AS alat, lng + k * 1e-2 AS alng, lat + ((k + 1) % 2) * 8e-3 AS blat, lng + (k + 1) * 1e-2 AS blng FROM routes, range(0, 4) t(k))"""


@plan(f"""SELECT id, route_id, round(min(m), 3) AS metres FROM (SELECT id, route_id, sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)) AS m FROM (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0e0, least(1e0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) ELSE 0e0 END AS t FROM
    (SELECT d.id, e.route_id, (e.alng - d.lng) * 11132e1 * cos(radians(d.lat)) AS ax, (e.alat - d.lat) * 11132e1 AS ay, (e.blng - e.alng) * 11132e1 * cos(radians(d.lat)) AS dx, (e.blat - e.alat) * 11132e1 AS dy FROM destinations d, {_EDGE} e) a) b) c GROUP BY id, route_id HAVING min(m) <= 400e0""")
def places_near_route_lines(spark, sf):
    got = spatial.points_near_lines(table(spark, sf, "destinations").select("id", "lat", "lng"), _route_lines(spark, sf), 400.0, "route_id", max_lat=50)
    return got.select("id", "route_id", F.round("distance_m", 3).alias("metres"))


@plan()
def line_near_line(spark, sf):
    a = _route_lines(spark, sf)
    return spatial.lines_near_lines(a.where("route_id % 2 = 0"), a.where("route_id % 2 = 1").withColumnRenamed("route_id", "other_id"), "route_id", "other_id", 12000.0, max_lat=50)


@plan()
def catalog_reference_match(spark, sf):
    d = table(spark, sf, "destinations")
    r = d.select(F.col("id").alias("ref_id"), F.when(F.col("id") % 10 == 0, F.col("id")).alias("ref_ext"), F.col("name").alias("ref_name"), (F.col("lat") + 0.001).alias("ref_lat"), F.col("lng").alias("ref_lng"))
    c = d.select("id", F.col("id").alias("ext"), "name", "lat", "lng")
    return spatial.reference_match(r, c).select("ref_id", "id", "kind")


@plan(f"SELECT id FROM destinations d WHERE NOT EXISTS (SELECT 1 FROM routes r WHERE {hav('d.lat', 'd.lng', 'r.lat', 'r.lng')} <= 2000e0)")
def places_far_from_routes(spark, sf):
    r = table(spark, sf, "routes").select(F.col("lat").alias("rlat"), F.col("lng").alias("rlng"))
    d = table(spark, sf, "destinations").select("id", "lat", "lng")
    return spatial.far_from(d, r, 2000.0, "id", right_xy=("rlat", "rlng"), max_lat=50).select("id")


@plan()
def name_proximity_dedupe(spark, sf):
    return spatial.greedy_name_dedupe(table(spark, sf, "destinations").select("id", "name", "lat", "lng"), 20000.0)


# tracks


@plan(f"""SELECT session_id, round(sum(CASE WHEN s = segment_number THEN {hav('a', 'b', 'lat', 'lng')} ELSE 0e0 END), 3) AS metres FROM (SELECT *, lag(lat) OVER w AS a, lag(lng) OVER w AS b, lag(segment_number) OVER w AS s FROM points WINDOW w AS (PARTITION BY session_id ORDER BY time, event_id)) x GROUP BY session_id""")
def track_distance(spark, sf):
    return tracks.cumulative_distance(table(spark, sf, "points")).groupBy("session_id").agg(F.round(F.sum("step_m"), 3).alias("metres"))


@plan("""WITH d AS (SELECT session_id, time, event_id, elevation - lag(elevation) OVER w AS dz FROM points WINDOW w AS (PARTITION BY session_id ORDER BY time, event_id)),
    n AS (SELECT * FROM d WHERE dz <> 0), s AS (SELECT *, CASE WHEN sign(dz) = lag(sign(dz)) OVER (PARTITION BY session_id ORDER BY time, event_id) THEN 0 ELSE 1 END AS turn FROM n),
    r AS (SELECT *, sum(turn) OVER (PARTITION BY session_id ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM s), t AS (SELECT session_id, run, sum(dz) AS dz FROM r GROUP BY session_id, run)
    SELECT session_id, round(sum(CASE WHEN dz > 4 THEN dz ELSE 0e0 END), 3) AS gain, round(sum(CASE WHEN dz < -4 THEN -dz ELSE 0e0 END), 3) AS loss FROM t GROUP BY session_id""")
def gain_by_reversals(spark, sf):
    return tracks.elevation_gain(table(spark, sf, "points")).select("session_id", F.round("gain", 3).alias("gain"), F.round("loss", 3).alias("loss"))


@plan()
def gain_smoothed(spark, sf):
    g = elevation.smoothed_stats(F.transform("path", lambda p: p["z"]))
    return tracks.lines(table(spark, sf, "points")).select("session_id", g.alias("g")).select("session_id", F.round("g.gain", 3).alias("gain"), F.round("g.loss", 3).alias("loss"), F.round("g.max", 3).alias("top"))


@plan()
def gain_anchored(spark, sf):
    return tracks.lines(table(spark, sf, "points")).select("session_id", F.round(elevation.anchored_gain(F.transform("path", lambda p: p["z"])), 3).alias("gain"))


@plan()
def mile_splits(spark, sf):
    return tracks.mile_splits(table(spark, sf, "points")).select("session_id", "mile", F.round("seconds", 2).alias("seconds"))


@plan("""SELECT session_id, time, sample_time, value FROM (SELECT m.user_id AS session_id, CAST(floor(epoch(m.ts)) AS BIGINT) AS time, CAST(floor(epoch(s.ts)) AS BIGINT) AS sample_time, s.value, row_number() OVER (PARTITION BY m.event_id ORDER BY abs(floor(epoch(m.ts)) - floor(epoch(s.ts))), s.ts) AS n
    FROM events m JOIN events s ON s.user_id = m.user_id AND s.event_type = 'view' WHERE m.event_type = 'purchase') x WHERE n = 1""")
def nearest_sample_in_time(spark, sf):
    p = table(spark, sf, "points")
    got = tracks.nearest_in_time(p.where("event_type = 'view'"), p.where("event_type = 'purchase'"))
    return got.where("sample_time is not null")


@plan("""WITH o AS (SELECT session_id, time, segment_number, elevation AS z, lead(time) OVER w AS t2, lead(segment_number) OVER w AS g2, lead(elevation) OVER w AS z2 FROM points WINDOW w AS (PARTITION BY session_id ORDER BY time, event_id)),
    v AS (SELECT session_id, CAST(t2 - time AS DOUBLE) AS s, z, z2 FROM o WHERE t2 > time AND t2 - time <= 60 AND g2 = segment_number AND z IS NOT NULL AND z2 IS NOT NULL)
    SELECT session_id, round(sum(s * CASE WHEN z > 3e3 AND z2 > 3e3 THEN 1e0 WHEN z <= 3e3 AND z2 > 3e3 THEN (z2 - 3e3) / (z2 - z) WHEN z > 3e3 AND z2 <= 3e3 THEN (z - 3e3) / (z - z2) ELSE 0e0 END), 2) AS above_3000_m FROM v GROUP BY session_id""")
def altitude_seconds(spark, sf):
    """Time above a height with the rule's gap of a minute."""
    return tracks.altitude_time(table(spark, sf, "points"), {"above_3000_m": 3000.0}).select("session_id", F.round("above_3000_m", 2).alias("above_3000_m"))


@plan(f"""WITH s AS (SELECT session_id, time, event_id, lat, lng, CASE WHEN lag(lat) OVER w IS NULL THEN 0e0 ELSE {hav("lag(lat) OVER w", "lag(lng) OVER w", "lat", "lng")} END AS m FROM points WINDOW w AS (PARTITION BY session_id ORDER BY time, event_id))
    SELECT session_id, count(*) AS points, round(sum(m), 2) AS metres, max(time) - min(time) AS seconds, round(CASE WHEN max(time) > min(time) THEN sum(m) / (max(time) - min(time)) END, 4) AS mean_mps FROM s GROUP BY session_id""")
def session_import_stats(spark, sf):
    return tracks.import_stats(table(spark, sf, "points")).select("session_id", "points", F.round("metres", 2).alias("metres"), "seconds", F.round("mean_mps", 4).alias("mean_mps"))


@plan("""WITH n AS (SELECT sd.session_id, sd.destination_id, d.name, d.elevation, row_number() OVER (PARTITION BY sd.session_id ORDER BY d.elevation DESC, d.id) AS k FROM session_destinations sd JOIN destinations d ON d.id = sd.destination_id WHERE sd.relation = 'reached')
    SELECT s.id, s.user_id, count(n.destination_id) AS places, max(n.elevation) AS highest, max(CASE WHEN k = 1 THEN n.name END) AS top_name, CAST(to_json(list({'id': n.destination_id, 'name': n.name} ORDER BY k)) AS VARCHAR) AS document FROM sessions s JOIN n ON n.session_id = s.id GROUP BY s.id, s.user_id""")
def session_detail(spark, sf):
    """Nested document of a session's reached places, highest first."""
    from switchback.operators import documents

    d = table(spark, sf, "destinations").select(F.col("id").alias("destination_id"), "name", "elevation")
    b = table(spark, sf, "session_destinations").where("relation = 'reached'").join(d, "destination_id")
    nested = documents.nested(b, ["session_id"], {"id": "destination_id", "name": "name"}, [F.desc("elevation"), F.asc("destination_id")], "document")
    top = b.groupBy("session_id").agg(F.count(F.lit(1)).alias("places"), F.max("elevation").alias("highest"), F.min_by("name", F.struct((-F.col("elevation")).alias("z"), "destination_id")).alias("top_name"))
    s = table(spark, sf, "sessions").select(F.col("id").alias("session_id"), "user_id")
    return s.join(top, "session_id").join(nested, "session_id").select(F.col("session_id").alias("id"), "user_id", "places", "highest", "top_name", "document")


@plan("""SELECT x.session_id AS id, x.destination_id FROM session_destinations x JOIN sessions s ON s.id = x.session_id JOIN destinations d ON d.id = x.destination_id
    WHERE s.is_public AND d.elevation >= 2000 AND list_contains(d.features, 'summit')""")
def composed_filters(spark, sf):
    """Filters that are set are applied, unset ones are not."""
    from switchback.operators import documents

    d = table(spark, sf, "destinations").select(F.col("id").alias("destination_id"), "elevation", "features")
    rows = table(spark, sf, "session_destinations").join(table(spark, sf, "sessions").select(F.col("id").alias("session_id"), "is_public", "user_id"), "session_id").join(d, "destination_id")
    wanted = documents.all_of({"is_public": lambda v: F.col("is_public") == v, "least": lambda v: F.col("elevation") >= v, "feature": lambda v: F.array_contains("features", v), "users": lambda v: F.col("user_id").isin(v)}, is_public=True, least=2000, feature="summit", users=None)
    return rows.where(wanted).select(F.col("session_id").alias("id"), "destination_id")


@plan("""SELECT session_id, max(time) - min(time) - sum(CASE WHEN dt >= 14400 AND m <= 500e0 THEN dt ELSE 0 END) AS seconds FROM (SELECT session_id, time, time - lag(time) OVER w AS dt, """ + hav("lag(lat) OVER w", "lag(lng) OVER w", "lat", "lng") + """ AS m FROM points WINDOW w AS (PARTITION BY session_id ORDER BY time, event_id)) x GROUP BY session_id""")
def camp_free_time(spark, sf):
    return tracks.camp_free_seconds(table(spark, sf, "points")).select("session_id", "seconds")


@plan()
def sampled_tracks(spark, sf):
    return tracks.sampled(table(spark, sf, "points")).select("session_id", "time", F.round("cum_m", 3).alias("cum_m"))


@plan()
def simplified_tracks(spark, sf):
    return tracks.simplify(table(spark, sf, "points"), 800.0).select("session_id", "time")


@plan()
def polyline_round_trip(spark, sf):
    r = _route_lines(spark, sf).select("route_id", F.transform("path", lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng"))).alias("path"))
    return r.select("route_id", text.encode_polyline6("path").alias("code")).select("route_id", "code", F.size(text.decode_polyline6("code")).alias("vertices"))


# graph


@plan()
def endpoint_clusters(spark, sf):
    return graph.cluster_endpoints(table(spark, sf, "routes").select("id", "lat", "lng"), 1200.0).select("id", "cluster", "members")


# merges


@plan("SELECT id, CASE WHEN id % 2 = 0 AND id % 3 <> 0 THEN gain + 1 ELSE gain END AS gain FROM routes")
def upsert_newest_wins(spark, sf):
    r = table(spark, sf, "routes").select("id", "gain", F.lit(5).alias("run_at"))
    batch = r.where("id % 2 = 0").select("id", (F.col("gain") + 1).alias("gain"), F.when(F.col("id") % 3 == 0, 4).otherwise(6).alias("run_at"))
    return merge.latest_wins(r, batch, ["id"], "run_at").select("id", "gain")


@plan("SELECT id, gain FROM routes WHERE id % 5 = 0 UNION ALL SELECT id + 100000, gain FROM routes WHERE id % 50 = 1")
def upsert_only_changed(spark, sf):
    batch = table(spark, sf, "routes").select("id", "gain")
    old = batch.select("id", F.when(F.col("id") % 5 == 0, -1.0).otherwise(F.col("gain")).alias("gain"))
    new = batch.unionByName(batch.where("id % 50 = 1").select((F.col("id") + 100000).alias("id"), "gain"))
    return merge.changed_only(old, new, ["id"])


@plan("SELECT DISTINCT user_id AS session_id, CAST(floor(epoch(ts)) AS BIGINT) AS time FROM events WHERE event_id % 3 = 0 AND CONCAT(user_id, ':', floor(epoch(ts))) NOT IN (SELECT CONCAT(user_id, ':', floor(epoch(ts))) FROM events WHERE event_id % 2 = 0)")
def append_idempotent(spark, sf):
    p = table(spark, sf, "points").select("session_id", "time", "event_id")
    batch = p.where("event_id % 3 = 0")
    return merge.append_new(p.where("event_id % 2 = 0"), batch.unionByName(batch), ["session_id", "time"]).select("session_id", "time")


@plan("SELECT session_id, destination_id, source FROM session_destinations WHERE source = 'manual' UNION ALL SELECT session_id, destination_id, source FROM session_destinations WHERE source = 'auto' AND destination_id % 4 <> 0")
def reconcile_manual_auto(spark, sf):
    c = table(spark, sf, "session_destinations").select("session_id", "destination_id", "source")
    auto = c.where("source = 'auto'")
    return merge.replace_auto(c, auto, auto.where("destination_id % 4 = 0"), ["session_id", "destination_id"])


@plan("SELECT user_id, m, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, CAST(month(start_time) AS VARCHAR) AS m, count(*) AS n FROM sessions GROUP BY ALL) x GROUP BY user_id, m")
def histogram_merge(spark, sf):
    s = table(spark, sf, "sessions").withColumn("m", F.month("start_time").cast("string"))
    half = lambda k: s.where(f"id % 2 = {k}").groupBy("user_id", "m").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("m", "n"))).alias(f"h{k}"))
    both = half(0).join(half(1), "user_id", "full")
    return both.select("user_id", F.explode(merge.merge_histograms(F.col("h0"), F.col("h1"))).alias("m", "n"))


@plan("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE value + 1 END AS value FROM events")
def sample_merge_existing_wins(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    return merge.merge_samples(e.where("event_id % 2 = 0"), e.select("event_id", (F.col("value") + 1).alias("value")), ["event_id"])


@plan("SELECT p_brand AS leaf, max(p_size) AS priority FROM part GROUP BY p_brand")
def leaf_conflicts(spark, sf):
    c = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("leaf"), F.col("p_size").alias("priority"), F.col("p_retailprice").alias("observed"), F.col("p_partkey").alias("source"))
    return merge.resolve_leaves(c, ["leaf"]).select("leaf", "priority")


# streams


@plan("SELECT user_id, count(*) AS n, round(max(value), 2) AS top FROM events GROUP BY user_id")
def stream_reprocessed_sessions(spark, sf):
    """Events arriving in files out of order; the store of results equals one batch over all."""
    import uuid

    from switchback.streaming import ingest

    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3, "event_id").write.parquet(f"{root}/in")
    recompute = lambda known: known.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 2).alias("top"))
    points = ingest.read_points(spark, f"{root}/in", e.schema)
    query = ingest.reprocess_touched(points, f"{root}/store", f"{root}/result", recompute, f"{root}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    return ingest.latest(spark, f"{root}/result", ["user_id"])


@plan()
def stream_daily_windows(spark, sf):
    """Windows that the watermark closed, written in append mode."""
    import uuid

    from switchback.streaming import ingest

    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(f"{root}/in")
    w = ingest.windowed(ingest.read_points(spark, f"{root}/in", e.schema))
    w.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(w.schema).parquet(f"{root}/out").select("start", "event_type", "n", F.round("total", 2).alias("total"))


# routes and areas


def _made_routes(spark, sf):
    """Routes of two segments, the second stored backwards; every seventh has its segments swapped."""
    r = table(spark, sf, "routes").select("id", "lat", "lng")
    v = lambda a, b: F.transform(F.sequence(F.lit(a), F.lit(b)), lambda k: F.struct((F.col("lng") + k * 0.001).alias("lng"), F.col("lat").alias("lat"), (k * 10.0).alias("z")))
    gains = {"gain": F.lit(40.0), "loss": F.lit(0.0)}
    rt = r.select(F.col("id").alias("route_id"), v(0, 4).alias("path"), F.lit("point_to_point").alias("shape")).withColumns(gains)
    one = r.select((F.col("id") * 2).alias("segment_id"), v(0, 2).alias("path"), F.lit(20.0).alias("gain"), F.lit(0.0).alias("loss"))
    two = r.select((F.col("id") * 2 + 1).alias("segment_id"), F.reverse(v(2, 4)).alias("path"), F.lit(0.0).alias("gain"), F.lit(20.0).alias("loss"))
    swap = (F.col("id") % 7 == 0).cast("int")
    bridge = r.select(F.col("id").alias("route_id"), (F.col("id") * 2).alias("segment_id"), swap.alias("ordinal"), F.lit("forward").alias("direction")).unionByName(r.select(F.col("id").alias("route_id"), (F.col("id") * 2 + 1).alias("segment_id"), (1 - swap).alias("ordinal"), F.lit("reverse").alias("direction")))
    places = r.select(F.col("id").alias("destination_id"), "lat", (F.col("lng") + 0.004).alias("lng"), F.array(F.when(F.col("id") % 5 == 0, "lake").otherwise("summit")).alias("features"))
    contacts = r.select(F.col("id").alias("route_id"), F.col("id").alias("destination_id"), F.lit(0).alias("ordinal"))
    return rt, one.unionByName(two), bridge, contacts, places


@plan("SELECT id AS route_id, id % 7 <> 0 AS connected, id % 5 <> 0 AS has_summit, id % 7 <> 0 AND id % 5 <> 0 AS passes FROM routes")
def route_publish_checks(spark, sf):
    from switchback.operators import routes

    return routes.publish_checks(*_made_routes(spark, sf)).select("route_id", "connected", "has_summit", "passes")


@plan("SELECT id AS route_id, k AS run, 'existing' AS kind, id * 2 + k AS segment_id, CASE WHEN k = 0 THEN 'forward' ELSE 'reverse' END AS direction FROM routes, range(0, 2) t(k)")
def route_decomposition(spark, sf):
    from switchback.operators import routes

    rt, segments, bridge, *_ = _made_routes(spark, sf)
    return routes.decompose(rt, segments, bridge.select("route_id", "segment_id")).select("route_id", "run", "kind", "segment_id", "direction")


@plan("SELECT n_nationkey AS area_id, 1000 + n_nationkey AS parent_id FROM nation WHERE n_nationkey % 2 = 0")
def parent_areas(spark, sf):
    """Each even area lies in a park that is a little larger; odd ones in one that is too small."""
    from switchback.operators import areas

    p = lambda x, y: F.struct(F.col(x).alias("lng"), F.col(y).alias("lat"))
    rings = F.array(F.array(p("west", "south"), p("east", "south"), p("east", "north"), p("west", "north")))
    a = table(spark, sf, "areas").select(F.col("id").alias("area_id"), "south", "north", (F.col("west") + F.col("id") * 3).alias("west"), (F.col("east") + F.col("id") * 3).alias("east"))
    pad = F.when(F.col("area_id") % 2 == 0, 0.01).otherwise(-0.1)
    parks = a.select((F.col("area_id") + 1000).alias("area_id"), (F.col("south") - pad).alias("south"), (F.col("north") + pad).alias("north"), (F.col("west") - pad).alias("west"), (F.col("east") + pad).alias("east"))
    return areas.parents(a.withColumn("rings", rings), parks.withColumn("rings", rings)).select("area_id", "parent_id")
