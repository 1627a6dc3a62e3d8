"""The relational catalogue: one text a query, run by Spark and by the oracle.

Every function takes a dialect and returns SQL over the domain views. Orders carry a
unique tie-breaker and say where nulls go.
"""

from __future__ import annotations

RELATIONAL: dict = {}


def q(f):
    RELATIONAL[f.__name__] = f
    return f


def above(t: str) -> str:
    return f"""CASE WHEN elevation > {t} AND next_elevation > {t} THEN secs
      WHEN elevation <= {t} AND next_elevation > {t} THEN secs * (next_elevation - {t}) / nullif(next_elevation - elevation, 0e0)
      WHEN elevation > {t} AND next_elevation <= {t} THEN secs * (elevation - {t}) / nullif(elevation - next_elevation, 0e0) ELSE 0e0 END"""


# filters and predicates


@q
def filter_features_contain_all(d):
    return f"SELECT id, name FROM destinations WHERE {d.contains_all('features', d.arr(chr(39) + 'summit' + chr(39), chr(39) + 'lookout' + chr(39)))}"


@q
def filter_features_overlap(d):
    return f"SELECT id, name FROM destinations WHERE {d.overlap('features', d.arr(chr(39) + 'lake' + chr(39), chr(39) + 'lookout' + chr(39)))}"


@q
def filter_membership_and_ids(d):
    return f"SELECT id, elevation FROM destinations WHERE {d.has('features', chr(39) + 'summit' + chr(39))} AND id IN (3, 4, 5, 8, 9, 12, 60, 61) AND NOT id IN (9)"


@q
def filter_prefix_and_regex(d):
    return f"SELECT id, name FROM destinations WHERE lower(name) LIKE 'b%' OR {d.regex('name', '^[r-s].*t$')}"


@q
def filter_null_safe_difference(d):
    return "SELECT id FROM destinations WHERE prominence IS DISTINCT FROM 100e0 AND prominence IS DISTINCT FROM 200e0"


@q
def filter_optional_and_between(d):
    return f"SELECT id, status FROM sessions WHERE (NULL IS NULL OR status IN ('F')) AND start_time BETWEEN {d.ts('1996-01-01 00:00:00')} AND {d.ts('1996-03-01 00:00:00')}"


@q
def filter_token_prefix(d):
    return f"SELECT id, name FROM destinations WHERE {d.regex('lower(name)', '(^|[^a-z0-9])wi')}"


@q
def viewport_destinations(d):
    return "SELECT id, name, round(lat, 6) AS lat, round(lng, 6) AS lng FROM destinations WHERE lat BETWEEN 44.2e0 AND 44.9e0 AND lng BETWEEN -119.5e0 AND -118.2e0"


@q
def viewport_areas_overlap(d):
    return "SELECT id, name FROM areas WHERE west <= -119e0 AND east >= -119.6e0 AND south <= 45e0 AND north >= 44.5e0"


@q
def masked_by_viewer(d):
    return "SELECT id, CASE WHEN user_id = 7 THEN name END AS name, CASE WHEN user_id = 7 THEN gain ELSE 0e0 END AS gain FROM sessions WHERE user_id = 7 OR is_public"


@q
def attribution_gate(d):
    return "SELECT id, CASE WHEN prominence IS NOT NULL AND type <> '' THEN name END AS credited_name FROM destinations"


# joins


@q
def join_inner_left(d):
    return "SELECT s.id, u.name, sd.destination_id FROM sessions s JOIN users u ON u.id = s.user_id LEFT JOIN session_destinations sd ON sd.session_id = s.id AND sd.relation = 'goal'"


@q
def join_lateral_best_route(d):
    return """SELECT id, route_id, gain FROM (SELECT de.id, r.id AS route_id, r.gain, row_number() OVER (PARTITION BY de.id ORDER BY r.gain DESC NULLS LAST, r.id) AS n
      FROM destinations de LEFT JOIN route_destinations rd ON rd.destination_id = de.id LEFT JOIN routes r ON r.id = rd.route_id) x WHERE n = 1"""


@q
def join_lateral_counts(d):
    return """SELECT a.id, coalesce(c.n, 0) AS n_routes, coalesce(u.n, 0) AS n_users FROM areas a
      LEFT JOIN (SELECT area_id, count(*) AS n FROM routes GROUP BY area_id) c ON c.area_id = a.id LEFT JOIN (SELECT area_id, count(*) AS n FROM users GROUP BY area_id) u ON u.area_id = a.id"""


@q
def join_scalar_subquery(d):
    return "SELECT l.list_id, l.destination_id, (SELECT count(*) FROM lists m WHERE m.list_id = l.list_id) AS members FROM lists l WHERE l.ordinal <= 3"


@q
def join_semi_exists(d):
    return "SELECT id FROM destinations WHERE EXISTS (SELECT 1 FROM session_destinations sd WHERE sd.destination_id = destinations.id AND sd.source = 'manual') AND id IN (SELECT destination_id FROM lists WHERE ordinal <= 20)"


@q
def join_anti_rejections(d):
    return "SELECT s.id FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM session_destinations sd WHERE sd.session_id = s.id)"


@q
def join_not_in(d):
    return f"""SELECT id, name, prominence FROM destinations WHERE id NOT IN (SELECT destination_id FROM session_destinations sd JOIN sessions s ON s.id = sd.session_id WHERE s.start_time >= {d.ts('2001-06-01 00:00:00')})
      AND prominence NOT IN (SELECT prominence FROM destinations WHERE prominence >= 900)"""


@q
def join_tuple_not_in(d):
    return "SELECT session_id, destination_id FROM session_destinations a WHERE NOT EXISTS (SELECT 1 FROM (SELECT session_id, min(destination_id) AS destination_id FROM session_destinations GROUP BY session_id) b WHERE a.session_id = b.session_id AND a.destination_id = b.destination_id) AND relation = 'goal'"


@q
def join_full_outer(d):
    return "SELECT coalesce(r.area_id, u.area_id) AS area_id, r.n AS routes, u.n AS users FROM (SELECT area_id, count(*) AS n FROM routes WHERE id % 2 = 0 GROUP BY area_id) r FULL JOIN (SELECT area_id, count(*) AS n FROM users WHERE segment = 'BUILDING' GROUP BY area_id) u ON r.area_id = u.area_id"


@q
def join_cross_offsets(d):
    return "SELECT a.id, x.dx, y.dy FROM areas a CROSS JOIN (SELECT -1 AS dx UNION ALL SELECT 0 UNION ALL SELECT 1) x CROSS JOIN (SELECT -1 AS dy UNION ALL SELECT 0 UNION ALL SELECT 1) y"


@q
def join_bridge_self(d):
    return "SELECT a.session_id AS session_a, b.session_id AS session_b, count(*) AS shared FROM session_destinations a JOIN session_destinations b ON a.destination_id = b.destination_id AND a.session_id < b.session_id GROUP BY a.session_id, b.session_id HAVING count(*) >= 2"


@q
def join_case_other_side(d):
    return """SELECT x.id, o.id AS other FROM (SELECT id, id AS a, id + 1 AS b FROM sessions UNION ALL SELECT id + 1, id, id + 1 FROM sessions) x
      JOIN sessions s ON s.id = x.id JOIN sessions o ON o.id = CASE WHEN x.id = x.a THEN x.b ELSE x.a END"""


@q
def join_null_safe_map(d):
    return "SELECT r.id, m.label FROM routes r JOIN (SELECT 0 AS rank, 'highway' AS label UNION ALL SELECT 1, 'any car' UNION ALL SELECT 2, 'high clearance' UNION ALL SELECT NULL, 'unknown') m ON r.vehicle_rank IS NOT DISTINCT FROM m.rank"


@q
def join_owner_or(d):
    return "SELECT s.id, de.id AS destination_id FROM sessions s JOIN session_destinations sd ON sd.session_id = s.id JOIN destinations de ON de.id = sd.destination_id AND (de.owner = 'peaks' OR de.owner = concat('u', CAST(s.user_id AS STRING)))"


@q
def join_interval_overlap(d):
    return """SELECT a.id AS id_a, b.id AS id_b, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS shared
      FROM (SELECT id, area_id, id % 40 AS lo, id % 40 + 10 AS hi FROM routes) a JOIN (SELECT id, area_id, id % 35 AS lo, id % 35 + 8 AS hi FROM routes) b ON a.area_id = b.area_id AND a.id <> b.id WHERE least(a.hi, b.hi) - greatest(a.lo, b.lo) > 0"""


@q
def list_member_resolution(d):
    return """SELECT name, destination_id FROM (SELECT w.name, max(de.id) AS destination_id, count(*) AS n FROM (SELECT DISTINCT name, round(elevation / 30e0) AS band FROM destinations) w
      JOIN destinations de ON lower(de.name) = lower(w.name) AND round(de.elevation / 30e0) = w.band GROUP BY w.name, w.band) x WHERE n = 1"""


# aggregates


@q
def user_totals(d):
    return "SELECT user_id, count(*) AS trips, round(coalesce(sum(distance), 0e0), 2) AS distance, max(gain) AS best_gain, sum(duration) AS seconds FROM sessions GROUP BY user_id"


@q
def count_distinct_filters(d):
    return "SELECT destination_id, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE relation = 'goal') AS goals, count(DISTINCT session_id) FILTER (WHERE source = 'manual') AS manual FROM session_destinations GROUP BY destination_id HAVING count(*) >= 3"


@q
def bool_aggregates(d):
    return "SELECT state, bool_and(elevation > 2710e0) AS all_high, bool_or(prominence IS NULL) AS any_unknown FROM destinations GROUP BY state"


@q
def ordered_string_aggregates(d):
    return f"SELECT list_id, {d.ordered('CAST(destination_id AS STRING)', 'ordinal', '>')} AS members, count(*) AS n FROM lists GROUP BY list_id"


@q
def sorted_array_aggregates(d):
    return f"SELECT state, {d.join_sorted('type', True)} AS types FROM destinations GROUP BY state"


@q
def popularity_histogram(d):
    return f"""SELECT sd.destination_id, 'month' AS part, {d.month("s.start_time")} AS slot, count(*) AS n, max({d.epoch("s.start_time")}) AS latest FROM session_destinations sd JOIN sessions s ON s.id = sd.session_id
      WHERE sd.relation = 'reached' GROUP BY sd.destination_id, {d.month("s.start_time")}
      UNION ALL SELECT sd.destination_id, 'weekday', {d.isodow("s.start_time")}, count(*), max({d.epoch("s.start_time")}) FROM session_destinations sd JOIN sessions s ON s.id = sd.session_id WHERE sd.relation = 'reached' GROUP BY sd.destination_id, {d.isodow("s.start_time")}"""


@q
def weekday_from_sunday(d):
    return f"SELECT {d.month('start_time')} AS month, {d.dow('start_time')} AS dow, count(*) AS n FROM sessions GROUP BY {d.month('start_time')}, {d.dow('start_time')}"


@q
def top_months(d):
    return f"""SELECT user_id, {d.ordered('CAST(m AS STRING)', 'n DESC, m', ',')} AS months FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, m) AS k FROM
      (SELECT user_id, {d.month('start_time')} AS m, count(*) AS n FROM sessions GROUP BY user_id, {d.month('start_time')}) x) y WHERE k <= 3 GROUP BY user_id"""


@q
def peak_months_with_ties(d):
    return f"""SELECT user_id, m FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS top FROM (SELECT user_id, {d.month('start_time')} AS m, count(*) AS n FROM sessions GROUP BY user_id, {d.month('start_time')}) x) y WHERE n = top"""


@q
def source_freshness(d):
    return f"""SELECT status, {d.to_text("max(start_time)")} AS latest, count(*) AS runs, max(start_time) < {d.ts("1998-07-01 00:00:00")} AS stale FROM sessions GROUP BY status"""


@q
def area_rollup(d):
    return """SELECT a.id, a.name, count(s.id) AS sessions, round(coalesce(sum(s.distance), 0e0), 2) AS distance, round(coalesce(sum(s.gain), 0e0), 2) AS gain, coalesce(sum(s.duration), 0) AS seconds
      FROM areas a LEFT JOIN users u ON u.area_id = a.id LEFT JOIN sessions s ON s.user_id = u.id GROUP BY a.id, a.name"""


@q
def grid_coverage(d):
    return """SELECT CAST(floor(lat / 5e-1) AS BIGINT) AS row, CAST(floor(lng / 5e-1) AS BIGINT) AS col, count(*) AS places, count(*) FILTER (WHERE prominence IS NOT NULL) AS known,
      round(100e0 * count(*) FILTER (WHERE prominence IS NOT NULL) / count(*), 3) AS percent FROM destinations GROUP BY floor(lat / 5e-1), floor(lng / 5e-1)"""


@q
def catalog_health(d):
    return "SELECT count(*) AS places, count(prominence) AS with_prominence, count(DISTINCT lower(name)) AS names, count(*) FILTER (WHERE elevation < 2750e0) AS low FROM destinations"


@q
def list_topline(d):
    return f"SELECT l.list_id, count(*) AS members, {d.argmax('de.id', 'de.elevation * 1e6 - de.id')} AS highest, count(DISTINCT de.state) AS states FROM lists l JOIN destinations de ON de.id = l.destination_id GROUP BY l.list_id"


@q
def list_progress(d):
    return """SELECT l.list_id, s.user_id, count(DISTINCT l.destination_id) AS done, max(t.n) AS members, count(DISTINCT l.destination_id) = max(t.n) AS complete FROM lists l JOIN session_destinations sd ON sd.destination_id = l.destination_id
      JOIN sessions s ON s.id = sd.session_id JOIN (SELECT list_id, count(*) AS n FROM lists GROUP BY list_id) t ON t.list_id = l.list_id WHERE sd.relation = 'reached' GROUP BY l.list_id, s.user_id"""


@q
def attempt_history(d):
    return f"""SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY duration, id) AS place, duration = min(duration) OVER (PARTITION BY user_id) AS best, duration - lag(duration) OVER (PARTITION BY user_id ORDER BY start_time, id) AS change FROM sessions"""


@q
def ordered_fingerprint(d):
    return f"SELECT list_id, md5({d.ordered('concat(CAST(ordinal AS STRING), chr(58), CAST(destination_id AS STRING))', 'ordinal', '|')}) AS fingerprint FROM lists GROUP BY list_id"


@q
def audit_priority(d):
    return """SELECT r.id, sum(CASE WHEN de.elevation > 2800e0 THEN 3 ELSE 0 END) + sum(CASE WHEN de.prominence IS NULL THEN 2 ELSE 0 END) + CASE WHEN max(CASE WHEN k.destination_id IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN 10 ELSE 0 END AS priority
      FROM routes r JOIN route_destinations rd ON rd.route_id = r.id JOIN destinations de ON de.id = rd.destination_id LEFT JOIN (SELECT destination_id FROM lists WHERE ordinal = 1) k ON k.destination_id = de.id GROUP BY r.id"""


@q
def compose_area_groups(d):
    return f"SELECT parent_id, min(name) AS name, {d.join_sorted('name', True)} AS parts, min(south) AS south, max(north) AS north, min(west) AS west, max(east) AS east FROM areas GROUP BY parent_id HAVING count(*) >= 2"


# windows


@q
def altitude_time(d):
    return f"""WITH o AS (SELECT session_id, time, segment_number, elevation, lead(time) OVER w AS next_time, lead(segment_number) OVER w AS next_segment, lead(elevation) OVER w AS next_elevation FROM points WINDOW w AS (PARTITION BY session_id ORDER BY time)),
      v AS (SELECT session_id, elevation, next_elevation, CAST(next_time - time AS DOUBLE) AS secs FROM o WHERE next_time > time AND next_time - time <= 86400 AND next_segment = segment_number AND elevation IS NOT NULL AND next_elevation IS NOT NULL)
      SELECT session_id, round(sum({above('4267.2e0')}), 2) AS above_14000_ft, round(sum({above('3962.4e0')}), 2) AS above_13000_ft, round(sum({above('4e3')}), 2) AS above_4000_m, round(sum({above('3e3')}), 2) AS above_3000_m FROM v GROUP BY session_id"""


@q
def window_chain_check(d):
    return "SELECT list_id, bool_and(ok) AS chained FROM (SELECT list_id, coalesce(ordinal = lag(ordinal) OVER (PARTITION BY list_id ORDER BY ordinal) + 1, ordinal = 1) AS ok FROM lists) x GROUP BY list_id"


@q
def window_top_n_per_group(d):
    return "SELECT parent_id, id, name FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY north DESC NULLS LAST, id) AS n FROM areas) x WHERE n <= 3"


@q
def window_counts(d):
    return "SELECT id, count(*) OVER () AS total, count(*) OVER (PARTITION BY status) AS same_status FROM sessions"


@q
def downsample_ntile(d):
    return """SELECT session_id, time, elevation FROM (SELECT *, row_number() OVER (PARTITION BY session_id, bucket ORDER BY time, event_id) AS n FROM (SELECT *, ntile(20) OVER (PARTITION BY session_id ORDER BY time, event_id) AS bucket,
      row_number() OVER (PARTITION BY session_id, segment_number ORDER BY time, event_id) AS f, row_number() OVER (PARTITION BY session_id, segment_number ORDER BY time DESC, event_id DESC) AS l FROM points) x) y WHERE n = 1 OR f = 1 OR l = 1"""


@q
def running_split_pieces(d):
    return "SELECT session_id, time, event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS piece FROM points"


@q
def share_of_total(d):
    return "SELECT id, area_id, round(gain / sum(gain) OVER (PARTITION BY area_id), 9) AS share FROM routes"


@q
def global_ids(d):
    return "SELECT row_number() OVER (ORDER BY user_id, id) AS node_id, id FROM sessions"


@q
def distinct_on_best(d):
    return "SELECT type, name, id FROM (SELECT *, row_number() OVER (PARTITION BY type, name ORDER BY elevation DESC NULLS LAST, id) AS n FROM destinations) x WHERE n = 1"


@q
def moving_average_null_safe(d):
    return "SELECT session_id, time, event_id, round(avg(CASE WHEN event_type = 'error' THEN NULL ELSE elevation END) OVER (PARTITION BY session_id ORDER BY time, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM points"


# order, limit, cursors


@q
def top_k_scores(d):
    return "SELECT id, round(elevation / 9000e0 * 15e-2 + coalesce(prominence, 0e0) / 9000e0 * 1e-1, 9) AS score FROM destinations ORDER BY score DESC NULLS LAST, id LIMIT 25"


@q
def page_with_offset(d):
    return "SELECT id, start_time, distance FROM sessions ORDER BY start_time DESC NULLS LAST, id DESC LIMIT 50 OFFSET 100"


@q
def keyset_page(d):
    return f"SELECT id, user_id FROM sessions WHERE start_time > {d.ts('1997-01-01 00:00:00')} OR (start_time = {d.ts('1997-01-01 00:00:00')} AND id > 500) ORDER BY start_time, id LIMIT 51"


@q
def knn_order(d):
    return "SELECT id, round((lat - 45e0) * (lat - 45e0) + (lng + 118.5e0) * (lng + 118.5e0), 9) AS d2 FROM destinations ORDER BY d2, id LIMIT 20"


@q
def capped_list_with_best(d):
    return "SELECT user_id, id, duration FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_time DESC, id DESC) AS n, row_number() OVER (PARTITION BY user_id ORDER BY duration, id) AS best FROM sessions) x WHERE n <= 5 OR best = 1"


@q
def prune_pairs_both_sides(d):
    return """SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY w DESC, a) AS rb FROM
      (SELECT r.area_id AS a, u.segment AS b, count(*) AS w FROM routes r JOIN users u ON u.area_id = r.area_id GROUP BY r.area_id, u.segment) x) y WHERE ra <= 2 OR rb <= 2"""


@q
def popular_with_fallback(d):
    return """WITH p AS (SELECT destination_id AS id, count(*) AS n FROM session_destinations WHERE relation = 'reached' GROUP BY destination_id HAVING count(*) >= 40 ),
      t AS (SELECT id, 1 AS tier, CAST(n AS DOUBLE) AS w FROM p UNION ALL SELECT id, 2, elevation FROM destinations WHERE id NOT IN (SELECT id FROM p))
      SELECT id, tier FROM t ORDER BY tier, w DESC, id LIMIT 12"""


# sets, recursion, nesting


@q
def change_feed(d):
    return f"""SELECT kind, id, moment FROM (SELECT 'upsert' AS kind, id, {d.epoch('start_time')} AS moment FROM sessions WHERE id % 7 <> 0 UNION ALL SELECT 'delete', id, {d.epoch('start_time')} + 60 FROM sessions WHERE id % 7 = 0) x
      WHERE moment > 820454400 ORDER BY moment, id, kind LIMIT 200"""


@q
def union_distinct_matches(d):
    return "SELECT DISTINCT session_id, destination_id FROM (SELECT session_id, destination_id FROM session_destinations WHERE relation = 'goal' UNION ALL SELECT session_id, destination_id FROM session_destinations WHERE source = 'manual') x"


@q
def unpivot_by_class(d):
    return "SELECT id, 'gain' AS measure, gain AS amount FROM routes UNION ALL SELECT id, 'distance', distance FROM routes"


@q
def set_intersect_except(d):
    return "SELECT destination_id FROM session_destinations WHERE source = 'manual' INTERSECT SELECT destination_id FROM lists WHERE ordinal <= 30 EXCEPT SELECT destination_id FROM session_destinations WHERE relation = 'goal' AND source = 'auto'"


@q
def membership_diff(d):
    return """SELECT coalesce(o.list_id, n.list_id) AS list_id, coalesce(o.destination_id, n.destination_id) AS destination_id, CASE WHEN o.destination_id IS NULL THEN 'added' WHEN n.destination_id IS NULL THEN 'removed' WHEN o.ordinal <> n.ordinal THEN 'moved' ELSE 'same' END AS change
      FROM (SELECT * FROM lists WHERE destination_id % 5 <> 0) o FULL JOIN (SELECT list_id, destination_id, ordinal + CASE WHEN destination_id % 4 = 0 THEN 1 ELSE 0 END AS ordinal FROM lists WHERE destination_id % 7 <> 0) n ON o.list_id = n.list_id AND o.destination_id = n.destination_id"""


@q
def json_fields(d):
    return f"SELECT event_id, CAST({d.json('props', 'k')} AS BIGINT) AS k FROM {d.t('events')} WHERE {d.json('props', 'k')} IS NOT NULL"


@q
def unnest_features(d):
    return f"SELECT f, count(*) AS n FROM destinations {d.unnest('features', 'f')} GROUP BY f"


@q
def rollup_extension(d):
    return "SELECT coalesce(state, 'all') AS state, coalesce(type, 'all') AS type, count(*) AS n FROM destinations GROUP BY ROLLUP (state, type)"


# catalogue documents


@q
def area_detail(d):
    return f"""SELECT a.id, a.name, count(de.id) AS places, {d.ordered('CAST(de.id AS STRING)', 'de.elevation DESC, de.id', ',')} AS ranked FROM areas a
      JOIN destinations de ON de.lat BETWEEN a.south AND a.north AND de.lng BETWEEN a.west AND a.east GROUP BY a.id, a.name"""


@q
def destination_detail(d):
    return """SELECT de.id, de.name, count(DISTINCT sd.session_id) AS sessions, count(DISTINCT rd.route_id) AS routes, count(DISTINCT l.list_id) AS lists FROM destinations de LEFT JOIN session_destinations sd ON sd.destination_id = de.id AND sd.relation = 'reached'
      LEFT JOIN route_destinations rd ON rd.destination_id = de.id LEFT JOIN lists l ON l.destination_id = de.id GROUP BY de.id, de.name"""


@q
def route_detail(d):
    return f"SELECT r.id, r.name, {d.ordered('concat(CAST(rd.ordinal AS STRING), chr(58), de.name)', 'rd.ordinal, de.id', '; ')} AS places FROM routes r JOIN route_destinations rd ON rd.route_id = r.id JOIN destinations de ON de.id = rd.destination_id GROUP BY r.id, r.name"


@q
def lists_popular(d):
    return "SELECT l.list_id, count(DISTINCT s.user_id) AS users FROM lists l JOIN session_destinations sd ON sd.destination_id = l.destination_id JOIN sessions s ON s.id = sd.session_id GROUP BY l.list_id ORDER BY users DESC NULLS LAST, l.list_id LIMIT 10"


@q
def state_facts(d):
    return f"SELECT state, count(*) AS places, {d.argmax('name', 'elevation * 1e6 - id')} AS highest, round(max(elevation), 2) AS top FROM destinations GROUP BY state"


@q
def places_not_reached(d):
    return "SELECT id, name FROM destinations WHERE id NOT IN (SELECT sd.destination_id FROM session_destinations sd JOIN sessions s ON s.id = sd.session_id WHERE s.user_id = 11) ORDER BY elevation DESC, id LIMIT 100"


@q
def session_group_page(d):
    return "SELECT s.id, s.user_id, count(sd.destination_id) AS places FROM sessions s LEFT JOIN session_destinations sd ON sd.session_id = s.id WHERE s.status = 'F' GROUP BY s.id, s.user_id, s.start_time ORDER BY s.start_time DESC, s.id DESC LIMIT 40"


@q
def weather_targets(d):
    return "SELECT id FROM destinations WHERE id IN (SELECT destination_id FROM session_destinations GROUP BY destination_id HAVING count(DISTINCT session_id) >= 3) OR id IN (SELECT destination_id FROM lists WHERE ordinal <= 5)"


@q
def catalogue_counts(d):
    return "SELECT (SELECT count(*) FROM destinations) AS places, (SELECT count(*) FROM routes) AS routes, (SELECT count(*) FROM areas) AS areas, (SELECT count(DISTINCT list_id) FROM lists) AS lists"


@q
def hour_merge_daily_max(d):
    return f"""WITH b AS (SELECT {d.idiv(d.epoch('ts'), '3600')} AS hour, max(value) AS pm FROM {d.t('events')} WHERE event_type = 'view' GROUP BY {d.idiv(d.epoch('ts'), '3600')}),
      s AS (SELECT {d.idiv(d.epoch('ts'), '3600')} AS hour, max(value) AS pm FROM {d.t('events')} WHERE event_type = 'error' GROUP BY {d.idiv(d.epoch('ts'), '3600')}),
      m AS (SELECT coalesce(s.hour, b.hour) AS hour, coalesce(s.pm, b.pm) AS pm, CASE WHEN s.pm IS NULL THEN 'baseline' ELSE 'smoke' END AS source FROM b FULL JOIN s ON s.hour = b.hour)
      SELECT {d.idiv('hour - 4', '24')} AS day, max(pm) AS top, CASE WHEN count(DISTINCT source) = 2 THEN 'mixed' ELSE min(source) END AS source, count(*) AS hours FROM m GROUP BY {d.idiv('hour - 4', '24')}"""


@q
def worst_on_path(d):
    return "SELECT area_id, CASE WHEN count(vehicle_rank) = count(*) THEN max(vehicle_rank) END AS rank, count(*) AS edges FROM routes GROUP BY area_id"


@q
def moving_seconds(d):
    return """SELECT session_id, CAST(floor(sum(CASE WHEN speed >= 3e-1 THEN least(dt, 3600) ELSE 0 END) + 5e-1) AS BIGINT) AS moving FROM
      (SELECT session_id, speed, time - lag(time) OVER (PARTITION BY session_id ORDER BY time, event_id) AS dt FROM points) x WHERE dt > 0 GROUP BY session_id"""


@q
def line_per_recording_gap(d):
    return f"SELECT session_id, segment_number, count(*) AS vertices, CASE WHEN count(*) = 1 THEN 'point' ELSE 'line' END AS kind, {d.ordered('CAST(event_id AS STRING)', 'time, event_id', ',')} AS path FROM points GROUP BY session_id, segment_number"


@q
def gaps_and_islands(d):
    return """SELECT session_id, run, count(*) AS n, min(time) AS first_time, max(time) AS last_time FROM (SELECT session_id, time, sum(cut) OVER (PARTITION BY session_id ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM
      (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY session_id ORDER BY time, event_id) <= 43200 THEN 0 ELSE 1 END AS cut FROM points) x) y GROUP BY session_id, run"""
