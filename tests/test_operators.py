import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from switchback.operators import efforts, graph, merge, spatial, tracks


STEP = 25 / 111320


def track(session, n, back=False, dt=30, lat0=0.0, turned=False):
    """Points along a meridian every 25 m, there and back if asked."""
    k = list(range(n)) + (list(range(n - 2, -1, -1)) if back else [])
    k = k[::-1] if turned else k
    return [(session, x, x * dt, lat0 + y * STEP, 0.0, 1000.0 + y, None) for x, y in enumerate(k)]


def samples(spark, *parts):
    rows = [r for p in parts for r in p]
    return tracks.sampled(spark.createDataFrame(rows, "session_id long, event_id long, time long, lat double, lng double, elevation double, speed double"))


def test_cell_join_equals_cross_join(spark):
    random.seed(3)
    pts = [(i, 45 + random.random() * 0.1, -119 + random.random() * 0.1) for i in range(300)] + [(900, None, None)]
    a = spark.createDataFrame(pts, "id int, lat double, lng double")
    b = spark.createDataFrame([(i, y, x) for i, y, x in pts if i % 2 == 0], "id2 int, lat2 double, lng2 double")
    got = {(r.id, r.id2) for r in spatial.within_distance(a, b, 900.0, right_xy=("lat2", "lng2")).collect()}
    want = {(i, j) for i, y, x in pts[:-1] for j, v, u in pts[:-1] if j % 2 == 0 and tracks._haversine(y, x, v, u) <= 900}
    assert got == want and len(got) > 300


def test_a_point_near_an_edge_far_from_its_vertices(spark):
    lines = spark.createDataFrame([(1, [(-119.0, 45.0), (-118.9, 45.0)])], "line_id int, path array<struct<lng:double,lat:double>>")
    p = spark.createDataFrame([(7, 45.0005, -118.95)], "id int, lat double, lng double")
    r = spatial.points_near_lines(p, lines, 100.0, "line_id").first()
    assert r.distance_m == pytest.approx(55.7, abs=0.5) and r.fraction == pytest.approx(0.5, abs=1e-3)


def test_out_and_back_and_loops(spark):
    got = {r.session_id: r for r in efforts.outbound(efforts.numbered(samples(spark, track(1, 100, back=True), track(2, 100)))).collect()}
    assert got[1].returns and got[1].last == pytest.approx(99, abs=2) and not got[2].returns and got[2].last == 99


def test_marks_lie_between_samples(spark):
    s = efforts.numbered(samples(spark, track(1, 30)))
    got = efforts.marks(s, efforts.outbound(s)).orderBy("mark").collect()
    assert [r.mark for r in got] == [0, 1, 2, 3] and all(111195 * r.mlat == pytest.approx(200 * r.mark, abs=0.5) for r in got)


def test_pairs_of_efforts(spark):
    s = samples(spark, track(1, 200), track(2, 200, dt=45), track(3, 200, turned=True), track(4, 200, lat0=1.0), track(5, 200, back=True), track(6, 200, back=True, dt=40))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (5, 6), (5, 1)], "session_a long, session_b long")
    got = {(r.session_a, r.session_b): r for r in efforts.comparisons(s, pairs).collect()}
    assert set(got) == {(1, 2), (5, 6), (5, 1)}
    one = got[1, 2]
    assert one.scope == "full" and one.full_route and one.elapsed_b == pytest.approx(1.5 * one.elapsed_a, rel=0.02) and one.moving_a == one.elapsed_a
    assert got[5, 6].scope == "full" and got[5, 6].elapsed_a == pytest.approx(2 * one.elapsed_a, rel=0.05)
    assert got[5, 1].scope == "outbound" and got[5, 1].elapsed_a == pytest.approx(one.elapsed_a, rel=0.05)


def test_sampling_keeps_the_last_point():
    lat = np.array([0, 5, 10, 24.9, 26, 27]) / 111195
    assert tracks.thinned(lat, np.zeros(6)).tolist() == [0, 3, 5] and tracks.thinned(lat[:0], lat[:0]).tolist() == []
    rng = np.random.default_rng(1)
    y, x = rng.normal(0, 8 / 111195, 500).cumsum(), rng.normal(0, 8 / 111195, 500).cumsum()
    at = tracks.thinned(y, x, 25.0, 3)
    for i, j in zip(at, at[1:-1]):
        d = tracks._haversine(y[i], x[i], y[i + 1 : j + 1], x[i + 1 : j + 1])
        assert d[-1] >= 24.75 and (d[:-1] < 24.75).all()


def test_sub_line_cuts_between_vertices(spark):
    r = spark.createDataFrame([([(0.0, 0.0), (0.0, 0.01), (0.0, 0.03)],)], "path array<struct<lng:double,lat:double>>")
    deg = 111195.0
    got = r.select(tracks.sub_line(F.col("path"), 0.005 * deg, 0.02 * deg).alias("p")).first().p
    assert [round(p.lat, 4) for p in got] == [0.005, 0.01, 0.02]
    assert [round(p.lat, 4) for p in r.select(tracks.sub_line(F.col("path"), -5.0, 1e9).alias("p")).first().p] == [0.0, 0.01, 0.03]


def test_stitching():
    a, b, c = np.array([[0, 0], [0, 1.0]]), np.array([[0, 2.0], [0, 1.0]]), np.array([[5, 5.0], [5, 6.0]])
    got = tracks.stitch([a, b, c])
    assert [len(x) for x in got] == [3, 2] and tracks.hausdorff(a, a) == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(5, 5)]
    up = list(range(120))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    touched = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: root(x) for x in touched}


def test_greedy_dedupe_by_name(spark):
    rows = [(1, "a", 45.0, -119.0), (2, "a", 45.01, -119.0), (3, "a", 45.02, -119.0), (4, "b", 45.0, -119.0)]
    got = spatial.greedy_name_dedupe(spark.createDataFrame(rows, "id int, name string, lat double, lng double"), 1500.0)
    assert sorted(r.id for r in got.collect()) == [1, 3, 4]


def test_noding(spark):
    v = spark.createDataFrame([(1, k, 45.0, -119.0 + k * 0.001) for k in range(5)], "edge_id int, seq int, lat double, lng double")
    j = spark.createDataFrame([(8, 45.0, -118.998)], "node_id int, lat double, lng double")
    got = [r.piece for r in graph.node_edges(v, j).orderBy("seq").collect()]
    assert got == [0, 0, 0, 1, 1]


def test_merges(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, None, 1)], "k int, v string, at int")
    b = spark.createDataFrame([(1, "b", 1), (2, None, 1), (3, "c", 0)], "k int, v string, at int")
    assert sorted(map(tuple, merge.latest_wins(t, b, ["k"], "at").collect())) == [(1, "b", 1), (2, None, 1), (3, "c", 0)]
    assert sorted(r.k for r in merge.changed_only(t, b, ["k"]).collect()) == [1, 3]
    assert sorted(r.k for r in merge.append_new(t, b, ["k"]).collect()) == [3]
    assert merge.append_new(t, b.limit(0), ["k"]).count() == 0
    s = spark.createDataFrame([("pending", "processing"), ("completed", "failed"), (None, "pending")], "a string, b string")
    assert [r.x for r in s.select(merge.can_move(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False]


def test_altitude_time_interpolates(spark):
    p = spark.createDataFrame([(1, 0, 0, 3900.0), (1, 60, 0, 4100.0), (1, 120, 1, 4200.0), (1, 5000, 1, 4200.0)], "session_id int, time int, segment_number int, elevation double")
    assert tracks.altitude_time(p, {"x": 4000.0}).first().x == 30.0


def test_lines_near_lines(spark):
    rows = [(1, [(-119.0, 45.0), (-118.9, 45.0)]), (2, [(-118.95, 45.003), (-118.95, 45.1)]), (3, [(-118.0, 45.0), (-117.9, 45.0)])]
    t = spark.createDataFrame(rows, "id long, path array<struct<lng:double,lat:double>>")
    got = spatial.lines_near_lines(t.where("id = 1"), t.where("id > 1").withColumnRenamed("id", "other"), "id", "other", 500.0)
    assert [r.other for r in got.collect()] == [2]


def test_documents(spark):
    from switchback.operators import documents

    rows = spark.createDataFrame([(1, 5, "b"), (1, 7, "a"), (2, 9, None)], "k int, id int, name string")
    got = {r.k: r.d for r in documents.nested(rows, ["k"], {"id": "id", "n": "name"}, [F.desc("id")], "d").collect()}
    assert got == {1: '[{"id":7,"n":"a"},{"id":5,"n":"b"}]', 2: '[{"id":9}]'}
    parts = {"least": lambda v: F.col("id") >= v, "names": lambda v: F.col("name").isin(v)}
    assert rows.where(documents.all_of(parts, least=7, names=None)).count() == 2 and rows.where(documents.all_of(parts)).count() == 3
    with pytest.raises(KeyError):
        documents.all_of(parts, other=1)
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"}), (None, {"x": "y"})], "o map<string,string>, n map<string,string>")
    assert [r.v for r in m.select(documents.merged(F.col("o"), F.col("n")).alias("v")).collect()] == [{"a": "1", "c": "3"}, {"x": "y"}]
    assert [r.id for r in documents.in_order(rows, "id", [9, 4, 5]).collect()] == [9, 5]


def test_reference_match_equals_brute_force(spark):
    rng = random.Random(4)
    c = [(k, k, rng.choice("abc"), 45 + rng.random() * 0.03, -119 + rng.random() * 0.03) for k in range(80)]
    r = [(k, k if k % 9 == 0 else None, rng.choice("ABC"), 45 + rng.random() * 0.03, -119 + rng.random() * 0.03) for k in range(40)]
    got = {x.ref_id: (x.id, x.kind) for x in spatial.reference_match(spark.createDataFrame(r, "ref_id int, ref_ext int, ref_name string, ref_lat double, ref_lng double"), spark.createDataFrame(c, "id int, ext int, name string, lat double, lng double")).collect()}
    for k, ext, name, y, x in r:
        best = []
        for i, e, n, v, u in c:
            m = tracks._haversine(y, x, v, u)
            kind = 1 if ext is not None and ext == e else 2 if m <= 150 else 3 if m <= 1000 and name.lower() == n else None
            if kind:
                best.append((kind, m, i))
        assert got[k] == ((min(best)[2], min(best)[0]) if best else (None, None))


def test_coverage_equals_brute_force(spark):
    rng = random.Random(5)
    pts = [(s, 45 + rng.random() * 0.002, -119 + rng.random() * 0.002) for s in range(12) for _ in range(30)]
    vs = [(r, v, 45 + rng.random() * 0.002, -119 + rng.random() * 0.002) for r in range(8) for v in range(4)]
    got = {(x.session_id, x.route_id) for x in tracks.coverage(spark.createDataFrame(pts, "session_id int, lat double, lng double"), spark.createDataFrame(vs, "route_id int, vertex int, vlat double, vlng double")).collect()}
    want = {(s, r) for s in range(12) for r in range(8) if sum(any(tracks._haversine(y, x, v, u) <= 30 for t, y, x in pts if t == s) for q, _, v, u in vs if q == r) >= 0.7 * 4}
    assert got == want and want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copied_sides_are_never_broadcast(spark):
    """A side copied to nine cells is nine times what the planner takes it for."""
    a = spark.range(50).selectExpr("id", "44 + id / 1000 AS lat", "-120 + id / 1000 AS lng")
    b = a.selectExpr("id AS id2", "lat AS lat2", "lng AS lng2")
    lines = a.selectExpr("id AS line_id", "array(named_struct('lng', lng, 'lat', lat), named_struct('lng', lng + 0.01, 'lat', lat)) AS path")
    for df in (spatial.within_distance(a, b, 500.0, right_xy=("lat2", "lng2")), spatial.points_near_lines(a, lines, 300.0, "line_id")):
        assert "Broadcast" not in _plan(df) and df.count() > 0


def test_reference_match_meets_no_rows_of_other_names_far_off(spark):
    """What is within the wide radius only is joined by its name; the broadcast by external id is gone."""
    c = spark.range(40).selectExpr("id", "id AS ext", "concat('n', id % 3) AS name", "44 + id / 2000 AS lat", "-120.0D AS lng")
    r = c.selectExpr("id AS ref_id", "CASE WHEN id % 10 = 0 THEN id END AS ref_ext", "name AS ref_name", "lat + 0.0016 AS ref_lat", "lng AS ref_lng")
    got = spatial.reference_match(r, c)
    plan = _plan(got)
    assert "Broadcast" not in plan and "lower(ref_name" in "".join(x for x in plan.splitlines() if "SortMergeJoin" in x)
    by = {x.ref_id: (x.id, x.kind) for x in got.collect()}
    assert len(by) == 40 and by[20] == (20, 1) and by[1] == (4, 2) and by[39] == (39, 3)


def test_near_components_equal_those_of_all_pairs(spark, monkeypatch):
    import math
    import random

    from switchback.operators import graph

    rng = random.Random(5)
    rows = [(k, 44 + rng.random() * 0.4, -120 + rng.random() * 0.4, f"n{k % 3}") for k in range(240)] + [(1000 + k, 45.5 + k * 1e-5, -119.0, "n0") for k in range(200)] + [(2000, 44.0, None, "n0"), (2001, 44.0, -120.0, None)]
    df = spark.createDataFrame(rows, "id long, lat double, lng double, name string")
    up = {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    def metres(p, q):
        a = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(a))

    good = [r for r in rows if r[2] is not None and r[3] is not None]
    linked = set()
    for i, p in enumerate(good):
        for q in good[:i]:
            if p[3] == q[3] and metres(p, q) <= 3500:
                linked |= {p[0], q[0]}
                a, b = root(p[0]), root(q[0])
                up[max(a, b)] = min(a, b)
    sizes = []
    whole = graph.components
    monkeypatch.setattr(graph, "components", lambda e, *a: (sizes.append(e.count()), whole(e, *a))[1])
    got = {r.node: r.root for r in spatial.near_components(df, 3500.0, ["name"], 50).collect()}
    assert got == {k: root(k) for k in linked} and len(set(got.values())) > 10
    assert max(sizes) < 2000  # all pairs are over 20,000, nearly all of them of one crowd
