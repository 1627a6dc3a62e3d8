import random

import numpy as np
from pyspark.sql import functions as F

from switchback.functions import elevation, text
from switchback.operators import pages, spatial, tracks


def test_plan_pages_see_owned_and_joined_plans_once(spark):
    plans = spark.createDataFrame([(1, 7, 5), (2, 7, 9), (3, 8, None), (4, 9, 9)], "plan_id int, user_id int, updated_at int")
    places = spark.createDataFrame([(1, 30, 1), (1, 10, 2), (1, 20, None)], "plan_id int, destination_id int, ordinal int")
    party = spark.createDataFrame([(3, 7, 1), (1, 7, 1), (1, 8, 0)], "plan_id int, user_id int, joined_at int")
    page = lambda **k: {(r.viewer, r.place): r for r in pages.plan_pages(plans, {"destination_id": places}, party, **k).collect()}
    got = page()
    assert {k: r.plan_id for k, r in got.items()} == {(7, 1): 2, (7, 2): 1, (7, 3): 3, (8, 1): 1, (8, 2): 3, (9, 1): 4}
    assert got[7, 2].destination_ids == [30, 10, 20] and got[7, 2].party == [8, 7] and got[7, 2].party_count == 2
    assert got[9, 1].destination_ids == [] and got[9, 1].destination_ids_count == 0
    assert {k: r.plan_id for k, r in page(limit=1, offset=1).items()} == {(7, 2): 1, (8, 2): 3}
    assert len(page(limit=-5)) == 3 and len(page(limit=10_000, offset=-1)) == 6


def test_reports_without_parts_have_empty_ones(spark):
    rows = spark.createDataFrame([(1, 11, 7), (2, 12, 8), (3, None, None)], "report_id int, session_id int, user_id int")
    sessions = spark.createDataFrame([(11,)], "id int")
    parts = spark.createDataFrame([(1, "ice", 2), (1, "mud", 1), (1, None, 3)], "report_id int, code string, ordinal int")
    ids = spark.createDataFrame([(2, 5), (2, 4)], "report_id int, destination_id int")
    got = {r.report_id: r for r in pages.reports(rows, sessions, {"conditions": (parts, {"code": "code"}, ["ordinal"])}, {"places": (ids, "destination_id")}, F.lit(7)).collect()}
    assert got[1].conditions == '[{"code":"mud"},{"code":"ice"},{}]' and got[1].session_available and got[1].is_owner and got[1].places == []
    assert got[2].conditions == "[]" and not got[2].session_available and not got[2].is_owner and got[2].places == [4, 5]
    assert not got[3].session_available and not got[3].is_owner


def test_visibility_and_masks(spark):
    s = spark.createDataFrame([(1, 7, True), (2, 7, False), (3, 8, True), (4, 8, False), (5, None, None)], "id int, user_id int, is_public boolean")
    assert [r.id for r in s.where(pages.visible(F.lit(7))).orderBy("id").collect()] == [1, 2, 3]
    assert [r.id for r in s.where(pages.visible(F.lit(None).cast("int"))).orderBy("id").collect()] == [1, 3]
    assert [r.m for r in s.orderBy("id").select(pages.masked("id", F.lit(7)).alias("m")).collect()] == [1, 2, None, None, None]


def test_numbers_by_ranges_equal_one_window(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.randrange(40), k) for k in range(3000)], "a int, b int").repartition(7)
    got = [tuple(r) for r in pages.numbered(df, ["a", "b"], "n").orderBy("n").collect()]
    assert [r[2] for r in got] == list(range(1, 3001)) and [r[:2] for r in got] == sorted(r[:2] for r in got)
    text = pages.numbered(df, ["a", "b"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__part" in text or "Window" in text
    assert pages.numbered(df.where("false"), ["a"], "n").count() == 0


def test_overlaps_come_once(spark):
    rng = random.Random(2)
    make = lambda: [(k, k % 3, lo := rng.randrange(100), lo + rng.choice([0, 1, 5, 40])) for k in range(80)]
    a, b = make(), make()
    da, db = spark.createDataFrame(a, "id int, g int, lo int, hi int"), spark.createDataFrame(b, "id2 int, g int, lo2 int, hi2 int")
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and min(x[3], y[3]) > max(x[2], y[2]))
    for width in (1.0, 7.0, 1000.0):
        assert sorted((r.id, r.id2) for r in pages.overlapping(da, db, ["g"], width).collect()) == want


def test_name_dedupe_equals_the_fold_over_all(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "b", "Unnamed", None]), 45 + rng.uniform(0, 0.05), -120 + rng.uniform(0, 0.05)) for k in range(250)] + [(900, "a", None, None)]
    kept = []
    for k, n, y, x in rows:
        if n is None or y is None or not any(m == n and tracks._haversine(np.float64(y), np.float64(x), v, u) <= 900 for _, m, v, u in kept if v is not None):
            kept.append((k, n, y, x))
    got = spatial.greedy_name_dedupe(spark.createDataFrame(rows, "id int, name string, lat double, lng double").repartition(5), 900.0, max_lat=50)
    assert sorted(r.id for r in got.collect()) == sorted(k[0] for k in kept) and len(kept) < 250


def ema(p, first, a=0.3):
    out = [first]
    for z in p[1:]:
        out.append(a * z + (1 - a) * out[-1])
    return out


def test_smoothed_and_anchored_gains_equal_loops(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 40, 300):
        p = np.cumsum(rng.normal(0, 6, n)).tolist()
        s = [p[0], *ema(ema(p, p[0])[::-1], p[-1])[::-1][1:-1], p[-1]] if n > 2 else p  # the way back begins at the raw end
        med = [sorted(p[max(0, i - 2) : i + 3])[len(p[max(0, i - 2) : i + 3]) // 2] for i in range(n)]
        avg = [float(np.mean(med[max(0, i - 3) : i + 4])) for i in range(n)]
        gain, anchor = 0.0, avg[0]
        for z in avg:
            if abs(z - anchor) >= 3:
                gain, anchor = gain + max(0, z - anchor), z
        r = spark.createDataFrame([(p,)], "p array<double>").select(elevation.smoothed_stats(F.col("p")).alias("s"), elevation.anchored_gain(F.col("p")).alias("g"), elevation.smooth(F.col("p")).alias("x")).first()
        assert np.allclose(r.x, s) and np.isclose(r.g, gain) and np.isclose(r.s.max, max(s)) and np.isclose(r.s.min, min(s))


def test_simplified_lines_stay_within_the_tolerance(spark):
    rng = np.random.default_rng(5)
    y, x = 45 + np.cumsum(rng.normal(0, 2e-4, 300)), np.cumsum(rng.normal(0, 2e-4, 300))
    p = spark.createDataFrame([(1, k, k, float(a), float(b)) for k, (a, b) in enumerate(zip(y, x))], "session_id long, time long, event_id long, lat double, lng double")
    at = sorted(r.time for r in tracks.simplify(p, 60.0).collect())
    k = np.cos(np.radians(y.mean()))
    xy = np.stack([x * k, y], 1) * 111_320
    assert at[0] == 0 and at[-1] == 299 and len(at) < 200
    for a, b in zip(at, at[1:]):
        d, q = xy[b] - xy[a], xy[a : b + 1] - xy[a]
        t = np.clip(q @ d / (d @ d), 0, 1)
        assert np.hypot(*(q - t[:, None] * d).T).max() <= 60.0 + 1e-6


def test_polylines_come_back(spark):
    rng = random.Random(6)
    path = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(50)]
    r = spark.createDataFrame([(path,)], "p array<struct<lat:double,lng:double>>").select(text.decode_polyline6(text.encode_polyline6("p")).alias("q")).first()
    assert np.allclose([tuple(v)[:2] if isinstance(v, (list, tuple)) else (v.lat, v.lng) for v in r.q], path, atol=6e-7)


def test_anchored_gain_of_a_long_profile(spark):
    """Filters are computed once a profile: 20,000 points take seconds, not the square of that."""
    import time

    z = [1000.0 + k % 50 for k in range(20_000)]
    df = spark.createDataFrame([(z,)], "p array<double>")
    t = time.time()
    assert df.select(elevation.anchored_gain(F.col("p")).alias("g")).first().g > 10_000
    assert time.time() - t < 20
