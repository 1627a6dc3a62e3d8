import pytest
from pyspark.sql import functions as F

from switchback.operators import areas

RINGS = "array<array<struct<lng:double,lat:double>>>"


def box(w, s, e, n):
    return [[(w, s), (e, s), (e, n), (w, n)]]


def test_parents_by_share(spark):
    rows = [(1, 0.0, 0.0, 1.0, 1.0), (2, 0.0, 0.0, 1.08, 1.0), (3, 0.5, 0.0, 1.5, 1.0), (9, 0.0, 0.0, 1.0, 1.0)]
    t = spark.createDataFrame([(i, s, n, w, e, box(w, s, e, n)) for i, w, s, e, n in rows], f"area_id long, south double, north double, west double, east double, rings {RINGS}")
    got = {r.area_id: (r.parent_id, r.share) for r in areas.parents(t.where("area_id < 9"), t.where("area_id = 9")).collect()}
    assert got[1] == (9, 1.0) and got[2][1] == pytest.approx(1 / 1.08, abs=0.04) and 3 not in got


def test_rings_from_lines(spark):
    p = lambda *x: [(a, b) for a, b in x]
    rows = [(1, 0, p((0.0, 0.0), (1.0, 0.0))), (1, 1, p((1.0, 1.0), (1.0, 0.0))), (1, 2, p((1.0, 1.0), (0.0, 1.0), (0.0, 0.0))), (2, 0, p((5.0, 5.0), (6.0, 5.0)))]
    got = areas.rings_from_lines(spark.createDataFrame(rows, "lake_id long, seq int, path array<struct<lng:double,lat:double>>")).collect()
    assert [(r.lake_id, len(r.ring)) for r in got] == [(1, 5)]


def test_settlement(spark):
    ledger = spark.createDataFrame([(1, 11, "queued"), (2, 12, "queued"), (3, 13, "covered"), (4, 14, "covered")], "old_id long, new_id long, state string")
    checks = spark.createDataFrame([(11, True), (12, False)], "route_id long, passes boolean")
    live = spark.createDataFrame([(1,), (2,), (4,)], "route_id long")
    got = {r.old_id: r.state for r in areas.settle_replacements(ledger, checks, live).collect()}
    assert got == {1: "covered", 2: "queued", 3: "retired", 4: "covered"}
    assert areas.settle_replacements(ledger.where(F.lit(False)), checks, live).count() == 0
