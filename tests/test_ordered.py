import random

import numpy as np

from switchback.operators import ordered


def walk(rng, n):
    return np.cumsum(np.array([(rng.uniform(0.001, 0.01), rng.uniform(-0.01, 0.01)) for _ in range(n)]), axis=0)


def test_chain_puts_any_cut_together_again():
    rng = random.Random(1)
    for _ in range(300):
        line = walk(rng, rng.randrange(2, 30))
        cuts = sorted(rng.sample(range(1, len(line) - 1), min(rng.randrange(5), len(line) - 2)))
        parts = [line[a : b + 1] for a, b in zip([0, *cuts], [*cuts, len(line) - 1])]
        turned = [p[::-1] if rng.random() < 0.5 else p for p in parts]
        rng.shuffle(turned)
        got = ordered.chain(turned)
        first = turned[0]
        forward = any(len(first) == len(p) and (first == p).all() for p in parts)
        assert (got == (line if forward else line[::-1])).all()


def test_gaps_forks_rings_and_points():
    a, b, c = np.array([(0, 0), (1, 0.0)]), np.array([(1, 0), (2, 0.0)]), np.array([(1, 0), (1, 1.0)])
    assert ordered.chain([a, c + 5]) is None and ordered.chain([a, b, c]) is None and ordered.chain([]) is None
    assert ordered.chain([a, np.array([(9, 9.0)])]).tolist() == a.tolist()
    ring = np.array([(0, 0), (1, 0), (1, 1), (0, 0.0)])
    assert ordered.chain([ring]).tolist() == ring.tolist() and ordered.chain([ring, b + [0, 0.0]]) is None
    assert len(ordered.chain([ring[:3], ring[2:]])) == 4


def test_repeated_and_reversed_places(spark):
    point = "struct<lng:double,lat:double>"
    there_and_back = [[(0.0, 45.0), (0.01, 45.0)], [(0.01, 45.0), (0.01, 45.001), (0.0, 45.001)]]
    parts = [(1, 0, there_and_back[0]), (1, 1, there_and_back[1]), (2, 0, there_and_back[1][::-1]), (2, 1, there_and_back[0]), (3, 0, there_and_back[0]), (3, 1, [(5.0, 45.0), (5.1, 45.0)]), (4, 0, None)]
    lines = ordered.merged_lines(spark.createDataFrame(parts, f"plan_id long, place int, path array<{point}>"), "plan_id", "place")
    assert sorted((r.plan_id, r.piece, len(r.path), r.whole) for r in lines.collect()) == [(1, 0, 4, True), (2, 0, 4, True), (3, 0, 2, False), (3, 1, 2, False)]
    plans = lines.selectExpr("plan_id", "piece", "'u1' AS user_id", "path", "whole")
    places = [(10, "peaks", ["waterfall"], 45.0004, 0.002), (11, "u1", ["summit"], 45.0, 0.008), (12, "u2", ["summit"], 45.0, 0.008), (13, "peaks", None, 45.001, 0.002), (13, "peaks", None, 45.001, 0.002), (14, "peaks", ["summit"], None, 0.0)]
    d = spark.createDataFrame(places, "destination_id long, owner string, features array<string>, lat double, lng double")
    got = {}
    for r in ordered.places_along(plans, d.distinct()).orderBy("plan_id", "ordinal").collect():
        got.setdefault(r.plan_id, []).append(r.destination_id)
    assert got == {1: [10, 11, 13], 2: [13, 11, 10], 3: [10, 11]}


def test_plans_are_never_broadcast(spark):
    line = "array(named_struct('lng', id / 100, 'lat', 45.0D), named_struct('lng', id / 100 + 0.01D, 'lat', 45.0D))"
    plans = spark.range(5).selectExpr("id AS plan_id", "'u' AS user_id", "0 AS piece", f"{line} AS path", "true AS whole")
    places = spark.range(5).selectExpr("id AS destination_id", "'peaks' AS owner", "array('summit') AS features", "45.0D AS lat", "id / 100 + 0.005D AS lng")
    got = ordered.places_along(plans, places)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 5
