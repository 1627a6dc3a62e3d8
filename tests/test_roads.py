import heapq
import random

import pytest

from switchback.operators import roads

EDGES = "edge_id long, from_node long, to_node long, rank int, miles double, anchor boolean"
NODES = "node long, lat double, lng double"
ORIGINS = "origin long, lat double, lng double, edge_id long, share double"


def metres(a, b):
    from math import asin, cos, radians, sin, sqrt

    h = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * asin(min(1, sqrt(h)))


def brute(origin, edges, nodes, reach_m, max_miles):
    """(rank, miles): for each rank the shortest way over edges up to it, by a heap."""
    _, lat, lng, snap, share = origin
    by_id = {e[0]: e for e in edges}
    size = lambda e: e[4] if e[4] is not None else metres(nodes[e[1]], nodes[e[2]]) / 1609.344
    rank = lambda e: 7 if e[3] is None else e[3]
    if by_id[snap][5]:
        return rank(by_id[snap]), 0.0
    ends = {n for e in edges if e[5] for n in e[1:3]}
    for top in range(rank(by_id[snap]), 8):
        s = by_id[snap]
        heap, done = [(size(s) * share, s[1]), (size(s) * (1 - share), s[2])], set()
        heapq.heapify(heap)
        while heap:
            m, n = heapq.heappop(heap)
            if m > max_miles or n in done:
                continue
            done.add(n)
            if n in ends:
                return top, m
            for e in edges:
                if n in e[1:3] and e[0] != snap and rank(e) <= top:
                    to = e[2] if n == e[1] else e[1]
                    if to not in done and to in nodes and metres((lat, lng), nodes[to]) <= reach_m:
                        heapq.heappush(heap, (m + size(e), to))
    return None


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_equal_a_heap_s(spark, seed):
    rng = random.Random(seed)
    nodes = {k: (46 + rng.uniform(0, 0.2), -115 + rng.uniform(0, 0.2)) for k in range(60)}
    edges = []
    for k in range(110):
        a, b = rng.randrange(62), rng.randrange(60)  # some loops, double edges and ends without a place
        edges.append((k, a, b, rng.choice([None, 1, 2, 2, 3, 5, 6]), rng.choice([None, 0.5, 1.0, 2.5, 7.0]) if a < 60 else 1.0, rng.random() < 0.06))
    usable = [e for e in edges if e[1] < 60]
    origins = [(i, *nodes[e[1]], e[0], rng.uniform(-0.1, 1.1)) for i, e in enumerate(rng.sample(usable, 30))]
    got = {r.origin: (r.rank, r.miles) for r in roads.approach_paths(spark.createDataFrame(origins, ORIGINS), spark.createDataFrame(edges, EDGES), spark.createDataFrame([(k, *v) for k, v in nodes.items()], NODES), 12_000.0, 9.0).collect()}
    want = {o[0]: x for o in origins if (x := brute((*o[:4], min(1, max(0, o[4]))), usable, nodes, 12_000.0, 9.0))}
    assert got.keys() == want.keys() and 5 < len(want) < 30
    for k, (rank, miles) in want.items():
        assert got[k][0] == rank and got[k][1] == pytest.approx(miles)


def test_a_gentle_detour_beyond_the_bound_leaves_the_short_one(spark):
    nodes = spark.createDataFrame([(k, 46.0, -115.0 + k / 1000) for k in range(6)], NODES)
    edges = [(1, 0, 1, 1, 1.0, False), (2, 1, 2, 1, 8.0, False), (3, 1, 2, 4, 1.0, False), (4, 2, 3, 1, 2.0, False), (5, 3, 4, 1, 1.0, True), (6, 5, 5, 1, 1.0, False)]
    origins = [(1, 46.0, -115.0, 1, 1.0), (2, 46.0, -115.0, 5, 0.5), (3, 46.0, -115.0, 6, 0.5), (4, 46.0, -115.0, None, None)]
    o, e = spark.createDataFrame(origins, ORIGINS), spark.createDataFrame(edges, EDGES)
    got = {r.origin: r for r in roads.approach_paths(o, e, nodes, max_miles=9.0).collect()}
    assert (got[1].rank, got[1].miles, got[1].limiting, got[1].anchor_edge, got[1].node) == (4, 3.0, 3, 5, 3)
    assert (got[2].rank, got[2].miles, got[2].anchor_edge, got[2].node) == (1, 0.0, 5, None) and 3 not in got
    far = roads.approach_paths(o, e, nodes, max_miles=60.0)
    assert far.where("origin = 1").first().rank == 1
    said = {r.origin: (r.vehicle, r.high_clearance, r.four_wheel_drive, r.skip_reason) for r in roads.approach_answers(o, roads.approach_paths(o, e, nodes, max_miles=9.0)).collect()}
    assert said == {1: ("four_wheel_drive_high_clearance", "required", True, None), 2: ("passenger_car", "not_required", False, None), 3: (None, None, None, "no_anchor"), 4: (None, None, None, "no_snap")}
    assert roads.approach_paths(o.where("false"), e, nodes).count() == 0


def test_nodes_are_never_broadcast(spark):
    """A graph's nodes are few bytes in a file and many in memory."""
    e = spark.range(9).selectExpr("id AS edge_id", "id AS from_node", "id + 1 AS to_node", "1 AS rank", "CAST(NULL AS DOUBLE) AS miles", "false AS anchor")
    n = spark.range(10).selectExpr("id AS node", "46 + id / 100 AS lat", "-115.0D AS lng")
    got = roads.measured(e, n)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and got.where("miles > 0").count() == 9
