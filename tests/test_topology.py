import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from switchback.operators import topology

AREAS = "area_id long, rings array<array<struct<lng:double,lat:double>>>"


def wiggle(a, b, n, rng, by):
    """A line from a to b with n vertices between, off by up to `by`; the same for both directions."""
    if a > b:
        return wiggle(b, a, n, rng, by)[::-1]
    r = random.Random(f"{a}{b}{rng}")
    return [a, *[(a[0] + (b[0] - a[0]) * k / (n + 1) + r.uniform(-by, by), a[1] + (b[1] - a[1]) * k / (n + 1) + r.uniform(-by, by)) for k in range(1, n + 1)], b]


def grid(n, by, many=30):
    out = []
    for i in range(n):
        for j in range(n):
            c = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
            c = [(x * 0.3, 45 + y * 0.3) for x, y in c]
            ring = [p for k in range(4) for p in wiggle(c[k], c[(k + 1) % 4], many, 1, by)[:-1]]
            out.append((i * n + j, [ring if (i + j) % 2 else ring[7:] + ring[:7]]))
    return out


def area(r):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) / 2


def edges(rows):
    c = Counter()
    for _, rings in rows:
        for r in rings:
            c.update(frozenset(e) for e in zip(r, r[1:]))
    return c


def collect(df):
    return sorted((r.area_id, [[(p.lng, p.lat) for p in ring] for ring in r.rings]) for r in df.collect())


def test_neighbours_fit_together(spark):
    made = grid(3, 0.004)
    island = [(0.1 + 0.05 * math.cos(k / 8), 45.1 + 0.05 * math.sin(k / 8)) for k in range(50)]
    made[0][1].append(island)  # a hole that another area fills
    made.append((77, [island[::-1] + island[-1:]]))
    df = spark.createDataFrame(made, AREAS)
    got = collect(topology.simplified_areas(df, limit=F.lit(0.01)))
    assert [r[0] for r in got] == sorted(r[0] for r in made) and all(r[0] == r[-1] for _, rings in got for r in rings)
    before, after = sum(len(r) for _, x in made for r in x), sum(len(r) for _, x in got for r in x)
    assert after < before / 4
    count = edges(got)
    assert set(count.values()) == {1, 2} and count.total() == 2 * sum(v == 2 for v in count.values()) + sum(v == 1 for v in count.values())
    outer = [e for e, v in count.items() if v == 1]
    assert all(min(abs(p[0]), abs(p[0] - 0.9), abs(p[1] - 45), abs(p[1] - 45.9)) < 0.01 for e in outer for p in e)
    assert sum(abs(area(rings[0])) for _, rings in got) - 2 * abs(area(got[-1][1][0])) == pytest.approx(0.81 - abs(area(got[-1][1][0])), abs=0.02)
    vertices = {p for _, rings in made for r in rings for p in r}
    assert all(p in vertices for _, rings in got for r in rings for p in r)


def test_borders_that_would_cross_keep_more_vertices(spark):
    """A narrow strip between two wide waves: at the full tolerance its borders would meet."""
    n = 60
    low = [(k / n, 45 + 0.02 * math.sin(k / 4)) for k in range(n + 1)]
    high = [(x, y + 0.002) for x, y in low]
    made = [(1, [low + high[::-1]]), (2, [[(0.0, 44.9), (1.0, 44.9)] + low[::-1]])]
    df = spark.createDataFrame(made, AREAS)
    got = collect(topology.simplified_areas(df, limit=F.lit(0.05)))
    assert topology.crossing(topology.arcs(spark.createDataFrame(got, AREAS))[1], "path").count() == 0
    assert len(got[0][1][0]) < 2 * n and area(got[0][1][0]) == pytest.approx(area(made[0][1][0] + made[0][1][0][:1]), rel=0.6)
    shared = set(edges([got[0]])) & set(edges([got[1]]))
    assert len(shared) >= 3


def test_tolerance_small_rings_and_empty_tables(spark):
    made = [(1, [[(0, 45), (3, 45), (3, 46), (0, 46)]]), (2, [[(0, 50), (1e-3, 50), (1e-3, 50.0005)]]), (3, [[(5.0, 5.0), (5.0, 5.0)]]), (4, [[(0, 0), (60, 0), (60, 1)]])]
    df = spark.createDataFrame([(i, [[(float(x), float(y)) for x, y in r] for r in rings]) for i, rings in made], AREAS)
    assert [round(r.t, 6) for r in df.orderBy("area_id").select(topology.tolerance("rings").alias("t")).collect()] == [0.002, 0.00005, 0.00005, 0.02]
    got = dict(collect(topology.simplified_areas(df)))
    assert set(got) == {1, 2, 4} and len(got[2][0]) == 4
    assert topology.simplified_areas(df.where("false")).count() == 0


def test_thinning_keeps_within_the_limit():
    rng = np.random.default_rng(1)
    line = np.cumsum(rng.normal(0, 1, (200, 2)), axis=0)
    got = topology.thinned(line, 2.0)
    at = [int(np.flatnonzero((line == p).all(axis=1))[0]) for p in got]
    for a, b in zip(at, at[1:]):
        d = line[b] - line[a]
        p = line[a : b + 1] - line[a]
        t = np.clip(p @ d / (d @ d), 0, 1)
        assert np.hypot(*(p - t[:, None] * d).T).max() <= 2.0
