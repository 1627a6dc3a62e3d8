import math

import pytest
from pyspark.sql import functions as F

from switchback.functions import elevation, geo, text, times


def one(spark, col, **values):
    types = {float: "double", int: "int", str: "string", type(None): "double"}
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v).cast(types[type(v)]) if not isinstance(v, list) else F.array(*[F.lit(float(x)) if x is not None else F.lit(None).cast("double") for x in v]).cast("array<double>"))
    return df.select(col.alias("x")).first().x


def test_trigram_set(spark):
    assert one(spark, F.array_sort(text.trigrams(F.lit("cat")))) == ["  c", " ca", "at ", "cat"]
    assert one(spark, text.similarity(F.lit(""), F.lit(""))) == 0
    assert one(spark, text.similarity(F.lit("Café"), F.lit("café"))) == 1


@pytest.mark.parametrize("raw,want", [("Mt St Helens", "mount saint helens"), ("  NE  Fk ", "northeast fork"), ("Lakeview", "lakeview")])
def test_search_name(spark, raw, want):
    assert one(spark, text.search_name(F.lit(raw))).strip() == want


def test_names(spark):
    assert one(spark, text.peak_name(F.lit("Pic d'Éclair (N)"))) == "pic d eclair n"
    assert one(spark, text.trailhead_name(F.lit("Blue Lake Trailhead Parking Lot"))) == "blue lake"
    assert one(spark, text.tokens_contained(F.lit("blue lake"), F.lit("upper blue lake"))) is True
    assert one(spark, text.tokens_contained(F.lit("lake"), F.lit("upper blue lake"))) is False
    assert one(spark, text.is_named_route(F.lit("Track 12"))) is False
    assert one(spark, text.is_named_route(F.lit(None).cast("string"))) is False
    assert one(spark, text.shorten(F.lit("One. Two is longer."), 8)) == "One."


def test_polyline_and_tokens(spark):
    df = spark.createDataFrame([([(45.123456, -119.5), (45.2, -119.6)],), (None,)], "p array<struct<lat:double,lng:double>>")
    got = [r.x for r in df.select(text.decode_polyline6(text.encode_polyline6("p")).alias("x")).collect()]
    assert [(p.lat, p.lng) for p in got[0]] == [(45.123456, -119.5), (45.2, -119.6)] and got[1] is None
    z = spark.createDataFrame([(1e10,), (0.1,), (-0.0,), (float("nan"),), (1234.5,), (1e-7,)], "z double")
    assert [r.x for r in z.select(text.elevation_token("z").alias("x")).collect()] == ["10000000000", "0.1", "0", None, "1234.5", "0.0000001"]


def test_haversine_and_wrap(spark):
    a = one(spark, geo.haversine_m(45.0, -119.0, 45.0, -118.0))
    assert a == pytest.approx(78_626, rel=1e-3) and one(spark, geo.haversine_atan2_m(45.0, -119.0, 45.0, -118.0)) == pytest.approx(a)
    assert one(spark, geo.haversine_wrapped_m(0.0, 179.9, 0.0, -179.9)) == pytest.approx(22_239, rel=1e-3)


@pytest.mark.parametrize("lat,lng,want", [(44.2701, -71.3033, "1476:-2377"), (39.0, -120.0, "1300:-4000")])
def test_grid_cell_vectors(spark, lat, lng, want):
    assert one(spark, geo.snap_cell(lat, lng)) == want


def test_polygon_with_hole(spark):
    ring = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("lng"), F.lit(float(y)).alias("lat")) for x, y in p])
    shape = F.array(ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (2, 1), (2, 2), (1, 2)))
    assert one(spark, geo.in_polygon(F.lit(3.0), F.lit(3.0), shape)) is True
    assert one(spark, geo.in_polygon(F.lit(1.5), F.lit(1.5), shape)) is False
    assert one(spark, geo.polygon_distance_m(F.lit(0.5), F.lit(5.0), shape)) == pytest.approx(111_320, rel=1e-2)
    assert one(spark, geo.ring_area_m2(ring((0, 0), (1, 0), (1, 1), (0, 1)))) == pytest.approx(111_320**2, rel=1e-2)


def fold(z, band=4.0):
    gain = loss = run = 0.0
    for a, b in zip(z, z[1:]):
        d = b - a
        if (run >= 0 and d >= 0) or (run <= 0 and d <= 0):
            run += d
        else:
            gain, loss = gain + (run if run > band else 0), loss + (-run if run < -band else 0)
            run = d
    return gain + (run if run > band else 0), loss + (-run if run < -band else 0)


@pytest.mark.parametrize("z", [[0, 10, 10, 8, 20], [5, 5, 5], [0, 4, 0], [0, 5, 1, 6, 0], [100, 90, 95, 80]])
def test_gain_by_reversals(spark, z):
    got = one(spark, elevation.gain_loss("z"), z=z)
    assert (got.gain, got.loss) == pytest.approx(fold(z))


def test_gain_of_bad_profiles(spark):
    assert one(spark, elevation.gain_loss("z"), z=[1]) is None
    assert one(spark, elevation.gain_loss("z"), z=[1, None, 3]) is None
    assert one(spark, elevation.gain_loss("z"), z=[1, float("nan"), 3]) is None
    assert tuple(one(spark, elevation.smoothed_stats("z"), z=[])) == (0, 0, 0, 0)


def test_smoothing_matches_two_passes(spark):
    z, a = [0.0, 10.0, 0.0, 30.0, 5.0], 0.3
    f = [z[0]]
    for x in z[1:]:
        f.append(a * x + (1 - a) * f[-1])
    b = [0.0] * 5
    b[-1] = z[-1]
    for i in (3, 2, 1, 0):
        b[i] = a * f[i] + (1 - a) * b[i + 1]
    b[0], b[-1] = z[0], z[-1]
    assert one(spark, elevation.smooth("z"), z=z) == pytest.approx(b)


def test_seasons(spark):
    w = lambda *x: F.array(*[F.struct(F.lit(a).alias("opens"), F.lit(b).alias("closes")) for a, b in x])
    assert [tuple(r) for r in one(spark, times.season_intersection(w((300, 50), (320, 100))))] == [(320, 50)]
    assert [tuple(r) for r in one(spark, times.season_intersection(w((1, 50), (60, 100))))] == []
    assert [tuple(r) for r in one(spark, times.season_intersection(w((1, 366))))] == [(1, 366)]
    assert [tuple(r) for r in one(spark, times.parse_windows(F.lit("open 5/15-11/30; 12/15-1/2")))] == [(136, 335), (350, 2)]
    assert one(spark, times.compass(F.lit(359.0))) == "N"
    assert math.isclose(one(spark, geo.terrain_m(F.lit(128), F.lit(1), F.lit(128))), 1.5)


def test_season_intersection_equals_sets_of_days(spark):
    import random

    rng = random.Random(8)
    days = lambda o, c: set(range(o, c + 1)) if o <= c else set(range(o, 367)) | set(range(1, c + 1))
    rows = [[(rng.randrange(1, 367), rng.randrange(1, 367)) for _ in range(rng.randrange(1, 4))] for _ in range(150)] + [[(51, 50), (40, 60)], [(51, 50)], [(366, 1)]]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(rows)], "k int, w array<struct<opens:int,closes:int>>")
    for r in df.select("k", times.season_intersection("w").alias("v")).collect():
        want = set.intersection(*(days(*x) for x in rows[r.k]))
        got = [days(*x) for x in r.v]
        assert set().union(*got) == want and sum(map(len, got)) == len(want)
        starts = 1 if len(want) == 366 else sum((d - 2) % 366 + 1 not in want for d in want)
        assert len(got) == starts
