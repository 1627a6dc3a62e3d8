import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from switchback.operators import dedupe, raster, tracks, trees


def test_duplicates_chain_and_bridges_have_no_orphan(spark):
    places = [(5, "Rock ", "A", 45.0, -120.0, {"x": "5", "o": "five"}), (3, "rock", "A", 45.0, -120.001, {"x": "3"}), (9, "ROCK", "A", 45.0, -120.002, {"y": "9", "o": "nine"}), (1, "rock", "B", 45.0, -120.0, None), (2, "rock", None, 45.0, -120.0, {}), (4, "rock", None, 45.0, -120.0, {"z": "4"}), (6, " ", "A", 45.0, -120.0, None), (7, "", "A", 45.0, -120.0, None), (8, "rock", "A", None, None, None), (10, None, "A", 45.0, -120.0, None)]
    df = spark.createDataFrame(places, "id long, name string, state string, lat double, lng double, external_ids map<string,string>")
    dup = dedupe.duplicates(df, 100.0)
    assert {(r.id, r.keep) for r in dup.collect()} == {(5, 3), (9, 3), (4, 2)}
    got = {r.id: r.external_ids for r in dedupe.merged_places(df, dup).collect()}
    assert got == {3: {"x": "3", "y": "9", "o": "nine"}, 1: None, 2: {"z": "4"}, 6: None, 7: None, 8: None, 10: None}
    bridge = spark.createDataFrame([(1, 3, "own"), (1, 5, "a"), (2, 9, "b"), (2, 5, "c"), (3, 4, "d"), (3, 1, "e")], "list_id long, destination_id long, note string")
    assert sorted(map(tuple, dedupe.rekeyed(bridge, dup, ["list_id"]).collect())) == [(1, 3, "own"), (2, 3, "c"), (3, 1, "e"), (3, 2, "d")]
    assert dedupe.duplicates(df.where("false"), 100.0).count() == 0


def plain_merge(existing, incoming):
    """The rule as a loop over documents."""
    out = [dict(e) for e in existing]
    key = lambda c: tuple("" if c.get(k) is None else c[k] for k in dedupe.SCOPE)
    for c in incoming:
        at = next((k for k, e in enumerate(out) if key(e) == key(c)), None)
        if at is None:
            out.append(dict(c))
            continue
        e = out[at]
        types = sorted({*(e.get("contribution_types") or []), *(c.get("contribution_types") or [])})
        out[at] = {**e, **{k: v for k, v in c.items() if v is not None}, "contribution_types": types}
    return out


def test_contributions_equal_the_loop(spark):
    rng = random.Random(3)
    cols = [*dedupe.SCOPE, "contribution_types", "summary"]
    pick = lambda: {**{k: None for k in cols}, "source": rng.choice(["a", "b", None]), "external_id": rng.choice(["1", "", None]), "contribution_types": rng.choice([None, [], ["t", "s"], ["u"]]), "summary": rng.choice([None, "x", "y"])}
    sides = {k: ([pick() for _ in range(rng.randrange(4))], [pick() for _ in range(rng.randrange(4))]) for k in range(60)}
    schema = "session_id long, place int, " + ", ".join(f"{c} string" for c in dedupe.SCOPE) + ", contribution_types array<string>, summary string"
    df = lambda side: spark.createDataFrame([(k, i, *[c[x] for x in cols]) for k, v in sides.items() for i, c in enumerate(v[side])], schema)
    got = {}
    for r in dedupe.merged_contributions(df(0), df(1)).orderBy("session_id", "place").collect():
        got.setdefault(r.session_id, []).append((r.place, r.source or "", r.external_id or "", r.contribution_types, r.summary))
    want = {k: [(i, c["source"] or "", c["external_id"] or "", c["contribution_types"], c["summary"]) for i, c in enumerate(plain_merge(*v))] for k, v in sides.items()}
    assert got == {k: v for k, v in want.items() if v}


def test_amenities_backfills_and_health(spark):
    leaf = "place_id int, block string, leaf string, value string, kind string"
    cur = spark.createDataFrame([(1, "f", "a", "o", "human"), (1, "f", "b", "o", "agency"), (1, "f", "c", "o", None), (1, "f", "d", "o", "park"), (2, "f", "a", "o", "agency")], leaf)
    new = spark.createDataFrame([(1, "f", x, "n", "park") for x in "abcde"], leaf)
    got = {(r.place_id, r.leaf): (r.value, r.outcome) for r in dedupe.merged_amenities(cur, new, ["agency", "park"], ["park"]).collect()}
    assert got == {(1, "a"): ("o", "preserved"), (1, "b"): ("o", "deferred"), (1, "c"): ("n", "applied"), (1, "d"): ("n", "applied"), (1, "e"): ("n", "applied"), (2, "a"): ("o", "kept")}
    m = spark.createDataFrame([(1, "x", None, 11, "x", 400.0, None), (2, "x", None, 12, "y", 20.0, []), (3, "x", None, 13, "y", 20.0, ["generic_name"]), (4, "x", None, 14, "x", 5.0, None), (4, "x", None, 15, "y", 6.0, None), (5, "x", None, 16, "y", 5.0, None), (5, "x", None, 17, "z", 6.0, None), (6, "x", "has", 18, "x", 1.0, None), (7, None, None, 19, None, 31.0, None)], "destination_id int, name string, external_id string, ref_id int, ref_name string, distance_m double, flags array<string>")
    selected, unclear = dedupe.id_backfills(m)
    assert {(r.destination_id, r.ref_id) for r in selected.collect()} == {(1, 11), (2, 12), (4, 14)} and [r.destination_id for r in unclear.collect()] == [5]
    h = spark.createDataFrame([([100.0, 101.0, 0.0, -5.0, None, float("nan")], [1.4, None, 1.1, -3.0]), ([], None)], "h array<double>, c array<double>")
    assert [tuple(r.s) for r in h.select(dedupe.health_summary(F.col("h"), F.col("c")).alias("s")).collect()] == [(101, 101, 3), (None, None, None)]


def test_documents_are_walked_at_any_depth(spark):
    deep = "1"
    for k in range(30):
        deep = f'{{"k{k}": {deep}}}' if k % 2 else f"[{deep}]"
    docs = [(1, '{"a": {"b": [1, {"c": null, "d.e": "x"}]}, "z": true}'), (2, "[]"), (3, "not json"), (4, None), (5, deep), (6, "7")]
    got = [tuple(r) for r in trees.walk(spark.createDataFrame(docs, "id int, doc string"), "id", "doc").collect()]
    assert sorted(r[1:] for r in got if r[0] == 1) == [(1, "$.a", "a", "OBJECT", None), (1, "$.z", "z", "BOOLEAN", "true"), (2, "$.a.b", "b", "ARRAY", None), (3, "$.a.b[0]", None, "BIGINT", "1"), (3, "$.a.b[1]", None, "OBJECT", None), (4, "$.a.b[1].c", "c", "VOID", None), (4, "$.a.b[1].d.e", "d.e", "STRING", "x")]
    assert {r[0] for r in got} == {1, 5} and max(r[1] for r in got) == 30
    with pytest.raises(ValueError):
        trees.walk(spark.createDataFrame(docs[4:5], "id int, doc string"), "id", "doc", most=9)
    d = spark.createDataFrame([('{"a": {"n": null}, "b": null}',), (None,)], "d string")
    assert [r.x for r in d.select(trees.with_member(F.col("d"), "b", F.lit('[1]')).alias("x")).collect()] == ['{"a":{"n":null},"b":[1]}', '{"b":[1]}']
    assert [r.x for r in d.select(trees.without_nulls(F.col("d")).alias("x")).collect()] == ['{"a":{"n":null}}', None]


def test_ancestors(spark):
    n = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9)], "node int, parent int")
    assert sorted(map(tuple, trees.ancestors(n, "node", "parent").collect())) == [(2, 1, 1), (3, 1, 2), (3, 2, 1), (4, 9, 1)]
    with pytest.raises(ValueError):
        trees.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "node int, parent int"), "node", "parent", most=5)


def png(rgb, how):
    """An image whose rows are filtered in one way, by the format's rules."""
    h, w, c = rgb.shape
    flat, out = rgb.astype(np.int64), b""
    for y in range(h):
        row = []
        for x in range(w):
            left = flat[y, x - 1] if x else np.zeros(c, np.int64)
            up = flat[y - 1, x] if y else np.zeros(c, np.int64)
            corner = flat[y - 1, x - 1] if x and y else np.zeros(c, np.int64)
            p = left + up - corner
            paeth = [min((a, b, d), key=lambda v, q=q: abs(q - v)) for a, b, d, q in zip(left, up, corner, p)]
            row.append((flat[y, x] - [np.zeros(c, np.int64), left, up, (left + up) // 2, np.array(paeth)][how]) % 256)
        out += bytes([how]) + np.array(row, np.uint8).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    z = zlib.compress(out)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 6, 0, 0, 0)) + part(b"IDAT", z[:50]) + part(b"IDAT", z[50:]) + part(b"IEND", b"")


def test_png_filters():
    rng = np.random.default_rng(2)
    for c in (3, 4):
        rgb = rng.integers(0, 256, (9, 7, c))
        assert all((raster.decode_png(png(rgb, how)) == rgb).all() for how in range(5))
    with pytest.raises(ValueError):
        raster.decode_png(b"no")


def test_profiles_read_each_tile_once(spark, tmp_path, monkeypatch):
    z = 3
    v = np.zeros((256, 256, 3), np.int64)
    py, px = np.mgrid[0:256, 0:256]
    height = 100 + px + 2 * py
    v[..., 0], v[..., 1] = (height + 32768) >> 8, (height + 32768) & 255
    lng = lambda x, p: (x + p / 256) / 8 * 360 - 180
    lat = lambda y, p: float(np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * (y + p / 256) / 8)))))
    pts = [(1, k, lat(3, 10.5 + k), lng(4, 20.5)) for k in range(50)] + [(2, 0, lat(3, 10.5), lng(4, 0.5)), (2, 1, lat(3, 10.5), lng(6, 1.5))] + [(3, 0, lat(3, 5.5), lng(4, 5.5))] + [(4, 0, lat(3, 7.9), lng(4, 9.25)), (4, 1, lat(3, 7.5), lng(4, 9.5))]
    p = spark.createDataFrame(pts, "route_id long, seq long, lat double, lng double")
    tiles = spark.createDataFrame([(4, 3, png(v, 0)), (6, 3, b"broken"), (1, 1, b"unused")], "x int, y int, data binary")
    got = sorted(map(tuple, raster.profile(p, tiles, zoom=z).collect()))
    assert got == [(1, k, 120.0 + 2 * (10 + k)) for k in range(50)] + [(4, 0, 109.0 + 14), (4, 1, 109.0 + 14)]
    smooth = {r.seq: r.z for r in raster.profile(p.where("route_id = 4"), tiles, zoom=z, bilinear=True).collect()}
    assert smooth[1] == pytest.approx(123.0, abs=0.01) and smooth[0] == pytest.approx(100 + 8.75 + 2 * 7.4, abs=0.02)
    wanted = raster.pixels(p.select(F.struct("route_id", "seq").alias("k"), "lat", "lng"), "k", False, z).select("x", "y", "px", "py").distinct()
    calls = spark.sparkContext.accumulator(0)
    real = raster.decode_png

    def counted(data):
        calls.add(1)
        return real(data)

    monkeypatch.setattr(raster, "decode_png", counted)
    assert raster.tile_heights(wanted.where("x = 4"), tiles).count() == 50 + 3 and calls.value == 1


def test_shapes_and_phases(spark):
    deg = 111_195.0
    point = "session_id long, time long, event_id long, lat double, lng double, elevation double"
    out = [(1, k, k, (k if k < 20 else 38 - k) * 100 / deg, 0.0, 10.0 + min(k, 38 - k)) for k in range(39)]
    ring = [(2, k, k, 500 * np.sin(k * np.pi / 18) / deg, 500 * np.cos(k * np.pi / 18) / deg, None) for k in range(37)]
    line = [(3, k, k, k * 100 / deg, 0.0, 5.0) for k in range(12)]
    few, still = [(4, k, k, 0.0, 0.0, float("nan")) for k in range(3)], [(5, k, k, 1.0, 1.0, 7.0) for k in range(30)]
    p = spark.createDataFrame([(a, b, c, float(d), float(e), z) for a, b, c, d, e, z in out + ring + line + few + still], point)
    assert {r.session_id: (r.shape, r.turn) for r in tracks.shapes(p).collect()} == {1: ("out_and_back", 19), 2: ("loop", None), 3: ("point_to_point", None), 4: ("point_to_point", None), 5: ("point_to_point", None)}
    got = {r.session_id: tuple(r)[1:] for r in tracks.phases(p).collect()}
    assert got == {1: (29.0, 19, 0, 19), 3: (5.0, 0, 0, 11), 5: (7.0, 0, 29, 0)}


def test_health_of_values_in_any_order_is_the_same(spark):
    """152.45 + 153.64 + 184.23 + 15.18 is 505.5, in doubles a little less in this order."""
    v = [152.45, 153.64, 184.23, 15.18]
    h = spark.createDataFrame([(v, v), (v[::-1], v[::-1])], "h array<double>, c array<double>")
    got = [r.s.active_calories for r in h.select(dedupe.health_summary(F.col("h"), F.col("c")).alias("s")).collect()]
    assert got == [506, 506]
