import json

import pytest

from switchback.sources import files
from switchback.streaming import ingest

GPX = """<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="1" lon="2"><name>W</name></wpt><trk><name>T</name><trkseg><trkpt lat="45.1" lon="-119.2"><ele>1000</ele><time>2024-01-01T00:00:00Z</time></trkpt></trkseg>
<trkseg><trkpt lat="45.2" lon="-119.3"/></trkseg></trk><rte><rtept lat="3" lon="4"/></rte></gpx>"""


def test_gpx(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(GPX)
    rows = files.read_gpx(spark, str(tmp_path / "*.gpx")).orderBy("seq").collect()
    assert [(r.kind, r.segment_number, r.lat) for r in rows] == [("waypoint", 0, 1.0), ("track", 0, 45.1), ("track", 1, 45.2), ("route", 0, 3.0)]
    assert str(rows[1].time) == "2024-01-01 00:00:00" and rows[2].elevation is None and rows[1].name == "T"
    with pytest.raises(ValueError):
        files.parse_gpx("x", b"<!DOCTYPE a><gpx/>", True)
    with pytest.raises(ValueError):
        files.parse_gpx("x", b"<gpx>" + b" " * files.MAX_BYTES + b"</gpx>", True)


def test_gpx_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(1, 0, 0, 1, 45.1, -119.2, 1000.0), (1, 30, 1, 2, 45.2, -119.3, None)], "session_id int, time long, segment_number int, event_id int, lat double, lng double, elevation double")
    (tmp_path / "b.gpx").write_text(files.gpx_text(p).first().gpx)
    back = files.read_gpx(spark, str(tmp_path / "b.gpx")).orderBy("seq").collect()
    assert [(r.segment_number, r.lat, r.elevation) for r in back] == [(0, 45.1, 1000.0), (1, 45.2, None)]


def test_geojson(spark, tmp_path):
    f = {"type": "Feature", "properties": {"name": "x"}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4, 5]]}}
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": [f, f]}))
    (tmp_path / "d.ndjson").write_text(json.dumps(f) + "\n" + json.dumps(f) + "\n")
    for df in (files.read_geojson(spark, str(tmp_path / "c.json")), files.read_geojson(spark, str(tmp_path / "d.ndjson"), lines=True)):
        r = df.select("properties", files.line_of(df["coordinates"]).alias("line")).collect()
        assert len(r) == 2 and r[0].properties["name"] == "x" and r[0].line[1].z == 5.0


def test_maps_overpass_and_ranges(spark, tmp_path):
    row = {"raw_value": "a", "canonical_class": "b", "drivable": True, "source_dataset": "s"}
    (tmp_path / "m.jsonl").write_text(json.dumps(row) + "\n")
    assert files.read_class_map(spark, str(tmp_path / "m.jsonl")).count() == 1
    (tmp_path / "m.jsonl").write_text(2 * (json.dumps(row) + "\n"))
    with pytest.raises(ValueError):
        files.read_class_map(spark, str(tmp_path / "m.jsonl"))
    (tmp_path / "o.json").write_text(json.dumps({"elements": [{"type": "node", "id": 5, "lat": 1, "lon": 2, "tags": {"name": "P", "ele": "900"}}, {"type": "way", "id": 6}]}))
    assert files.read_overpass(spark, str(tmp_path / "o.json")).first().osm_id == 5
    i = spark.createDataFrame([("f", "1:0:d=1:A:x"), ("f", "2:50:d=1:MASSDEN:x"), ("f", "3:90:d=1:C:x")], "file string, value string")
    assert tuple(files.grib_ranges(i, "MASSDEN").first()) == ("f", 50, 89)
    assert files.recordset(spark, '[{"a":1},{"a":2}]', "a:int").count() == 2
    z = files.zip_columns(spark.createDataFrame([(1, [1, 2], [3, None])], "id int, a array<int>, b array<int>"), ["a", "b"])
    assert [tuple(r) for r in z.collect()] == [(1, 1, 3)]


def test_stream_dedupes(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.unionByName(e).coalesce(1).write.parquet(str(tmp_path / "in"))
    d = ingest.deduped(ingest.read_points(spark, str(tmp_path / "in"), e.schema))
    d.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.select("user_id", "ts").distinct().count()


def test_gpx_documents_of_one_folder_are_read_back(spark, tmp_path):
    """Many tracks are few files, whatever their number."""
    p = spark.range(300).selectExpr("id % 100 AS session_id", "id AS event_id", "1700000000 + id AS time", "id % 2 AS segment_number", "45 + id / 1000 AS lat", "-120.0D AS lng", "CAST(NULL AS DOUBLE) AS elevation")
    files.write_gpx_lines(files.gpx_text(p), f"file://{tmp_path}/gpx")
    got = files.read_gpx_lines(spark, f"file://{tmp_path}/gpx").selectExpr("CAST(path AS LONG) AS k", "unix_seconds(time) AS t", "round(lat, 6) AS lat").collect()
    assert sorted((r.k, r.t, r.lat) for r in got) == sorted((k % 100, 1700000000 + k, round(45 + k / 1000, 6)) for k in range(300))
    assert len(list((tmp_path / "gpx").glob("part-*"))) < 100
