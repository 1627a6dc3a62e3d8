"""Readers and writers of the domain's file formats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 8 << 20
MAX_POINTS = 25_000

POINT_SCHEMA = "path string, kind string, track int, segment_number int, seq int, lat double, lng double, elevation double, time timestamp, name string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parse_gpx(path: str, raw: bytes, limit: bool) -> list[dict]:
    """Points of tracks, routes and waypoints of one document; a limit on size and number of points may be set."""
    import xml.etree.ElementTree as ET

    if limit and len(raw) > MAX_BYTES:
        raise ValueError(f"{path}: over {MAX_BYTES} bytes")
    if b"<!ENTITY" in raw or b"<!DOCTYPE" in raw:
        raise ValueError(f"{path}: entities are not read")
    root = ET.fromstring(raw)
    out: list[dict] = []

    def add(node, kind, track, segment, name):
        kids = {_local(c.tag): (c.text or "").strip() for c in node}
        lat, lng = node.get("lat"), node.get("lon")
        if lat is None or lng is None:
            return
        out.append({"path": path, "kind": kind, "track": track, "segment_number": segment, "seq": len(out), "lat": float(lat), "lng": float(lng), "elevation": float(kids["ele"]) if kids.get("ele") else None, "time": pd.Timestamp(kids["time"]).tz_localize(None) if kids.get("time") and "Z" not in kids["time"] else pd.Timestamp(kids["time"]).tz_convert(None) if kids.get("time") else None, "name": kids.get("name") or name})

    track = 0
    for child in root:
        kind = _local(child.tag)
        name = next(((c.text or "").strip() for c in child if _local(c.tag) == "name"), None)
        if kind == "trk":
            segment = 0
            for seg in child:
                if _local(seg.tag) == "trkseg":
                    for p in seg:
                        if _local(p.tag) == "trkpt":
                            add(p, "track", track, segment, name)
                    segment += 1
            track += 1
        elif kind == "rte":
            for p in child:
                if _local(p.tag) == "rtept":
                    add(p, "route", track, 0, name)
            track += 1
        elif kind == "wpt":
            add(child, "waypoint", 0, 0, name)
    if limit and len(out) > MAX_POINTS:
        raise ValueError(f"{path}: over {MAX_POINTS} points")
    return out


def read_gpx(spark: SparkSession, path: str, limit: bool = False) -> DataFrame:
    """Points of GPX files, a file a task's unit: XML is parsed whole, so a file is not split."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            rows = [x for p, c in zip(pdf["path"], pdf["content"], strict=True) for x in parse_gpx(p, bytes(c), limit)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in POINT_SCHEMA.split(", ")])

    return files.mapInPandas(run, POINT_SCHEMA)


def write_gpx_lines(docs: DataFrame, path: str, by: str = "session_id") -> None:
    """Documents (by, gpx) as text files of many: a line is a key, a tab and the document, which has no line break."""
    docs.select(F.concat(F.col(by).cast("string"), F.lit("\t"), "gpx").alias("value")).write.text(path)


def read_gpx_lines(spark: SparkSession, path: str, limit: bool = False) -> DataFrame:
    """Points of documents written by `write_gpx_lines`; path is their key. Files are split at lines, so many small tracks are few tasks."""

    def run(batches):
        for pdf in batches:
            rows = [x for v in pdf["value"] for k, _, doc in [v.partition("\t")] for x in parse_gpx(k, doc.encode(), limit)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in POINT_SCHEMA.split(", ")])

    return spark.read.text(path).mapInPandas(run, POINT_SCHEMA)


def gpx_text(points: DataFrame, by: str = "session_id") -> DataFrame:
    """One GPX document a group, built by expressions; segments break where segment_number changes."""
    num = lambda c: F.format_string("%.6f", c)
    pt = F.concat(F.lit('<trkpt lat="'), num(F.col("lat")), F.lit('" lon="'), num(F.col("lng")), F.lit('">'), F.when(F.col("elevation").isNotNull(), F.concat(F.lit("<ele>"), F.format_string("%.2f", F.col("elevation")), F.lit("</ele>"))).otherwise(""), F.lit("<time>"), F.date_format(F.timestamp_seconds("time"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</time></trkpt>"))
    seg = points.withColumn("__p", pt).groupBy(by, "segment_number").agg(F.sort_array(F.collect_list(F.struct("time", "event_id", "__p"))).alias("x"))
    seg = seg.select(by, "segment_number", F.concat(F.lit("<trkseg>"), F.array_join(F.transform("x", lambda p: p["__p"]), ""), F.lit("</trkseg>")).alias("s"))
    doc = seg.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("segment_number", "s"))).alias("x"))
    return doc.select(by, F.concat(F.lit('<?xml version="1.0"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk>'), F.array_join(F.transform("x", lambda p: p["s"]), ""), F.lit("</trk></gpx>")).alias("gpx"))


FEATURE = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features (properties, geometry_type, coordinates as JSON) of a collection, or of one feature a line."""
    if lines:
        f = spark.read.text(path).select(F.from_json("value", FEATURE).alias("f"))
    else:
        f = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<features:array<{FEATURE}>>").alias("c")).select(F.explode("c.features").alias("f"))
    return f.select(F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates")).where("geometry_type is not null")


def line_of(coordinates) -> Column:
    """LineString coordinates as an array of (lng, lat, z)."""
    return F.transform(F.from_json(coordinates, "array<array<double>>"), lambda p: F.struct(p[0].alias("lng"), p[1].alias("lat"), F.when(F.size(p) > 2, p[2]).alias("z")))


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    """Mapping rows (raw_value, canonical_class, drivable, source_dataset); one a raw value and dataset or it fails."""
    got = spark.read.schema("raw_value string, canonical_class string, drivable boolean, source_dataset string").json(path)
    if not got.groupBy("source_dataset", "raw_value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"{path}: a raw value is mapped twice")
    return got


def read_overpass(spark: SparkSession, path: str) -> DataFrame:
    """Named peaks of an Overpass answer: (osm_id, name, lat, lng, elevation_text, wikidata, wikipedia)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<elements:array<struct<type:string,id:bigint,lat:double,lon:double,tags:map<string,string>>>>").alias("d"))
    e = raw.select(F.inline("d.elements"))
    return e.where((F.col("type") == "node") & F.col("tags")["name"].isNotNull()).select(F.col("id").alias("osm_id"), F.col("tags")["name"].alias("name"), "lat", F.col("lon").alias("lng"), F.col("tags")["ele"].alias("elevation_text"), F.col("tags")["wikidata"].alias("wikidata"), F.col("tags")["wikipedia"].alias("wikipedia"))


def grib_ranges(index: DataFrame, variable: str) -> DataFrame:
    """Byte ranges of a variable from index lines no:start:date:variable:...; the last range is open."""
    from pyspark.sql import Window as W

    p = F.split("value", ":")
    rows = index.select("file", p[0].cast("int").alias("no"), p[1].cast("long").alias("start"), p[3].alias("variable"))
    rows = rows.withColumn("end", F.lead("start").over(W.partitionBy("file").orderBy("no", "start")) - 1)
    return rows.where(F.col("variable") == variable).select("file", "start", "end")


def recordset(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """A JSON array of objects as a table."""
    return spark.createDataFrame([(text,)], "j string").select(F.inline(F.from_json("j", f"array<struct<{schema}>>")))


def zip_columns(df: DataFrame, columns: list[str], complete: bool = True) -> DataFrame:
    """Parallel arrays as rows; incomplete rows go if `complete`."""
    got = df.select(*[c for c in df.columns if c not in columns], F.inline(F.arrays_zip(*columns)))
    return got.dropna(subset=columns) if complete else got


def stream_rows(df: DataFrame):
    """Rows one by one without holding the result; partitions come in turn."""
    return df.toLocalIterator(prefetchPartitions=True)
