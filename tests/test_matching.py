import random
import uuid

import pytest
from pyspark.sql import functions as F

from switchback.streaming import ingest, matching

KINDS = [["summit"], ["waterfall"], ["lake"], ["trailhead", "lake"], None]


def batches(rng, many):
    """Points in a few crowded spots, and places that come, move, change kind and go."""
    spots = [(rng.uniform(44.4, 44.6), rng.uniform(-120.1, -119.9)) for _ in range(5)]
    out, live = [], []
    for no in range(many):
        near = lambda m: (lambda s: (s[0] + rng.uniform(-m, m), s[1] + rng.uniform(-m, m)))(rng.choice(spots))
        pts = [(rng.randrange(40), 1000 * no + k, *near(0.0015)) for k in range(rng.randrange(60))] + [(1, 5, None, None)]
        rows = []
        for _ in range(rng.randrange(8)):
            i = rng.choice(live) if live and rng.random() < 0.6 else len(live) + 100 * no
            live.append(i)
            rows.append((i, *near(0.0015), rng.choice(KINDS), rng.random() < 0.2))
        if no % 3 == 1:
            rows.append((7, None, None, ["summit"], False))
        out.append((pts if no % 4 else None, rows if no % 5 else None))
    return out


PTS = "session_id long, time long, lat double, lng double"


def final(all_batches):
    pts, places = [], {}
    for p, d in all_batches:
        pts += p or []
        for row in sorted(d or [], key=lambda r: (r[4], r[1] or -1e9, r[2] or -1e9)):
            places[row[0]] = row
    return pts, [r for r in places.values() if not r[4]]


def test_any_batches_give_one_full_match(spark, tmp_path):
    log = matching.ReachLog(spark, str(tmp_path), max_lat=50)
    made = batches(random.Random(3), 6)
    rejected = spark.createDataFrame([(1, 0), (2, 0), (3, 201)], "session_id long, destination_id long")
    for no, (pts, places) in enumerate(made):
        p = spark.createDataFrame(pts, PTS) if pts is not None else None
        d = spark.createDataFrame(places, matching.PLACES) if places is not None else None
        log.apply(no, p, d)
        if no in (3, 5):
            log.apply(no, p, d)  # a batch that is run again changes nothing
        pts, places = final(made[: no + 1])
        want = matching.full_match(spark.createDataFrame(pts, PTS), spark.createDataFrame(places, matching.PLACES), 50)
        assert sorted(map(tuple, log.reached().collect())) == sorted(map(tuple, want.collect()))
    assert want.count() > 10
    assert log.reached(rejected).count() == want.join(rejected, matching.PAIR, "left_anti").count()


def test_changed_places_open_their_cells_only(spark, tmp_path):
    log = matching.ReachLog(spark, str(tmp_path))
    pts = spark.range(4000).select("id", F.lit(1).alias("time"), (F.col("id") % 40 - 20.0).alias("lat"), (F.col("id") % 17).cast("double").alias("lng")).withColumnRenamed("id", "session_id").withColumn("time", F.lit(1).cast("long"))
    log.apply(0, pts)
    place = spark.createDataFrame([(1, 3.0, 4.0, ["summit"], False)], matching.PLACES)
    near = log.points_near(place, 0)
    text = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "folder#" in text.split("PartitionFilters")[1].split("]")[0]
    assert 0 < len(near.inputFiles()) and near.count() < 200
    log.apply(1, places=place)
    log.apply(2, places=place.withColumn("lat", F.lit(3.4)))  # it moves away
    assert log.reached().count() == 0
    log.apply(3, places=place)
    assert log.reached().count() == pts.where("lat = 3 and lng = 4").count() > 0


def test_stream_of_changes(spark, tmp_path):
    made = batches(random.Random(8), 3)
    names = [c.split()[0] for c in matching.PLACES.split(", ")]
    schema = f"place boolean, session_id long, time long, {matching.PLACES}"
    for no, (pts, places) in enumerate(made):
        rows = [(False, s, t, None, y, x, None, None) for s, t, y, x in pts or []] + [(True, None, None, *r) for r in places or []]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{no}-{uuid.uuid4().hex}")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    log = matching.ReachLog(spark, f"{tmp_path}/log", max_lat=50)
    log.follow(src, f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    live = log.known_places().where("not deleted").select(*names)
    pts = [p for b, _ in made for p in b or []]
    want = matching.full_match(spark.createDataFrame(pts, PTS), live, 50)
    assert sorted(map(tuple, log.reached().collect())) == sorted(map(tuple, want.collect()))


def test_reprocessing_opens_touched_folders_only(spark, tmp_path):
    schema = "user_id long, ts timestamp, value double"
    for no in range(3):
        rows = spark.range(200).select((F.col("id") % (50 if no == 0 else 3)).alias("user_id"), F.timestamp_seconds(F.col("id") % 100 + 50 * no).alias("ts"), F.lit(float(no)).alias("value"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    points = ingest.read_points(spark, f"{tmp_path}/in", schema)
    count = lambda known: known.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    ingest.reprocess_touched(points, f"{tmp_path}/store", f"{tmp_path}/result", count, f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    want = spark.read.parquet(f"{tmp_path}/in").dropDuplicates(["user_id", "ts"]).groupBy("user_id").count()
    assert sorted(map(tuple, ingest.latest(spark, f"{tmp_path}/result", ["user_id"]).collect())) == sorted(map(tuple, want.collect()))
    assert pytest.approx(3) == spark.read.parquet(f"{tmp_path}/result/batch=2").count()
