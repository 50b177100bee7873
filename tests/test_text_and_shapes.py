"""Names, polygons, run folders and streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tesselle.functions import shapes, text
from tesselle.plans import registry
from tesselle.sources.store import CheckpointStore, RunConfig, cached
from tesselle.streaming import progress


def test_places(spark):
    want = {"Fort Myers, FL": ("Fort Myers", "12"), "Lee County Florida": ("Lee County", "12"), "Charleston West Virginia": ("Charleston", "54"), "Bonita Springs FL": ("Bonita Springs", "12"), "Cape Coral": ("Cape Coral", None)}
    df = spark.createDataFrame([(q,) for q in want], "q string").select("q", text.parse_place("q").alias("p"))
    assert {r.q: (r.p.name, r.p.fips) for r in df.collect()} == want


def test_suffixes(spark):
    want = {"Lee County": "Lee", "Iosco charter township": "Iosco", "Valdez-Cordova Census Area": "Valdez-Cordova", "Chicago": "Chicago", "County": "County"}
    df = spark.createDataFrame([(q,) for q in want], "q string").select("q", text.strip_suffix("q").alias("b"))
    assert {r.q: r.b for r in df.collect()} == want


def test_ranking(spark):
    assert text.rank_places(registry.places(spark), "Lee County, FL").first()["name"] == "Lee County"


def test_quadtree(spark):
    box = spark.createDataFrame([(0.0, 0.0, 0.4, 0.4)], "x0 double, y0 double, x1 double, y1 double")
    assert shapes.quad_leaves(box, 0.015).count() == 16


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
HOLE = [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]


def test_polygons(spark):
    ring = shapes.polygon_wkb([SQUARE, HOLE])
    far = shapes.polygon_wkb([[(13, 14), (20, 14), (20, 20), (13, 14)]])
    row = spark.createDataFrame([(bytearray(ring), bytearray(far)), (None, bytearray(far))], "a binary, b binary").select(shapes.wkb_area("a").alias("area"), shapes.wkb_distance("a", "b").alias("d")).collect()
    assert row[0].area == 96.0 and math.isclose(row[0].d, 5.0) and row[1].area is None and row[1].d is None
    points = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (10.0, 5.0), (11.0, 5.0)], "x double, y double")
    assert [r[0] for r in points.select(shapes.within_polygon("x", "y", ring)).collect()] == [True, False, False, False]


def test_config_round_trip():
    saved = RunConfig(place="Lee", weights={"a_binned": 1.0}).to_json().replace('"place"', '"unknown": 1, "place"')
    assert RunConfig.from_json(saved) == RunConfig(place="Lee", weights={"a_binned": 1.0})


def test_checkpoints(spark, tmp_path):
    store = CheckpointStore(spark, str(tmp_path), keep=2)
    labels = spark.createDataFrame([(1, 5)], "parcel_id long, nid long")
    for i in (100, 200, 300):
        store.save(labels, spark.createDataFrame([(0, f"s{i}")], "group_id long, state string"), i)
    store.save(labels, spark.createDataFrame([(0, "end")], "group_id long, state string"), 300, final=True)
    assert [(i, f) for i, f, _ in store.list()] == [(200, False), (300, False), (300, True)]
    (tmp_path / "checkpoints" / "iter_000000999" / "labels").mkdir(parents=True)  # cut off: no _SUCCESS
    got, states = store.load()
    assert states == {0: "end"} and got.first().nid == 5


def test_damaged_cache_is_rebuilt(spark, tmp_path):
    path = str(tmp_path / "c")
    build = lambda: spark.range(5)
    assert cached(spark, path, build).count() == 5
    for f in (tmp_path / "c").glob("*.parquet"):
        f.write_bytes(b"torn")
    assert cached(spark, path, build).count() == 5


def test_stream_matches_batch(spark, sf_dir):
    batch = {r["start"]: (r.events, r.distinct_users) for r in registry.QUERIES["novelty_window"](spark, sf_dir).collect()}
    stream = {r["start"]: (r.events, r.distinct_users) for r in registry.QUERIES["novelty_stream"](spark, sf_dir).collect()}
    assert batch == stream


def test_streaks_as_a_stream(spark, tmp_path):
    rows = [("r", f"2024-01-01 {h:02d}:00:00", v) for h, v in enumerate([0.9, 0.1, 0.1, 0.1, 0.5, 0.1])]
    ratios = spark.createDataFrame(rows, "run_id string, start string, novelty double").withColumn("start", F.to_timestamp("start"))
    ratios.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = progress.watch_streaks(spark.readStream.schema(ratios.schema).parquet(str(tmp_path / "in")), 0.2, 3)
    query = stream.writeStream.format("memory").queryName("streaks").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = [(r.streak, r.settled) for r in spark.table("streaks").orderBy("start").collect()]
    want = [(r.streak, r.settled) for r in progress.calm_streaks(ratios, 0.2, 3).orderBy("start").collect()]
    assert got == want == [(0, False), (1, False), (2, False), (3, True), (0, False), (1, False)]
