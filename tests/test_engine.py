"""Operators on small fixtures with known results."""

import json
import math

from pyspark.sql import functions as F

from wayfold.functions import geo, text
from wayfold.operators import areas, joins, matching, rankings, tables, traces
from wayfold.sources import readers, writers
from wayfold.streaming import ingest


def fixes(spark, points, ride="r"):
    return spark.createDataFrame([(ride, i, float(x), float(y), 2 * i) for i, (x, y) in enumerate(points)], "ride string, seq long, x double, y double, t long")


def test_split_and_resample(spark):
    cut = traces.split_at_gaps(fixes(spark, [(0, y) for y in (0, 20, 40, 1000, 1020, 1040)]))
    assert sorted(r.n for r in cut.groupBy("segment").agg(F.count("*").alias("n")).collect()) == [3, 3]
    points = traces.resample(fixes(spark, [(5 * i, 0) for i in range(201)]), 20).orderBy("k").collect()
    assert len(points) == 50 and all(abs(p.x - 20 * p.k) < 1e-9 for p in points)
    assert [p.x for p in traces.resample(fixes(spark, [(0, 0), (5, 0), (9, 0)]), 20).orderBy("k").collect()] == [0, 9]


def test_ride_stats_needs_two_fixes(spark):
    two = fixes(spark, [(0, 0), (3, 4)]).union(fixes(spark, [(1, 1)], "s"))
    assert [(r.ride, r.distance, r.duration) for r in traces.ride_stats(two).collect()] == [("r", 5.0, 2)]


def test_geometry(spark):
    row = spark.range(1).select(
        geo.haversine(F.lit(40.0), F.lit(-74.0), F.lit(41.0), F.lit(-74.0)).alias("h"),
        geo.octant(F.lit(359.0)).alias("n"),
        geo.point_segment(F.lit(5.0), F.lit(3.0), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0)).alias("d"),
        geo.turn(F.lit(350.0), F.lit(10.0)).alias("t"),
    ).first()
    assert abs(row.h - 6_371_000 * math.pi / 180) < 1e-3 and row.n == "N" and row.d == 3.0 and row.t == 20.0


def test_text(spark):
    got = spark.createDataFrame([("$1.62",), ("-$1.28",), ("$1,024.00",), (None,), ("free",)], "m string").select(text.money("m").alias("m")).collect()
    assert [float(r.m) for r in got] == [1.62, -1.28, 1024.0, 0.0, 0.0]
    assert spark.range(1).select(text.norm_name(F.lit(" 5  Av & W 1 ")).alias("x")).first().x == "5 Ave & W 1"
    assert [r.b for r in spark.createDataFrame([(32.0,), (31.9,), (150.0,)], "v double").select(text.band("v", [-100, 32, 50, 80, 120]).alias("b")).collect()] == [1, 0, 3]
    times = spark.createDataFrame([("2021-09-04 18:53:31 -0400",), ("2024-06-19T17:35:52Z",), ("2021-09-04 18:53:31",)], "t string").select(text.ride_time("t").isNotNull().alias("ok")).collect()
    assert [r.ok for r in times] == [True, True, False]


def test_overlap_takes_each_pair_once(spark):
    a = spark.createDataFrame([(1, 0, 10_000), (2, 5000, 5100)], "i long, s long, e long")
    b = spark.createDataFrame([(7, 4990, 9000), (8, 9_990, 20_000)], "j long, s long, e long")
    got = joins.overlap(a, b, 60, 3600).select("l.i", "r.j", "overlap").collect()
    assert sorted(map(tuple, got)) == [(1, 7, 4010), (2, 7, 100)]


def test_points_in_rings_with_hole(spark):
    square = lambda a, lo, hi: [(a, lo, lo, hi, lo), (a, hi, lo, hi, hi), (a, hi, hi, lo, hi), (a, lo, hi, lo, lo)]
    rings = spark.createDataFrame([(r[0], *map(float, r[1:])) for r in square("A", 0, 500) + square("A", 200, 300) + square("B", 600, 1100)], "area string, ax double, ay double, bx double, by double")
    points = spark.createDataFrame([(1, 100.0, 100.0), (2, 250.0, 250.0), (3, 800.0, 900.0), (4, 5000.0, 10.0)], "point long, x double, y double")
    assert sorted(map(tuple, areas.inside(points, rings, 50).collect())) == [(1, "A"), (3, "B")]


def test_components_and_upsert(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(20, 21)], "u long, v long")
    assert {r.node: r.component for r in tables.components(edges).collect()} == {**dict.fromkeys(range(1, 10), 1), 20: 20, 21: 20}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    assert sorted(map(tuple, tables.upsert(old, new, "k", ["v"]).collect()), key=lambda r: r[0]) == [(1, "a", "kept"), (2, None, "replaced"), (3, "c", "added")]


def test_match_rides_on_a_street(spark):
    edges = spark.createDataFrame([(i, i + 1, 100.0 * i, 0.0, 100.0 * (i + 1), 0.0) for i in range(3)] + [(0, 10, 0.0, 0.0, 0.0, 100.0)], "u long, v long, ax double, ay double, bx double, by double")
    ride = spark.createDataFrame([(1, i, 10.0 * i + 5, 5.0 * (-1) ** i) for i in range(30)], "ride long, seq long, x double, y double")
    got = matching.likeliest(ride, edges).orderBy("seq").collect()
    assert [r.u for r in got] == [i // 10 for i in range(30)]


def test_chains(spark):
    units = spark.createDataFrame([(1, "k", 0, 1, 90.0, 1.0), (2, "k", 1, 2, 90.0, 1.0), (3, "k", 1, 9, 0.0, 1.0)], "unit long, name string, a long, b long, bearing double, metres double")
    assert sorted((r.chain, r.place, r.unit) for r in rankings.chain_units(units).collect()) == [(1, 0, 1), (1, 1, 2), (3, 0, 3)]


def test_readers(spark, tmp_path):
    rides = tmp_path / "rides"
    rides.mkdir()
    (rides / "a.csv").write_text("longitude,latitude,timestamp\n-74,40.7,2021-09-04 18:53:31 -0400\n-74,40.8,2021-09-04 18:54:31 -0400\n")
    (rides / "b.csv").write_text("longitude,latitude,timestamp\nx,40.7,2021-09-04 18:53:31 -0400\n-74,40.8,2021-09-04 18:54:31 -0400\n")
    assert {r.ride for r in readers.rides(spark, str(rides)).collect()} == {"a.csv"}
    (tmp_path / "t.json").write_text(json.dumps([{"rideId": "1", "startTimeMs": "5", "rideableName": "2080.0", "startAddress": "A  B", "price": {"formatted": "$1.62"}, "lineItems": [{"title": "E-bike", "amount": {"formatted": "$1.76"}}, {"title": "x", "amount": {"formatted": "-$1.28"}}]}, {"rideId": "1", "startTimeMs": "9"}]))
    (trip,) = readers.trips(spark, str(tmp_path / "t.json")).collect()
    assert (trip.t, trip.bike, trip.a, float(trip.gross), float(trip.credit), trip.ebike) == (5, "2080", "A B", 1.76, 1.28, True)
    name = spark.sql("select timestamp'2023-12-17 18:41:53' as t").select(readers.ride_name(F.col("t")).alias("n")).first().n
    assert name == "2023-12-17_13-41-53_-0500.csv"


def test_writers_and_ingest(spark, tmp_path):
    lines = spark.sql("select 'k' as name, array(named_struct('x', 1.0, 'y', 2.123456789)) as points")
    assert json.loads(writers.features(lines).first().value)["geometry"]["coordinates"] == [[1.0, 2.12346]]
    spark.range(5).withColumn("v", F.lit(1)).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for _ in range(2):
        ingest.ingest(ingest.fixes(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp"), ["id"]).awaitTermination()
        spark.range(3, 8).withColumn("v", F.lit(2)).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(8))


def test_whole_names_read_behind_80_characters(spark, tmp_path):
    from wayfold.plans import registry

    spark.createDataFrame([(1, "x " * 100 + " on  5 Av")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert registry.queries()["q_norm_names"](spark, str(tmp_path)).first().name == "x " * 100 + "on 5 Ave"
