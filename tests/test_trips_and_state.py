"""Trips, days, transit, state and joins on small fixtures with known results, and against brute force."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import daily, joins, state, tables, transit, trips, views
from wayfold.sources import readers, writers

TRIP = "id string, t long, dur long, a string, b string, bike string, ebike boolean"
HOUR, DAY = 3_600_000, 86_400_000


def test_merge_by_id_and_by_start(spark):
    cached = spark.createDataFrame([("r1", 10, "old"), (None, 20, "bare"), (None, 30, "one"), (None, 30, "two")], "id string, t long, v string")
    fresh = spark.createDataFrame([("r1", 10, "new"), ("r2", 20, "named"), ("r3", 30, "third"), ("r4", 40, "fourth")], "id string, t long, v string")
    got = sorted((r.v, r.state) for r in trips.merge(cached, fresh).collect())
    # an ambiguous start adds, a unique one replaces
    assert [x for x in got if x[1] != "kept"] == [("fourth", "added"), ("named", "replaced"), ("new", "replaced"), ("third", "added")]
    assert {x[0] for x in got if x[1] == "kept"} <= {"one", "two"}


def test_bikes_met_again(spark):
    rows = [("1", 0, HOUR, "A", "B", "x", False), ("2", 5 * HOUR, HOUR, " B", "C", "x", False), ("3", 100 * DAY, HOUR, "C", "A", "x", False), ("4", 0, HOUR, "A", "A", "y", True), ("5", 7, 1, "A", "B", "", False)]
    marked = trips.resumed(spark.createDataFrame(rows, TRIP)).cache()
    assert {r.id: r.resume for r in marked.collect()} == {"1": False, "2": True, "3": False, "4": False}
    cited = spark.createDataFrame([("1", 4), ("3", 7), ("4", -1)], "id string, at long")
    (row,) = trips.met_again(marked, cited).collect()
    assert (row.bike, row.encounters, row.gaps, row.rides) == ("x", 2, [100], [7, 4])


def test_replay_against_a_walk(spark):
    rng = random.Random(5)
    rows = [(f"{i:03d}", rng.randrange(200) * HOUR, HOUR, rng.choice("AB"), rng.choice("AB"), f"b{rng.randrange(6)}", rng.random() < 0.3) for i in range(80)]
    docks = spark.createDataFrame([("A", -74.0, 40.7)], "name string, lon double, lat double")
    got = {}
    for r in trips.replay(spark.createDataFrame(rows, TRIP), docks, month_ms=DAY).collect():
        got.setdefault(r.draw, set()).add((r.bike, round(r.age, 6), r.hit, r.km))
    last, want = {}, {}
    for i, t, dur, a, b, bike, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        before = last.get(bike)
        if not (before and before[1] == a and t - before[0] <= 48 * HOUR):
            want[i] = {(k, round((t - end) / DAY, 6), k == bike, 0.0 if a == dock == "A" else None) for k, (end, dock) in last.items()}
        last[bike] = (t + dur, b)
    assert got == {k: v for k, v in want.items() if v}


def test_counting_overlaps_against_pairs(spark):
    rng = random.Random(2)
    spans = [(i, s, s + rng.randrange(0, 400)) for i, s in enumerate(rng.randrange(3000) for _ in range(120))]
    table = spark.createDataFrame(spans, "id long, s long, e long")
    got = {r.id: r.n for r in joins.count_overlaps(table, table, 60, 500).collect()}
    for i, s, e in spans:
        assert got.get(i, 0) == sum(j != i and min(e, e2) - max(s, s2) >= 60 for j, s2, e2 in spans)


def test_as_of_and_nearest(spark):
    rng = random.Random(9)
    left = [(i, rng.randrange(3), rng.randrange(400)) for i in range(60)]
    right = [(i, rng.randrange(3), rng.randrange(400)) for i in range(50)]
    make = lambda rows: spark.createDataFrame(rows, "id long, k long, at long")
    for later in (False, True):
        met = joins.as_of(make(left), make(right), ("k",), F.col("at"), F.col("at"), 30, later, tie="id")
        for r in met.collect():
            fit = [x for x in right if x[1] == r.l.k and (x[2] >= r.l.at if later else x[2] <= r.l.at)]
            best = (min(fit, key=lambda x: (x[2], -x[0])) if later else max(fit, key=lambda x: (x[2], x[0]))) if fit else None
            assert (r.r and r.r.id) == (best and best[0])
    points = spark.createDataFrame([(i, float(rng.randrange(900)), float(rng.randrange(900))) for i in range(80)], "id long, x double, y double")
    rows = [tuple(r) for r in points.collect()]
    got = {r.id: r.near for r in joins.nearest_one(points, points, 300, "id", "id", keep=F.col("l.id") != F.col("r.id")).collect()}
    for i, x, y in rows:
        best = min(((u - x) ** 2 + (v - y) ** 2, j) for j, u, v in rows if j != i)
        assert got.get(i) == (best[1] if best[0] <= 90_000 else None)
    pairs = {(min(r.l.id, r.r.id), max(r.l.id, r.r.id)) for r in joins.pairs_within(points, 100, "id").collect()}
    assert pairs == {(i, j) for i, x, y in rows for j, u, v in rows if i < j and (x - u) ** 2 + (y - v) ** 2 <= 10_000}
    assert joins.pairs_within(points, 100, "id").count() == len(pairs)


def test_numbers_quantiles_and_stripes(spark):
    rows = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate([5, 1, 4, 4, 9, 2, 7, 3, 8])], "k long, v double")
    got = {(r.k, r.fraction): r.quantile for r in tables.quantiles(rows, "k", "v", [0.25, 0.5]).collect()}
    assert got == {(0, 0.25): 5.0, (0, 0.5): 7.0, (1, 0.25): 1.75, (1, 0.5): 2.5}
    assert [r["index"] for r in tables.numbered(rows, "v").orderBy("v").collect()] == list(range(9))
    stripes = tables.striped(spark.createDataFrame([("a", 5), ("b", 9), ("c", 1), ("d", 7)], "ride string, size long"), 2)
    assert {r.ride: r.stripe for r in stripes.collect()} == {"b": 0, "d": 1, "a": 0, "c": 1}


def test_riding_and_weather(spark):
    at = datetime.datetime
    stats = spark.createDataFrame([(at(2023, 12, 17, 18), 3600.0, 20_000.0), (at(2023, 12, 16, 8), 1800.0, 10_000.0), (None, 5.0, 5.0)], "start timestamp, duration double, dist double")
    row = daily.riding(stats).first()
    assert (row.km, row.hours, row.kmh, row.longest) == (30.0, 1.5, 20.0, 20.0)
    assert [i for i, n in enumerate(row.by_hour) if n] == [8, 18] and [i for i, n in enumerate(row.by_weekday) if n] == [5, 6]
    assert daily.riding(stats.limit(0)).count() == 0
    days = spark.range(40).selectExpr("date_add(date'2024-01-01', int(id)) as day", "if(id < 20, 70D, 40D) as tmax")
    ridden = days.filter("tmax = 70 or day >= date'2024-02-06'").select("day", F.lit(1.0).alias("miles"))
    from wayfold.functions import text

    bands = daily.weather_summary(days, ridden, text.band("tmax", list(daily.TEMPERATURE)), 5)
    assert {r.band: (r.share, r.expected) for r in bands.collect() if r.days} == {1: (16.7, 50.0), 3: (83.3, 50.0)}
    assert daily.weather_summary(days, ridden.limit(5), text.band("tmax", list(daily.TEMPERATURE)), 5).count() == 0
    assert daily.weather_note(bands).first().band == 1


def test_transit(spark):
    stations = spark.createDataFrame([(i, 900.0 * i, 0.0 if i < 7 else 9000.0) for i in range(8)], "id long, x double, y double")
    pairs = spark.createDataFrame([(a, b, 20) for a in range(6) for b in range(a + 1, 6)] + [(0, 7, 1)], "a long, b long, n long")
    laid = transit.lay_lines(stations, pairs, (1, 2)).cache()
    (line,) = {tuple(r.station for r in sorted((x for x in laid.collect() if x.tried == 1), key=lambda r: r.place))}
    assert sorted(line) == list(range(6)) and list(line) in (sorted(line), sorted(line)[::-1])
    score = transit.score(laid.filter("tried = 1").select("line", "station"), pairs).first()
    assert (score.direct, score.one_change, score.stranded) == (300, 0, 1)
    assert transit.knee(spark.createDataFrame([(4, 50, 0), (5, 55, 0), (6, 56, 0)], "tried int, direct long, one_change long"), 100).first().tried == 5
    named = stations.withColumn("name", F.concat(F.lit("s"), "id")).withColumn("n", F.lit(3))
    lines, shown = transit.block(laid.filter("tried = 1"), named)
    assert shown.count() == 6 and not any(r.transfer for r in shown.collect()) and sorted(lines.first().stops) == list(range(6))
    profile = spark.createDataFrame([(1, 100.0 * i, float(v)) for i, v in enumerate([0, 1, 5, 1, 0, 0, 0, 0, 2, 0, 0, 9, 1, 0])], "corridor long, s double, v double")
    stops = transit.place_stops(profile, spark.createDataFrame([(1, 800.0, 30)], "corridor long, s double, n long"))
    assert [(r.s, r.kind) for r in stops.collect()] == [(200.0, "peak"), (800.0, "anchor"), (1300.0, "end")]


def test_state_is_in_force_for_its_configuration(spark, tmp_path):
    path, made = str(tmp_path / "s"), {"rides": spark.range(3).withColumnRenamed("id", "ride"), "speeds": spark.range(2)}
    assert state.read_state(spark, path, {"a": 1}) == {}
    state.write_run(made, path, "run1", {"a": 1, "tags": {"x", "y"}}, {"lib": "1"})
    config = {"tags": {"y", "x"}, "a": 1}
    assert set(state.read_state(spark, path, config, {"lib": "1"})) == {"rides", "speeds"}
    assert set(state.read_state(spark, path, config, {"lib": "2"}, derived=("speeds",))) == {"rides"}
    assert state.read_state(spark, path, {"a": 2}) == {}
    assert state.well_formed(made["speeds"], "id long") and not state.well_formed(made["speeds"], "id string")
    landed = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "ride string, part long")
    whole = state.ready(landed, spark.createDataFrame([("a", 2), ("b", 2)], "ride string, parts long"))
    assert {r.ride for r in whole.collect()} == {"a"}
    assert [r.ride for r in state.pending(spark.range(4).withColumnRenamed("id", "ride"), made["rides"]).collect()] == [3]
    assert state.region_area(state.grown(state.region_cells(spark.createDataFrame([(50.0, 50.0)], "x double, y double"), 100, 10), state.region_cells(spark.createDataFrame([(250.0, 50.0)], "x double, y double"), 100, 10)), 100).first().km2 == pytest.approx(0.02)


def test_sources(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"data": {"stations": [{"name": "A", "lat": 1.0, "lon": 2.0}, {"name": None, "lat": 1.0, "lon": 2.0}, {"name": "B", "lat": None, "lon": 2.0}]}}))
    assert [tuple(r) for r in readers.stations(spark, str(tmp_path / "g.json")).collect()] == [("A", 2.0, 1.0)]
    (tmp_path / "t.json").write_text(json.dumps({"format": 1, "trips": [{"id": "x", "t": 1}]}))
    assert readers.trip_cache(spark, str(tmp_path / "t.json")) is None
    (tmp_path / "u.json").write_text(json.dumps({"format": 2, "trips": [{"id": "x", "t": 1}]}))
    assert readers.trip_cache(spark, str(tmp_path / "u.json")).first().id == "x"
    (tmp_path / "e.json").write_text(json.dumps({"properties": {"dates": ["2024-01-01", "2024-01-02"], "rides": [[0, "08:00", 10.0, -1], [1, "", None, 0], [0, "09:00", 5, 1]]}}))
    assert {str(r.day): round(r.miles, 3) for r in readers.export_rides(spark, str(tmp_path / "e.json")).collect()} == {"2024-01-01": 9.321, "2024-01-02": 0.0}
    (tmp_path / "n.json").write_text(json.dumps({"stations": [{"near": "P", "at": [1.0, 2.0], "n": 9}], "lines": [[0]]}))
    stops, listed = readers.fitted_network(spark, str(tmp_path / "n.json"))
    assert listed.first().name == "P" and stops.count() == 1
    feature = {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 0]]]}, "properties": {"bikeid": "2080.0", "instdate": "2020-01-01T00:00:00.000", "street": "A ST"}}
    (tmp_path / "l.json").write_text(json.dumps({"features": [feature]}))
    from wayfold.operators import lanes

    row = lanes.normalised(readers.lanes(spark, str(tmp_path / "l.json"))).first()
    assert (row.id, row.cls, row.street, len(row.points)) == ("2080", "L", "A St", 2)
    ring = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]]]}, "properties": {"name": "T"}}
    (tmp_path / "p.json").write_text(json.dumps({"features": [ring]}))
    assert readers.rings(spark, str(tmp_path / "p.json")).count() == 3
    (tmp_path / "w.json").write_text(json.dumps({"daily": {"time": ["2024-01-01", "2024-01-02"], "tmax": [50.0, None], "precip": [None, 1.0]}}))
    assert [(str(r.day), r.tmax, r.precip) for r in readers.weather(spark, str(tmp_path / "w.json")).collect()] == [("2024-01-01", 50.0, 0.0)]
    (tmp_path / "r.gpx").write_text('<gpx><trk><trkseg><trkpt lat="40.7" lon="-74.0"><time>2023-12-17T18:41:53Z</time></trkpt><trkpt lat="40.8" lon="-74.0"></trkpt></trkseg></trk></gpx>')
    assert [(r.lon, r.lat) for r in readers.gpx(spark, str(tmp_path / "r.gpx")).collect()] == [(-74.0, 40.7)]
    cache = tmp_path / "cache"
    cache.mkdir()
    head, tag = '{"generator": "Overpass API", ', '"highway": "%s" '
    for name, body in (("a", head + tag % "footway" * 2 + tag % "cycleway"), ("b", head + tag % "footway" * 2 + tag % "cycleway"), ("c", head + tag % "motorway"), ("d", tag % "motorway"), ("e", head + "none at all")):
        (cache / name).write_text(body)
    assert sorted(r.kind for r in readers.responses(spark, str(cache)).collect()) == ["drive", "walk"]
    days = spark.createDataFrame([("a",), ("b",), ("c",)], "ride string")
    assert [r.ride for r in readers.new_rides(days, days.filter("ride = 'a'"), days.limit(0), 1).collect()] == ["b"]
    writers.write_trips(spark.range(2), spark.range(1), str(tmp_path / "out"), "export")
    assert spark.read.parquet(str(tmp_path / "out" / "trips")).columns == ["id", "source"]
    writers.write_features(spark.sql("select 'k' as name, array(named_struct('x', 1.0, 'y', 2.0)) as points"), str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).count() == 1


def test_views(spark):
    points = spark.createDataFrame([(1, 0.0, 5.0), (2, 0.0, 90.0)], "point long, x double, y double")
    features = spark.createDataFrame([(0.0, 0.0, 4, 100.0), (10.0, 0.0, 8, 300.0)], "x double, y double, n long, metres double")
    got = {r.point: r.passes for r in views.ends_near(features, points, 90).collect()}
    assert got[1] == 7.0
    counts = spark.createDataFrame([(1, datetime.date(2024, 1, 1), 2), (2, datetime.date(2025, 1, 1), 9)], "feature long, day date, n long")
    (row,) = views.in_dates(counts, datetime.date(2024, 1, 1), datetime.date(2024, 12, 31)).collect()
    assert (row.feature, row.n, row.top) == (1, 2, 2)
