"""Passes, rankings, areas, networks, matchers and lanes on small fixtures with known results, and against brute force."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import areas, conflicts, harmony, lanes, matching, network, passes, rankings

POINTS = "points array<struct<x: double, y: double>>"
OUT = [(10 * i, 0, 2 * i) for i in range(11)]
BACK = [(100 - 10 * i, 0, 22 + 2 * i) for i in range(1, 11)]
LONG = ((0, 0), (2000, 0))


def line(spark, points, edge=1, name="k"):
    return spark.createDataFrame([(edge, name, [(float(x), float(y)) for x, y in points])], f"edge long, name string, {POINTS}")


def measured(spark, rows, points=((0, 0), (100, 0))):
    fixes = spark.createDataFrame([("r", i, float(x), float(y), float(t)) for i, (x, y, t) in enumerate(rows)], "ride string, seq long, x double, y double, t double")
    return passes.measure_rides(fixes, line(spark, points), spark.createDataFrame([(1, "r")], "edge long, ride string"))


def counted(spark, rows, points=((0, 0), (100, 0))):
    return [(r.fwd, r.rev) for r in passes.traversals(measured(spark, rows, points)).collect()]


def fragments(t0):
    return [(100 * i, 500 if 100 * i in (700, 1400) else 0, t0 + 20 * i) for i in range(21)]


@pytest.mark.parametrize(
    "rows, points, want",
    [
        (OUT, ((0, 0), (100, 0)), [(1, 0)]),
        (OUT + BACK, ((0, 0), (100, 0)), [(1, 1)]),
        (OUT + [(200, 500, 40), (300, 500, 60)] + [(x, y, t + 100) for x, y, t in OUT], ((0, 0), (100, 0)), [(2, 0)]),
        ([(10 * i, 0, 2 * i) for i in range(5)] + [(40 + 10 * i, 0, 128 + 2 * i) for i in range(7)], ((0, 0), (100, 0)), [(1, 0)]),
        ([(x, 0, 2 * i) for i, x in enumerate([0, 10, 20, 14, 30, 40, 50, 45, 60, 70, 80, 90, 100])], ((0, 0), (100, 0)), [(1, 0)]),
        (fragments(0), LONG, [(1, 0)]),
        (fragments(0) + [(2500, 500, 420), (2600, 500, 440)] + fragments(600), LONG, [(2, 0)]),
        (OUT + [(200, 500, 60), (300, 500, 80)] + [(x, y, t + 100) for x, y, t in OUT], LONG, []),
        (OUT, ((0, 500), (100, 500)), []),
        ([(0, 0, 0), (50, 0, 1), (100, 0, 2)], ((0, 0), (100, 0)), []),
    ],
)
def test_traversals(spark, rows, points, want):
    assert counted(spark, rows, points) == want


def test_chunks_of_a_pass(spark):
    (row,) = passes.fold(passes.pass_chunks(measured(spark, OUT))).collect()
    assert (row.way, row.n, row.dist, row.time, row.s1) == (1, 1, 100.0, 20.0, 18.0)
    paused = [(10 * i, 0, 2 * i) for i in range(6)] + [(10 * i, 0, 600 + 2 * i) for i in range(6, 11)]
    (row,) = passes.fold(passes.pass_chunks(measured(spark, paused))).collect()
    assert row.n == 2 and row.time < 60
    slower = [(10 * i, 0, i) for i in range(31)] + [(300 + 10 * i, 0, 30 + 4 * i) for i in range(1, 31)]
    speeds = {r.chunk: 3.6 * r.dist / r.time for r in passes.fold(passes.pass_chunks(measured(spark, slower, ((0, 0), (600, 0))))).collect()}
    assert sorted(speeds) == [0, 1, 2, 3] and speeds[0] > 2 * speeds[3]
    both = passes.fold(passes.pass_chunks(measured(spark, OUT + BACK)))
    assert {(r.way, r.n) for r in passes.add_folds(both, both).collect()} == {(0, 2), (1, 2)}
    assert passes.measured_chunks(both).first().n == 1


def test_chunk_counts_and_slices(spark):
    counts = spark.createDataFrame([(63.0,), (2163.0,), (1e9,)], "m double").select(passes.chunks_of(F.col("m")).alias("n")).collect()
    assert [r.n for r in counts] == [1, 14, 24]
    pieces = passes.slices(line(spark, [(0, 0), (300, 0)]), F.lit(3)).orderBy("chunk").collect()
    assert [[(p.x, p.y) for p in r.piece] for r in pieces] == [[(0, 0), (100, 0)], [(100, 0), (200, 0)], [(200, 0), (300, 0)]]
    assert len(passes.slices(line(spark, [(0, 0), (0, 0)]), F.lit(4)).collect()) == 1


FOLD = "edge long, chunk int, way int, dist double, time double, moving double, n long, s1 double, s2 double"


def record(edge, chunk, way, dist, time, n, speeds=None):
    speeds = speeds or [3.6 * dist / time] * n
    return (edge, chunk, way, float(dist), float(time), float(time), n, float(sum(speeds)), float(sum(s * s for s in speeds)))


def test_corridors_split_at_the_crest(spark, monkeypatch):
    monkeypatch.setattr(passes, "chunks_of", lambda length: F.lit(6))
    rows = [record(1, i, way, 100, 20 if (way == 0) == (i < 3) else 40, 5) for i in range(6) for way in (0, 1)]
    got = rankings.top_corridors(spark.createDataFrame(rows, FOLD), line(spark, [(x, 0) for x in range(0, 1201, 100)], 1, "Ridge")).collect()
    assert [(r["dir"], r.m, r.fast, r.slow, r.gap) for r in got] == [("E", 600, 18.0, 9.0, 9.0), ("W", 600, 18.0, 9.0, 9.0)]
    few = [record(1, i, way, 100, 20 if way else 40, 2) for i in range(6) for way in (0, 1)]
    assert rankings.top_corridors(spark.createDataFrame(few, FOLD), line(spark, [(0, 0), (1200, 0)], 1, "Ridge")).count() == 0


def test_stretches_chain_edges_of_a_street(spark):
    blocks = line(spark, [(0, 0), (100, 0)], 1, "Quay").union(line(spark, [(100, 0), (200, 0)], 2, "Quay"))
    folded = spark.createDataFrame([record(e, 0, 1, 100, 20, 5) for e in (1, 2, 3)], FOLD)
    whole = blocks.union(line(spark, [(200, 0), (300, 0)], 3, "Quay"))
    assert [(r.name, r.kmh, r["dir"], r.m) for r in rankings.top_stretches(rankings.stretches(folded, whole), True).collect()] == [("Quay", 18.0, "E", 300)]
    assert rankings.stretches(folded, blocks.union(line(spark, [(200, 0), (300, 0)], 3, "Other"))).count() == 0


def test_stretches_rank_by_speed_then_steadiness(spark):
    lines = line(spark, [(0, 0), (600, 0)], 1, "Uneven").union(line(spark, [(0, 500), (600, 500)], 2, "Even")).union(line(spark, [(0, 900), (600, 900)], 3, "Slow"))
    speeds = {1: [10.0, 10.0, 26.0, 26.0, 18.0], 2: [18.0] * 5, 3: [3.0, 15.0, 3.0, 15.0, 9.0]}
    folded = spark.createDataFrame([record(e, c, 1, 100, 20, 5, s) for e, s in speeds.items() for c in range(4)], FOLD)
    rows = rankings.stretches(folded, lines).cache()
    assert [r.name for r in rankings.top_stretches(rows, True).collect()] == ["Even", "Uneven", "Slow"]
    assert [(r.name, r.kmh, r.sd) for r in rankings.top_stretches(rows, False).collect()][0] == ("Slow", 9.0, 5.4)


def test_chains_fork_and_loop(spark):
    units = [(1, "k", 0, 1, 90.0), (2, "k", 1, 2, 90.0), (3, "k", 1, 9, 0.0), (4, "l", 5, 6, 0.0), (5, "l", 6, 5, 180.0), (6, "k", 7, 1, 45.0)]
    got = {r.unit: (r.chain, r.place) for r in rankings.chain_units(spark.createDataFrame(units, "unit long, name string, a long, b long, bearing double")).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 6: (6, 0), 3: (6, 1), 4: (4, 0), 5: (4, 1)}


def test_greedy_choices_against_a_pass_over_the_rows(spark):
    rng = random.Random(6)
    rows = [(i, float(rng.randrange(600)), float(rng.randrange(600)), rng.randrange(1, 9)) for i in range(150)]
    got = {r.id: r.cluster for r in conflicts.density_clusters(spark.createDataFrame(rows, "id long, x double, y double, n long"), 60).collect()}
    near = {i: [j for j, u, v, _ in rows if math.hypot(x - u, y - v) <= 60] for i, x, y, _ in rows}
    want: dict = {}
    for i in sorted(near, key=lambda i: (-len(near[i]), i)):
        if i not in want:
            want.update({j: i for j in near[i] if j not in want})
    assert got == want
    kept: list = []
    for i, x, y, n in sorted(rows, key=lambda r: (-r[3], r[0])):
        close = next((k for k in kept if math.hypot(k[1] - x, k[2] - y) < 80), None)
        if close:
            close[3] += n
        else:
            kept.append([i, x, y, n])
    stations = conflicts.pick_stations(spark.createDataFrame(rows, "id long, x double, y double, n long"), 80, 9).collect()
    assert sorted((r.id, r.n) for r in stations) == sorted((k[0], k[3]) for k in kept if k[3] >= 9)


RINGS = "area long, ax double, ay double, bx double, by double"


def square(area, x0, x1, y0=0, y1=500):
    return [(area, *map(float, s)) for s in ((x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0))]


def test_areas_hold_points_and_their_neighbours(spark):
    rings = spark.createDataFrame(square(0, 0, 500) + square(1, 600, 1100), RINGS)
    points = spark.createDataFrame([(i, float(x), 250.0) for i, x in enumerate((250, 800, 530, 5000, 520, 580))] + [(6, 500.0, 0.0)], "point long, x double, y double")
    assert [r.area for r in areas.locate(points, rings, 50, 55.0).orderBy("point").collect()] == [0, 1, 0, None, 0, 1, 0]
    cut = areas.shares(spark.createDataFrame([(1, [(100.0, 100.0), (700.0, 100.0)])], f"edge long, {POINTS}"), rings, 50)
    assert {r.area: round(r.metres) for r in cut.collect()} == {0: 400, None: 100, 1: 100}


def test_polygons_against_brute_force(spark):
    rng = random.Random(3)
    shapes = []
    for _ in range(5):
        x, y = rng.randrange(1000), rng.randrange(1000)
        shapes.append([(round(x + rng.randrange(50, 300) * math.cos(t)), round(y + rng.randrange(50, 300) * math.sin(t))) for t in sorted(rng.random() * 6.283 for _ in range(rng.randrange(3, 9)))])
    shapes.append([(64, 64), (640, 64), (640, 512), (64, 512)])  # on the borders of cells
    sides = [(a, *map(float, (*p, *q))) for a, s in enumerate(shapes) for p, q in zip(s, s[1:] + s[:1], strict=True)]
    points = [(i, float(rng.randrange(-200, 1300)), float(rng.randrange(-200, 1300))) for i in range(2000)]
    points += [(3000 + 20 * i + j, 32.0 * i, 32.0 * j) for i in range(20) for j in range(20)]
    want = set()
    for i, x, y in points:
        for a in range(len(shapes)):
            own = [s[1:] for s in sides if s[0] == a]
            odd = sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for ax, ay, bx, by in own) % 2
            on = any((bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by) for ax, ay, bx, by in own)
            if odd or on:
                want.add((i, a))
    got = areas.inside(spark.createDataFrame(points, "point long, x double, y double"), spark.createDataFrame(sides, RINGS), 64)
    assert {(r.point, r.area) for r in got.collect()} == want


def test_area_measure(spark):
    names = spark.createDataFrame([(0, "Osthafen", "Q"), (1, "Westend", "B")], "area long, name string, boro string")
    placed = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "edge long, area long")
    edges = spark.createDataFrame([(1, 100.0, True), (2, 300.0, True), (3, 50.0, True)], "edge long, metres double, rideable boolean")
    day = datetime.date
    rides = spark.createDataFrame([(1, "a", day(2024, 1, 2)), (2, "a", day(2024, 1, 1)), (2, "b", day(2024, 2, 1)), (3, "a", day(2024, 1, 1))], "edge long, ride string, day date")
    speeds = spark.createDataFrame([(2, 500.0, 90.0)], "edge long, metres double, seconds double")
    rows, first = areas.measure(names, placed, edges, rides, speeds)
    shown = areas.summary(rows, first).orderBy("rank").collect()
    assert [(r.name, r.net_m, r.ridden_m, r.dist_m, [(str(n.day), n.metres) for n in r.new]) for r in shown] == [("Westend", 300, 300, 500, [("2024-01-01", 300)]), ("Osthafen", 100, 100, 0, [("2024-01-02", 100)])]
    assert {r.area: r.rides for r in rows.collect()} == {0: 1, 1: 2}


def two_way(u, v, at, tag="residential"):
    (ax, ay), (bx, by) = at[u], at[v]
    length = math.hypot(ax - bx, ay - by)
    return [(u, v, ax, ay, bx, by, length, tag), (v, u, bx, by, ax, ay, length, tag)]


EDGES = "u long, v long, ax double, ay double, bx double, by double, length double, tag string"
AT = {r * 10 + c: (100.0 * c, 100.0 * r) for r in range(5) for c in range(5)}
GRID = [e for r in range(5) for c in range(5) for e in (two_way(r * 10 + c, r * 10 + c + 1, AT) if c < 4 else []) + (two_way(r * 10 + c, r * 10 + c + 10, AT) if r < 4 else [])]


def matched(spark, edges, points, method):
    fixes = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "ride long, seq long, x double, y double")
    found, missed = matching.match(fixes, spark.createDataFrame(edges, EDGES), method)
    return [(r.u, r.v) for r in found.orderBy("k").collect()], sum(r.skipped for r in missed.collect())


CORNER = [(x, 2) for x in range(0, 201, 20)] + [(202, y) for y in range(20, 201, 20)]


@pytest.mark.parametrize("method", ["likeliest", "nearest"])
def test_matchers_on_a_grid(spark, method):
    assert matched(spark, GRID, CORNER, method) == ([(0, 1), (1, 2), (2, 12), (12, 22)], 0)
    rng = random.Random(0)
    assert matched(spark, GRID, [(x, rng.uniform(-5, 5)) for x in range(0, 301, 20)], method) == ([(0, 1), (1, 2), (2, 3)], 0)


def test_likeliest_goes_on_behind_a_gap(spark):
    away = [(1000 + 20 * i, 1000) for i in range(10)]
    found, missed = matched(spark, GRID, [(x, 3) for x in range(0, 201, 20)] + away + [(x, 303) for x in range(300, 401, 20)], "likeliest")
    assert missed == 1 and found[:2] == [(0, 1), (1, 2)] and found[-1] == (33, 34)


def test_nearest_routes_skips_and_drops_loops(spark):
    at = {1: (0.0, 0.0), 2: (100.0, 0.0), 3: (200.0, 0.0), 4: (0.0, 30.0), 5: (2900.0, 0.0), 6: (3000.0, 0.0), 7: (400.0, 0.0)}
    assert matched(spark, two_way(1, 2, at) + two_way(2, 3, at), [(0, 0), (200, 0)], "nearest") == ([(1, 2), (2, 3)], 0)
    assert matched(spark, two_way(1, 2, at) + two_way(5, 6, at), [(0, 0), (3000, 0)], "nearest") == ([], 1)
    assert matched(spark, two_way(1, 2, at) + two_way(1, 4, at, "footway"), [(0, 0), (0, 30), (0, 0), (20, 0), (60, 0), (100, 0)], "nearest") == ([(1, 2)], 0)
    assert matched(spark, GRID, [(x, 2) for x in range(0, 201, 20)] + [(x, 2) for x in range(180, -1, -20)], "nearest") == ([(0, 1), (1, 2)], 0)
    assert matched(spark, GRID, [(0, 3), (200, 900), (100, 3)], "nearest") == ([(0, 1)], 0)
    assert matched(spark, two_way(1, 7, at), [(150, 3), (250, 3)], "nearest") == ([(1, 7)], 0)


NODES = "id long, x double, y double"
NET = f"u long, v long, k long, pos long, length double, highway array<string>, name array<string>, {POINTS}"


def test_edges_through_other_nodes_go(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 200.0, 0.0)], NODES)
    edge = lambda u, v, points=None: (u, v, 0, u * 10 + v, 100.0, ["residential"], [], points)
    through = [(0.0, 0.0), (100.0, 0.0), (200.0, 0.0)]
    whole = spark.createDataFrame([edge(1, 2), edge(2, 3), edge(1, 3, through)], NET)
    assert sorted((r.u, r.v) for r in network.without_subsumed(nodes, whole).collect()) == [(1, 2), (2, 3)]
    assert network.subsumed(nodes, spark.createDataFrame([edge(1, 2), edge(1, 3, through)], NET)).count() == 0


def test_sidewalks_and_drawn_lines(spark):
    at = {0: (0, 0), 1: (100, 0), 100: (0, 8), 101: (100, 8), 200: (0, 200), 201: (100, 200), 300: (50, 0), 301: (50, 40)}
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in at.items()], NODES)
    rows = [(u, v, 0, u, 100.0, [tag], None, None) for u, v, tag in ((0, 1, "secondary"), (100, 101, "footway"), (200, 201, "footway"), (300, 301, "footway"))]
    edges = spark.createDataFrame(rows, NET)
    assert [(r.u, r.v) for r in network.sidewalks(network.edge_lines(nodes, edges)).collect()] == [(100, 101)]
    service = edges.withColumn("highway", F.transform("highway", lambda t: F.when(t == "secondary", "service").otherwise(t)))
    assert network.sidewalks(network.edge_lines(nodes, service)).count() == 0
    assert network.match_edges(nodes, edges).count() == 3
    twice = [(0, 1, 0, 1, 90.0, ["residential", "cycleway"], ["", "A"], None), (1, 0, 1, 2, 50.0, ["primary"], ["B"], [(100.0, 0.0), (0.0, 0.0)])]
    (row,) = network.drawn_lines(nodes, spark.createDataFrame(twice, NET)).collect()
    assert (row.u, row.v, row.tag, row.name, row.points[0].x) == (0, 1, "cycleway", "B", 100.0)


def test_contraction_and_components(spark):
    rows = [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (3, 5, 2.0), (8, 9, 4.0)]
    edges = spark.createDataFrame(rows, "u long, v long, length double")
    assert sorted(tuple(r) for r in network.contract(edges).collect()) == [(1, 3, 2.0), (3, 4, 1.0), (3, 5, 2.0), (8, 9, 4.0)]
    assert network.largest_component(edges).count() == 4


STREET = [(0.0, 0.0), (300.0, 0.0)]


def first_day(spark, points, inst="2020-01-01", ret=None):
    date = datetime.date.fromisoformat
    lane = spark.createDataFrame([(1, 0, date(inst), date(ret) if ret else None, points)], f"lane long, part int, inst date, ret date, {POINTS}")
    rides = spark.createDataFrame([(1, date("2024-06-01")), (1, date("2025-05-01"))], "edge long, day date")
    return lanes.first_ridden(lane, spark.createDataFrame([(1, STREET)], f"edge long, {POINTS}"), rides).first().first


def test_lanes_are_ridden_by_half(spark):
    day = datetime.date
    assert first_day(spark, STREET) == first_day(spark, STREET[::-1]) == first_day(spark, [(0.0, 8.0), (300.0, 8.0)]) == first_day(spark, [(0.0, 0.0), (500.0, 0.0)]) == day(2024, 6, 1)
    assert first_day(spark, STREET, "2025-01-01") == day(2025, 5, 1)
    for points, ret in (([(0.0, 40.0), (300.0, 40.0)], None), ([(150.0, -150.0), (150.0, 150.0)], None), (STREET, "2024-01-01"), ([(0.0, 0.0), (900.0, 0.0)], None)):
        assert first_day(spark, points, ret=ret) is None


def test_riding_on_lanes(spark):
    day = datetime.date
    schema = f"lane long, part int, inst date, ret date, cls string, {POINTS}"
    halves = spark.createDataFrame([(1, 0, day(2020, 1, 1), None, "I", [(0.0, 0.0), (150.0, 0.0)]), (2, 0, day(2020, 1, 1), None, "I", [(150.0, 0.0), (300.0, 0.0)])], schema)
    street = spark.createDataFrame([(1, STREET)], f"edge long, {POINTS}")
    rides = spark.createDataFrame([(1, "a", day(2024, 6, 1), 300.0, 2), (1, "b", day(2025, 5, 1), 300.0, None)], "edge long, ride string, day date, metres double, passes long")
    shares = lambda built: sorted(tuple(r) for r in lanes.riding_share(lanes.edge_cover(built, street), built, rides).collect())
    assert shares(halves) == [(2024, 600, 600, 600), (2025, 300, 300, 300)]
    painted = spark.createDataFrame([(1, 0, day(2025, 1, 1), None, "II", STREET)], schema)
    assert shares(painted) == [(2024, 600, 0, 0), (2025, 300, 300, 0)]
    (joined,) = lanes.merged_lines(halves.withColumn("v", F.lit(1)), "v").collect()
    assert [p.x for p in joined.points] in ([0, 150, 300], [300, 150, 0])


def test_lane_versions_go_back(spark):
    raw = spark.createDataFrame(
        [(str(i), prev, "I" if i == 3 else None, "QUAY  RD", f"{2000 + i}-01-01T00:00:00.000", None if i == 3 else f"{2001 + i}-01-01T00:00:00.000") for i, prev in ((1, None), (2, "1.0"), (3, "2"))],
        "bikeid string, prevbikeid string, facilitycl string, street string, instdate string, ret_date string",
    ).selectExpr("*", "'x' as ft_facilit", "cast(null as string) as tf_facilit", "array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 0D))) as parts")
    rows = lanes.normalised(raw).cache()
    drawn = lanes.alive(rows, F.lit("2005-01-01").cast("date"), F.lit("2006-01-01").cast("date"))
    assert [r.id for r in drawn.collect()] == ["3"]
    got = lanes.versions(rows, drawn).collect()
    assert sorted((r.id, r.prev, r.cls, r.street, r.drawn) for r in got) == [("1", None, "L", "Quay Rd", False), ("2", "1", "L", "Quay Rd", False), ("3", "2", "I", "Quay Rd", True)]


def lined(spark, rows):
    return spark.createDataFrame([(fid, [(float(x), float(y)) for x, y in p]) for fid, p in rows], f"fid long, {POINTS}")


def test_ends_are_joined_and_rings_go(spark):
    lines = lined(spark, [(1, [(0, 0), (100, 0)]), (2, [(110, 10), (200, 10), (300, 10)]), (3, [(325, 30), (400, 30)]), (4, [(900, 0), (950, 0)])])
    got = {r.fid: [(p.x, p.y) for p in r.points] for r in harmony.join_ends(lines).collect()}
    assert got[1][-1] == (110.0, 10.0) and len(got[1]) == 3 and got[2][0] == (100.0, 0.0) and len(got[2]) == 4 and got[4] == [(900, 0), (950, 0)]
    ring = [(0, 10), (40, 10), (40, 30), (0, 30), (0, 14)]
    both = lined(spark, [(1, [(-50, 0), (100, 0)]), (2, ring)])
    held = lambda rows: sorted(r.fid for r in harmony.without_rings(both, spark.createDataFrame(rows, "fid long, ride string, fwd int, rev int")).collect())
    assert held([(1, "a", 1, 0), (2, "a", 1, 0)]) == [1]
    assert held([(1, "a", 1, 0), (2, "a", 0, 1)]) == held([(1, "b", 1, 0), (2, "a", 1, 0)]) == [1, 2]
    assert held([(1, "a", 1, 0), (2, "a", 0, 0)]) == [1]


def test_centre_lines_and_alternatives(spark):
    members = lined(spark, [(1, [(0, 0), (100, 0)]), (2, [(0, 10), (100, 10)])]).withColumn("cluster", F.lit(1))
    (row,) = harmony.centre_lines(members.filter("fid = 1"), members).collect()
    assert [p.y for p in row.points] == [5.0, 5.0]
    lines = lined(spark, [(1, [(0, 0), (100, 0)]), (2, [(100, 10), (200, 10)])])
    other = lined(spark, [(2, [(100, 0), (200, 0)])]).withColumn("alt", F.lit(0))
    got = {r.fid: r.points[0].y for r in harmony.harmonize(lines, other).collect()}
    assert got == {1: 0.0, 2: 0.0}
