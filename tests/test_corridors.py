"""Corridor merging on lines whose merged passes are known, and components against brute force."""

import json

from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import conflicts, corridors, graph
from wayfold.plans import registry
from wayfold.sources import writers

DATA = "/root/testdata/sf0.001"


def merged(spark, lines, rides):
    made = spark.createDataFrame([(fid, [(float(x), float(y)) for x, y in p]) for fid, p in lines], "fid long, points array<struct<x: double, y: double>>")
    passed = spark.createDataFrame(rides, "fid long, ride string, fwd int, rev int")
    return sorted((r.fid, r.n) for r in corridors.merge_corridors(made, passed)[0].collect())


def parallel(back=False):
    second = [(0, 10), (300, 10)]
    return [(1, [(0, 0), (300, 0)]), (2, second[::-1] if back else second)]


def test_parallel_lines_pool_rides(spark):
    assert [n for _, n in merged(spark, parallel(), [(1, "a", 1, 0), (2, "b", 1, 0)])] == [2]
    assert [n for _, n in merged(spark, parallel(), [(1, "a", 2, 0), (1, "b", 1, 0), (2, "a", 1, 0)])] == [3]


def test_directions_add_and_copies_do_not(spark):
    assert [n for _, n in merged(spark, parallel(), [(1, "a", 1, 0), (2, "a", 0, 1)])] == [2]
    assert [n for _, n in merged(spark, parallel(back=True), [(1, "a", 1, 0), (2, "a", 0, 1)])] == [1]
    assert [n for _, n in merged(spark, parallel(), [(1, "a", 0, 0), (2, "a", None, None)])] == [1]


def test_adjacent_blocks_stay_apart(spark):
    assert len(merged(spark, [(1, [(0, 0), (300, 0)]), (2, [(300, 0), (600, 0)])], [(1, "a", 1, 0), (2, "a", 1, 0)])) == 2


def test_staggered_decks_are_drawn_once_and_chains_keep_two(spark):
    decks = [(1, [(0, 0), (2100, 0)]), (2, [(60, 12), (2160, 12)])]
    assert len(merged(spark, decks, [(1, "a", 1, 0), (2, "b", 1, 0)])) == 1
    chain = [(1, [(0, 0), (400, 0)]), (2, [(90, 6), (490, 6)]), (3, [(180, 12), (580, 12)])]
    assert len(merged(spark, chain, [(1, "a", 1, 0), (2, "b", 1, 0), (3, "c", 1, 0)])) == 2


def test_a_short_quiet_line_goes_into_the_lines_that_cover_it(spark):
    lines = [(1, [(0, 0), (300, 0)]), (2, [(300, 0), (600, 0)]), (3, [(40, 8), (560, 8)])]
    rides = [(1, "a", 3, 0), (2, "a", 3, 0), (3, "b", 1, 0)]
    assert merged(spark, lines, rides) == [(1, 4), (2, 4)]


def test_no_lines(spark):
    assert merged(spark, [], []) == []


def test_components_of_the_whole_table(spark):
    got = dict(registry.queries()["q_components"](spark, DATA).collect())
    links = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_suppkey", (F.col("l_partkey") + 1000000).alias("p")).distinct().collect()
    around: dict = {}
    for u, v in links:
        around.setdefault(u, set()).add(v)
        around.setdefault(v, set()).add(u)
    want: dict = {}
    for start in sorted(around):
        todo = [start] if start not in want else []
        while todo:
            at = todo.pop()
            if at not in want:
                want[at] = start
                todo.extend(around[at])
    assert got == want


def line(*points):
    return [(float(x), float(y)) for x, y in points]


LINES = "fid long, name string, points array<struct<x: double, y: double>>, n long"


def test_busiest_stretch(spark):
    blocks = [(i, "Quay Road", line((100 * i + gap, 0), (100 * i + 100, 0)), n) for i, (n, gap) in enumerate([(9, 0), (10, 4), (8, 0), (5, 0)])]
    far = [(10, "Gap Lane", line((0, 500), (100, 500)), 7), (11, "Gap Lane", line((120, 500), (220, 500)), 7), (12, None, line((0, 900), (500, 900)), 99), (13, "Stub", line((0, 700), (20, 700)), 50)]
    rows = graph.busiest_stretches(spark.createDataFrame(blocks + far, LINES)).collect()
    assert [tuple(r) for r in rows] == [("Quay Road", 8, 296), ("Gap Lane", 7, 100)]


def test_simplify(spark):
    lines = spark.createDataFrame([(1, "", line((0, 0), (50, 0.4), (100, 0), (100, 80)), 1), (2, "", line((3, 3)), 1), (3, "", None, 1), (4, "", [], 1)], LINES)
    got = {r.fid: r.p and [(q.x, q.y) for q in r.p] for r in lines.select("fid", geo.simplify("points", 1.0).alias("p")).collect()}
    assert got == {1: [(0, 0), (100, 0), (100, 80)], 2: [(3, 3)], 3: None, 4: []}


def test_export(spark):
    lines = spark.createDataFrame([(1, "A", line((0, 0), (9, 0)), 3), (2, "B", line((0, 5), (4, 5), (9, 5)), 1)], LINES)
    passes = spark.createDataFrame([(1, "r1", 1, 1), (1, "r2", 0, 0), (2, "r2", None, 1)], "fid long, ride string, fwd int, rev int")
    rides = spark.createDataFrame([("r1", "2024-01-02", "08:00", 3.0), ("r2", "2024-01-05", "09:00", 4.0)], "ride string, day string, clock string, km double")
    head, rows = writers.export_parts(lines, passes, rides)
    props = json.loads(head.first().value)
    assert (props["total_rides"], props["dates"], props["max_count"]) == (2, ["2024-01-02", "2024-01-05"], 3)
    assert props["top_segment"] == {"name": "A", "x": 9.0, "y": 0.0} and props["rides"][1] == {"date": 1, "clock": "09:00", "km": 4.0}
    assert [json.loads(r.value)["properties"] for r in rows.collect()] == [{"name": "B", "rides": [1]}, {"name": "A", "rides": [0, 0, 1]}]


def test_permutation(spark):
    events = spark.createDataFrame([(i, 10, "p") for i in range(5)] + [(9, 500, "none")], "id long, value long, pool string")
    pools = spark.createDataFrame([("p", v) for v in (1, 2, 3)], "pool string, value long")
    assert tuple(graph.permutation_test(events, pools, 40).first()) == (10.0, 1.0)
    low = events.selectExpr("id", "0 as value", "pool")
    assert tuple(graph.permutation_test(low, pools, 40).first()) == (0.0, 0.0)
    one = graph.permutation_test(spark.createDataFrame([(1, 2, "p")], "id long, value long, pool string"), pools, 3000).first()
    assert abs(one.p - 2 / 3) < 0.04


def test_queries_without_sql_give_rows(spark):
    for name in ("q_merge_audit", "q_stations", "q_merge_corridors", "q_busiest_stretches", "q_export_features", "q_permutation", "q_matched_edges", "q_measured_rides", "q_lane_cover", "q_transit_lines", "q_largest_component", "q_contracted", "q_floor_sweep", "q_hmm_grid"):
        assert registry.queries()[name](spark, DATA).count() > 0, name


def test_audit(spark):
    made = lambda *lines: spark.createDataFrame([(i, "", p, 1) for i, p in enumerate(lines)], LINES)
    assert tuple(corridors.audit(made(line((0, 0), (300, 0)), line((0, 10), (300, 10)))).first()) == (2, 1, 0.3, 4, 4, True)
    assert tuple(corridors.audit(made(line((0, 0), (300, 0)), line((300, 0), (600, 0)), line((1000, 0), (1000, 90)))).first()) == (3, 0, 0.0, 6, 0, False)
    assert tuple(corridors.audit(made(line((0, 0), (300, 0)), line((320, 0), (600, 0)))).first())[3:] == (4, 2, True)
    assert tuple(corridors.audit(made()).first()) == (0, 0, 0.0, 0, 0, False)


def test_pick_stations(spark):
    rows = [(1, 1, 0, 0, 20), (1, 2, 400, 0, 8), (1, 3, 480, 0, 9), (1, 4, 5000, 0, 8), (2, 5, 0, 0, 9)]
    got = conflicts.pick_stations(spark.createDataFrame(rows, "region long, id long, x int, y int, n int"), region="region").collect()
    assert sorted((r.region, r.id, r.n, r.absorbed) for r in got) == [(1, 1, 28, [2]), (1, 3, 9, []), (2, 5, 9, [])]
