"""Faults found in a review: queries on odd inputs, and operators on many copies of a place, a time or a line."""

import random

import pytest

from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import conflicts, corridors, daily, graph, joins, lanes, rankings, traces, transit, trips

HOUR, DAY = 3_600_000, 86_400_000


def test_weather_note_without_a_limit(spark):
    bands = spark.createDataFrame([(0, 50.0, 50.0), (1, 50.0, 50.0), (2, 0.0, 0.0)], "band int, share double, expected double")
    assert daily.weather_note(bands).count() == 0
    assert tuple(daily.weather_note(bands, None).first()) == (0, 0.0)
    assert daily.weather_note(bands.filter("expected = 0"), None).count() == 0


def test_draws_without_pairs_against_replay(spark):
    rng = random.Random(8)
    rows = [(f"{i:03d}", rng.randrange(150) * HOUR // 3, rng.randrange(3) * HOUR, rng.choice("AB"), rng.choice("AB"), f"b{rng.randrange(9)}", rng.random() < 0.1) for i in range(150)]
    table = spark.createDataFrame(rows, "id string, t long, dur long, a string, b string, bike string, ebike boolean").cache()
    pairs = trips.replay(table, spark.createDataFrame([("A", 0.0, 0.0)], "name string, lon double, lat double"), month_ms=DAY).cache()
    want: dict = {}
    for r in pairs.collect():
        x = want.setdefault(r.draw, [0, 0, 0, 0])
        x[0] += not r.hit
        x[1] += not r.hit and any(e and b == r.bike for *_, b, e in rows)
        x[2] += r.hit
        x[3] += round(r.age * DAY)
    each = trips.seen(table, bucket_ms=7 * HOUR).cache()
    assert {r.draw: [r.exposure, r.electric, r.met, r.age_ms] for r in each.collect() if r.exposure + r.met} == want
    days = (0, 1, 2, None)
    assert sorted(map(str, trips.implied_pool(trips.seen_within(table, days, bucket_ms=HOUR)).collect())) == sorted(map(str, trips.implied_pool(pairs, days).collect()))
    marked = trips.resumed(table).filter("not resume").selectExpr("id as draw", "a as dock", "ebike")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(trips.by_dock(marked, each), trips.by_dock(marked, pairs))
    assert same(trips.ebike_odds(each, marked), trips.ebike_odds(pairs, marked, table.filter("ebike").select("bike").distinct()))


def test_points_of_one_place_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(12) * 7, rng.randrange(4) * 7) for i in range(160)] + [(900, 5000, 5000)]
    points = spark.createDataFrame(rows, "id long, x long, y long").cache()
    d2 = lambda a, b: (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2
    near = {a[0]: sorted((d2(a, b), b[0]) for b in rows if a[0] != b[0] and d2(a, b) <= 100) for a in rows}
    counted = joins.count_within(points, 10, "id")
    assert {r.id: r.n for r in counted.collect()} == {i: len(n) for i, n in near.items() if n}
    found = joins.nearest(points, points, 10, 4, "id", "id", other=True)
    assert sorted((r.id, r["rank"], r.d2, r.near) for r in found.collect()) == [(i, k + 1, *p) for i in sorted(near) for k, p in enumerate(near[i][:4])]
    one = joins.nearest_one(points, points, 40, "id", "id", start=5, other=True)
    assert {r.id: r.near for r in one.collect()} == {i: n[0][1] for i, n in near.items() if n}
    # a place of 2,000 points brings five of them to a join, not 2,000
    crowd = spark.range(2000).selectExpr("id", "0L as x", "0L as y")
    assert joins.nearest(crowd, crowd, 10, 4, "id", "id", other=True).groupBy("id").count().filter("count <> 4").count() == 0


@pytest.mark.parametrize("walked", [0, 1_000_000])
def test_clusters_of_copies_against_a_walk(spark, monkeypatch, walked):
    monkeypatch.setattr(conflicts, "WALKED", walked)
    rng = random.Random(4)
    rows = [(i, rng.randrange(2), rng.randrange(9) * 40, rng.randrange(3) * 40) for i in rng.sample(range(900), 150)]
    near = {a[0]: {b[0] for b in rows if a[1] == b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 60 * 60} for a in rows}
    want: dict = {}
    for i in sorted(near, key=lambda i: (-len(near[i]), i)):
        if i not in want:
            want |= {j: i for j in near[i] if j not in want}
    got = conflicts.density_clusters(spark.createDataFrame(rows, "id long, region int, x long, y long"), 60, "region")
    assert {r.id: r.cluster for r in got.collect()} == want


def _lines(spark, shapes):
    return spark.createDataFrame([(fid, [(float(x), float(y)) for x, y in points]) for fid, points in shapes], "fid long, points array<struct<x: double, y: double>>")


def test_lines_of_one_shape_against_lines_beside_each_other(spark, monkeypatch):
    rng = random.Random(6)
    shapes = [(i, [(90 * rng.randrange(4), 10 * (y := rng.randrange(4))), (90 * rng.randrange(4, 7), 10 * y)]) for i in rng.sample(range(1, 500), 40)] + [(501, [(0, 900), (0, 1000)])]
    lines = _lines(spark, shapes).cache()
    rides = spark.createDataFrame([(i, r, r % 3, 1) for i, _ in shapes for r in rng.sample(range(30), rng.randrange(1, 9))], "fid long, ride long, fwd int, rev int").cache()

    def found():
        shown, ridden = corridors.merge_corridors(lines, rides)
        return sorted((r.fid, r.n) for r in shown.collect()), sorted(map(str, ridden.collect())), corridors.audit(lines).first()

    got = found()
    alone = lambda rows: (rows.select("fid", "points", F.lit(1).alias("m"), F.col("fid").alias("least")), rows.select("fid", F.col("fid").alias("shape")))
    monkeypatch.setattr(corridors, "shapes", alone)
    want = found()
    assert len({str(p) for _, p in shapes}) < len(shapes) - 9
    assert got[:2] == want[:2]
    assert tuple(got[2])[:2] == tuple(want[2])[:2] and tuple(got[2])[3:] == tuple(want[2])[3:] and got[2].duplicate_km == pytest.approx(want[2].duplicate_km)


def test_permutation_against_medians_of_all_draws(spark):
    rng = random.Random(9)
    pools = spark.createDataFrame([(rng.choice("abc"), rng.choice([None, *range(8)])) for _ in range(40)], "pool string, value long").cache()
    for n in (1, 2, 6, 7):
        events = spark.createDataFrame([(i, rng.randrange(8), rng.choice("abcd")) for i in range(n)], "id long, value long, pool string").cache()
        sizes = pools.groupBy("pool").agg(F.count("*").alias("size"))
        members = pools.withColumn("at", F.expr("row_number() over (partition by pool order by value) - 1"))
        drawn = events.select("id", "pool").join(sizes, "pool").withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(300)))).withColumn("at", F.pmod(F.xxhash64("trial", "id"), F.col("size")).cast("int"))
        medians = drawn.join(members, ["pool", "at"]).groupBy("trial").agg(F.median("value").alias("m"))
        observed = events.join(sizes, "pool").agg(F.median("value").alias("observed"))
        want = medians.join(observed).agg(F.max("observed"), F.avg((F.col("m") <= F.col("observed")).cast("double"))).first()
        got = graph.permutation_test(events, pools, 300).first()
        assert got.observed == want[0] and got.p == pytest.approx(want[1])


@pytest.mark.parametrize("bucket", [50, 500, 5000])
def test_longest_overlap_by_sweep_against_pairs(spark, bucket):
    rng = random.Random(bucket)
    spans = [(i, s := rng.randrange(1500), s + rng.choice([0, 5, 60, 60, 120, 300, rng.randrange(1, 400)])) for i in rng.sample(range(900), 160)]
    got = joins.longest_overlap_of_others(spark.createDataFrame(spans, "id long, s long, e long"), 10, bucket, "id")
    want = {}
    for i, s, e in spans:
        near = [(-(min(e, e2) - max(s, s2)), j) for j, s2, e2 in spans if j != i and min(e, e2) - max(s, s2) >= 10]
        want[i] = (min(near)[1], -min(near)[0]) if near else (None, None)
    assert {r.id: (r.match, r.overlap) for r in got.collect()} == want


def test_copies_of_edges_and_lanes_have_the_shares_of_each(spark):
    line = lambda x, y, n: [(float(x), float(y)), (float(x + n), float(y))]
    edges = [(i, line(100 * (i % 3), 50 * (i % 3 // 2), 200)) for i in range(14)]
    built = [(i, part, line(90 * (i % 2) + 300 * part, 8, 150)) for i in range(5) for part in range(1 + i % 3)]
    of = lambda es, ls: lanes.edge_cover(spark.createDataFrame(ls, f"lane long, part int, {kind}"), spark.createDataFrame(es, f"edge long, {kind}"))
    kind = "points array<struct<x: double, y: double>>"
    want = {}
    for e in edges[:3]:
        for i in range(5):
            want |= {(r.edge, r.lane): r.share for r in of([e], [b for b in built if b[0] == i]).collect()}
    got = {(r.edge, r.lane): r.share for r in of(edges, built).collect()}
    assert {k: v for k, v in got.items() if k[0] < 3} == want
    assert all(got.get((e, i)) == want.get((e % 3, i)) for e, _ in edges for i in range(5))


def test_chains_settle_nodes_without_pairs(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice("AB"), rng.randrange(3), rng.randrange(3), rng.choice([0.0, 90.0, 355.0, rng.random() * 360])) for i in range(60)] + [(90, None, 1, 1, 0.0), (91, "A", 1, 2, None)]
    units = spark.createDataFrame(rows, "unit long, name string, a long, b long, bearing double").cache()
    ends = units.select(F.col("unit").alias("u"), "name", F.col("b").alias("node"), F.col("bearing").alias("from"))
    starts = units.select(F.col("unit").alias("v"), "name", F.col("a").alias("node"), F.col("bearing").alias("to"))
    options = ends.join(starts, ["name", "node"]).filter("u <> v").select("u", "v", F.when(F.expr("`from` is not null and `to` is not null"), geo.turn("from", "to")).alias("turn"))
    found = rankings.link_nodes(units).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, rankings.link(options).collect()))
    # many units of one bearing at one node: as many rounds of joins before
    crowd = spark.range(1500).selectExpr("id as unit", "'x' as name", "0L as a", "0L as b", "10D as bearing")
    assert rankings.chain_units(crowd).agg(F.count_distinct("unit"), F.max("place")).first()[0] == 1500


def test_chains_of_any_length_are_followed(spark):
    rng = random.Random(5)
    ids = rng.sample(range(10_000), 900)
    path, loop, pair, lone = ids[:600], ids[600:890], ids[890:892], ids[892:]
    links = list(zip(path, path[1:])) + list(zip(loop, loop[1:] + loop[:1])) + [(pair[0], pair[1]), (pair[1], pair[0])]
    want = {u: (path[0], i) for i, u in enumerate(path)} | {u: (u, 0) for u in lone}
    for ring in (loop, pair):
        least = ring.index(min(ring))
        want |= {u: (min(ring), (i - least) % len(ring)) for i, u in enumerate(ring)}
    got = rankings.follow(spark.createDataFrame([(i,) for i in ids], "unit long"), spark.createDataFrame(links, "u long, v long"))
    assert {r.unit: (r.chain, r.place) for r in got.collect()} == want
    none = rankings.follow(spark.createDataFrame([(1,)], "unit long"), spark.createDataFrame([], "u long, v long"))
    assert [tuple(r) for r in none.collect()] == [(1, 1, 0)]


def test_stops_of_a_place_are_compared_as_lists(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 1, 2, None]), rng.randrange(4) * 200, rng.randrange(2) * 300) for i in range(150)]
    stops = spark.createDataFrame(rows, "id long, line int, x long, y long")
    want = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and None not in (a[1], b[1]) and a[1] != b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 360**2]
    for listed in (1000, 3):
        monkeypatch.setattr(transit, "LISTED", listed)
        assert sorted(map(tuple, transit.transfers(stops).collect())) == want
    monkeypatch.undo()
    compared, real = [], joins.pairs_within
    monkeypatch.setattr(joins, "pairs_within", lambda points, *more: compared.append(points.count()) or real(points, *more))
    crowd = spark.range(3000).selectExpr("id", "id % 3 as line", "0L as x", "0L as y")
    assert transit.transfers(crowd).count() == 3 * 1000 * 1000
    assert compared == [3]  # lists, not 3,000 stops


def test_rides_along_each_other_against_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    shapes = [[(rng.randrange(5) * 8, rng.randrange(5) * 8) for _ in range(rng.randrange(1, 9))] for _ in range(6)]
    rides = {ride: shapes[ride % 6] if ride < 18 else [(rng.randrange(40), rng.randrange(40)) for _ in range(6)] for ride in range(24)}
    fixes = [(ride, ride * 100 + i, *at) for ride, way in rides.items() for i, at in enumerate(way)] + [(None, 5000, 0, 0), (30, 5001, None, None)]
    headed = traces.headings(spark.createDataFrame(fixes, "ride long, seq long, x long, y long")).cache()
    rows = [r for r in headed.collect() if r.ride is not None and r.x is not None]
    near = lambda a, b: (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 100 and (a.dx * b.dx + a.dy * b.dy) ** 2 >= 0.75 * (a.dx**2 + a.dy**2) * (b.dx**2 + b.dy**2)
    seen: dict = {}
    for a in rows:
        for b in rows:
            if a.ride < b.ride and near(a, b):
                seen.setdefault((a.ride, b.ride), set()).add(a.seq)
    want = {pair: len(seqs) for pair, seqs in seen.items()}
    for most in (200_000, 0):  # lists of rides are broadcast, or joined
        assert {(r.fid, r.fid2): r.hits for r in joins.hits_along(headed, 10, broadcast=most).collect()} == want
    # the fixes of copies are compared once: 6 shapes and 6 rides of their own, and the one without a place
    compared, real = [], joins._cells
    monkeypatch.setattr(joins, "_cells", lambda df, *more: compared.append(df.select("ride").distinct().count()) or real(df, *more))
    joins.hits_along(headed, 10)
    assert max(compared) <= 13


def test_passes_are_counted_by_class_and_not_carried_to_each_line(spark, monkeypatch):
    rng = random.Random(13)
    at = lambda x, y, back: [(x, y), (x + 300, y)][:: -1 if back else 1]
    shapes = [(i, at(90 * (i % 4), 10 * (i % 7), i % 3 == 0)) for i in range(24)]
    lines = _lines(spark, shapes).cache()
    rides = spark.createDataFrame([(i, r, rng.choice([None, 0, 1, 2]), rng.randrange(3)) for r in range(300) for i in rng.sample(range(25), rng.randrange(1, 4))], "fid long, ride long, fwd int, rev int").cache()
    written, real = [], corridors.cut
    monkeypatch.setattr(corridors, "cut", lambda df: written.append(rows := real(df)) or rows)
    shown, ridden = corridors.merge_corridors(lines, rides)
    got = {r.fid: r.n for r in shown.collect()}
    carried = ridden.cache()
    assert len(got) > 4 and got == {r.fid: r.n for r in corridors.passes(carried, "fid").collect()}
    assert all("ride" not in rows.columns for rows in written)  # before, a row for each line and ride
    # beyond the size of a broadcast, and with rides that come dealt by ride
    monkeypatch.setattr(corridors, "SENT", 0)
    again, same = corridors.merge_corridors(lines, rides.repartition("ride"))
    assert {r.fid: r.n for r in again.collect()} == got
    assert sorted(map(str, same.collect())) == sorted(map(str, carried.collect()))


@pytest.mark.parametrize("most", [(4_000, 400_000), (3, 400_000), (4_000, 30)])
def test_groups_of_rides_meet_without_pairs(spark, monkeypatch, most):
    rng = random.Random(14)
    ways = [[(rng.randrange(5) * 8 - 20, rng.randrange(5) * 8) for _ in range(rng.randrange(1, 9))] for _ in range(20)]
    fixes = [(ride, ride * 100 + i, *at) for ride in range(26) for i, at in enumerate(ways[ride % 20])] + [(40, 5000 + i, 3, 3) for i in range(80)]
    headed = traces.headings(spark.createDataFrame(fixes, "ride long, seq long, x long, y long"))
    headed = headed.union(headed.filter("ride = 3").withColumn("dx", F.col("dy") + 1)).cache()  # fixes of two headings count once
    a, b = headed.alias("a"), headed.alias("b")
    near = F.expr("a.ride < b.ride and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100 and pow(a.dx * b.dx + a.dy * b.dy, 2) >= 0.75D * (a.dx * a.dx + a.dy * a.dy) * (b.dx * b.dx + b.dy * b.dy)")
    want = a.join(b, near).groupBy(F.col("a.ride"), F.col("b.ride")).agg(F.count_distinct("a.seq"))
    written, real = [], joins.cut
    monkeypatch.setattr(joins, "cut", lambda df: written.append(df.columns) or real(df))
    joined = joins.hits_along(headed, 10, most_rides=most[0], most_fixes=most[1])
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, want.collect()))
    assert not any("hits" in columns for columns in written)  # before, the hits of all pairs of rides
