"""Queries of passes, chunks and rankings: events as fixes that are already placed on edges of 500 metres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.operators import conflicts, passes, rankings, traces
from wayfold.plans import roles
from wayfold.plans.catalog import query
from wayfold.plans.roles import table

#: ride, seq, t, edge, along (metres), length; passes are islands of one edge.
PLACED = """placed AS (SELECT user_id AS ride, event_id AS seq, cast(event_id AS double) AS t, (event_id * 7919) % 2000 // 500 + 4 * (user_id % 10) AS edge, cast((event_id * 104729) % 500 AS double) AS along FROM events),
points AS (SELECT *, sum(new) OVER (PARTITION BY ride ORDER BY seq) AS pass FROM (SELECT *, CASE WHEN edge IS DISTINCT FROM lag(edge) OVER (PARTITION BY ride ORDER BY seq) THEN 1 ELSE 0 END AS new FROM placed))"""
SPANS = """spans AS (SELECT *, abs(a1 - a0) AS dist, CASE WHEN a1 > a0 THEN 1 ELSE 0 END AS way, t1 - t0 AS dt FROM (SELECT ride, pass, edge, arg_min(along, seq) AS a0, arg_max(along, seq) AS a1, min(t) AS t0, max(t) AS t1 FROM points GROUP BY ride, pass, edge)),
good AS (SELECT * FROM spans WHERE dt > 0 AND dist > 0 AND 3.6 * dist <= 60 * dt AND dist >= 25)"""
CHUNKS = """steps AS (SELECT *, abs(along - a0) AS step, t - t0 AS dt FROM (SELECT *, lag(along) OVER w AS a0, lag(t) OVER w AS t0 FROM points WINDOW w AS (PARTITION BY ride, pass ORDER BY seq)) WHERE t > t0),
chunks AS (SELECT ride, pass, edge, chunk, way, sum(step) AS dist, sum(sdt) AS time, sum(CASE WHEN 3.6 * step >= 2.4 * sdt THEN sdt ELSE 0 END) AS moving FROM (SELECT s.*, s.dt AS sdt, g.way, greatest(0, least(2, cast(floor((s.along + s.a0) / 2 / 500 * 3) AS int))) AS chunk FROM steps s JOIN good g ON s.ride = g.ride AND s.pass = g.pass WHERE 3.6 * step <= 60 * s.dt) GROUP BY ride, pass, edge, chunk, way),
fold AS (SELECT edge, chunk, way, sum(dist) AS dist, sum(time) AS time, sum(moving) AS moving, count(*) AS n, sum(3.6 * dist / time) AS s1, sum(pow(3.6 * dist / time, 2)) AS s2 FROM chunks GROUP BY edge, chunk, way)"""
BOTH = """both_ways AS (SELECT edge, chunk, 3.6 * sum(dist) FILTER (way = 1) / sum(time) FILTER (way = 1) AS f, 3.6 * sum(dist) FILTER (way = 0) / sum(time) FILTER (way = 0) AS r, coalesce(sum(n) FILTER (way = 1), 0) AS fn, coalesce(sum(n) FILTER (way = 0), 0) AS rn, coalesce(sum(dist) FILTER (way = 1), 0) AS fd, coalesce(sum(dist) FILTER (way = 0), 0) AS rd FROM fold GROUP BY edge, chunk)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + " "


def _points(spark: SparkSession, d: str) -> DataFrame:
    placed = table(spark, d, "events").selectExpr("user_id as ride", "event_id as seq", "cast(event_id as double) as t", "(event_id * 7919) % 2000 div 500 + 4 * (user_id % 10) as edge", "cast((event_id * 104729) % 500 as double) as along", "500D as length")
    new = ~F.col("edge").eqNullSafe(F.lag("edge").over(traces.in_order("ride")))
    return traces.islands(placed.withColumn("new", new), ("ride",), F.col("new"), "pass").drop("new")


def _lines(spark: SparkSession) -> DataFrame:
    return spark.range(40).selectExpr("id as edge", "concat('street ', id % 7) as name", "array(named_struct('x', 0D, 'y', id * 100D), named_struct('x', 500D, 'y', id * 100D)) as points")


def _fold(spark, d) -> DataFrame:
    return passes.fold(passes.pass_chunks(_points(spark, d)))


@query(_with(PLACED, SPANS) + "SELECT ride, pass, edge, way, dist, dt FROM spans")
def q_pass_spans(spark, d):
    return passes.spans(_points(spark, d)).drop("length")


@query(_with(PLACED, SPANS) + "SELECT edge, way, count(*) AS n, sum(dist) AS dist FROM good GROUP BY edge, way")
def q_admitted_passes(spark, d):
    return passes.admitted(passes.spans(_points(spark, d))).groupBy("edge", "way").agg(F.count("*").alias("n"), F.sum("dist").alias("dist"))


@query(_with(PLACED, SPANS) + "SELECT edge, ride, count(*) FILTER (way = 1) AS fwd, count(*) FILTER (way = 0) AS rev FROM good WHERE dist >= 250 GROUP BY edge, ride")
def q_traversals(spark, d):
    return passes.traversals(_points(spark, d).withColumn("crossing", F.col("pass")))


@query(_with(PLACED, SPANS, CHUNKS) + "SELECT ride, pass, edge, chunk, way, dist, time, moving FROM chunks")
def q_pass_chunks(spark, d):
    return passes.pass_chunks(_points(spark, d)).select("ride", "pass", "edge", "chunk", "way", "dist", "time", "moving")


@query(_with(PLACED, SPANS, CHUNKS) + "SELECT edge, chunk, way, dist, time, moving, n, round(s1, 4) AS s1, round(s2, 3) AS s2 FROM fold")
def q_fold_ride(spark, d):
    return _fold(spark, d).withColumn("s1", F.round("s1", 4)).withColumn("s2", F.round("s2", 3))


@query(_with(PLACED, SPANS, CHUNKS) + "SELECT edge, sum(dist) AS metres, sum(time) AS seconds FROM fold GROUP BY edge")
def q_edge_measured(spark, d):
    return passes.edge_measured(_fold(spark, d))


@query(_with(PLACED, SPANS, CHUNKS, BOTH) + "SELECT count(*) AS n FROM both_ways WHERE fd >= 50 AND rd >= 50")
def q_measured_chunks(spark, d):
    return passes.measured_chunks(_fold(spark, d))


@query(_with(PLACED, SPANS, CHUNKS) + "SELECT edge, chunk, way, round(3.6 * dist / time, 4) AS kmh, round(s1 / n, 4) AS mean, round(sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0)), 3) AS sd FROM fold WHERE dist >= 50")
def q_chunk_speeds(spark, d):
    mean, sd = passes.spread()
    speeds = _fold(spark, d).select("edge", "chunk", "way", F.round(passes.speed_kmh(), 4).alias("kmh"), F.round(mean, 4).alias("mean"), F.round(sd, 3).alias("sd"))
    return speeds.filter("kmh is not null")


@query(_with(PLACED, SPANS, CHUNKS, BOTH, """good_chunks AS (SELECT *, f >= r AS ahead FROM both_ways WHERE fd >= 50 AND rd >= 50 AND least(fn, rn) >= 3),
marked AS (SELECT *, sum(new) OVER (PARTITION BY edge ORDER BY chunk) AS run FROM (SELECT *, CASE WHEN lag(chunk) OVER w = chunk - 1 AND lag(ahead) OVER w = ahead THEN 0 ELSE 1 END AS new FROM good_chunks WINDOW w AS (PARTITION BY edge ORDER BY chunk))),
runs AS (SELECT edge, run, 'street ' || edge % 7 AS name, CASE WHEN bool_and(ahead) THEN 'E' ELSE 'W' END AS dir, min(chunk) AS first, count(*) AS k, avg(abs(f - r)) AS gap, min(least(fn, rn)) AS n FROM marked GROUP BY edge, run HAVING count(*) >= 2),
best AS (SELECT *, row_number() OVER (PARTITION BY name, dir ORDER BY round(gap, 1) DESC, edge, first) AS rank FROM runs)""")
    + "SELECT name, dir, round(gap, 1) AS gap, cast(round(k * 500.0 / 3) AS bigint) AS m, cast(n AS bigint) AS n FROM best WHERE rank = 1 ORDER BY round(gap, 1) DESC, name, dir LIMIT 10")
def q_top_corridors(spark, d):
    return rankings.top_corridors(_fold(spark, d), _lines(spark)).select("name", "dir", "gap", "m", "n")


STRETCH = """stretch AS (SELECT edge, way, 'street ' || edge % 7 AS name, CASE WHEN way = 1 THEN 'E' ELSE 'W' END AS dir, avg(s1 / n) AS kmh, avg(sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0))) AS sd, count(*) AS k, min(n) AS n, min(chunk) AS first FROM (SELECT *, chunk - row_number() OVER (PARTITION BY edge, way ORDER BY chunk) AS island FROM fold WHERE n >= 5 AND dist >= 50) GROUP BY edge, way, island HAVING count(*) >= 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY name, dir ORDER BY round(kmh, 1) {0}, round(sd, 1), edge) AS rank FROM stretch)"""


@query(_with(PLACED, SPANS, CHUNKS, STRETCH.format("DESC")) + "SELECT name, dir, round(kmh, 1) AS kmh, round(sd, 1) AS sd, cast(round(k * 500.0 / 3) AS bigint) AS m, n FROM ranked WHERE rank = 1 ORDER BY round(kmh, 1) DESC, round(sd, 1), name LIMIT 8")
def q_fastest_stretches(spark, d):
    return rankings.top_stretches(_stretches(spark, d), True).select("name", "dir", "kmh", "sd", "m", "n")


@query(_with(PLACED, SPANS, CHUNKS, STRETCH.format("ASC")) + "SELECT name, dir, round(kmh, 1) AS kmh, round(sd, 1) AS sd, cast(round(k * 500.0 / 3) AS bigint) AS m, n FROM ranked WHERE rank = 1 ORDER BY round(kmh, 1), round(sd, 1), name LIMIT 8")
def q_slowest_stretches(spark, d):
    return rankings.top_stretches(_stretches(spark, d), False).select("name", "dir", "kmh", "sd", "m", "n")


def _stretches(spark, d) -> DataFrame:
    # names are laid out so that a street's edges don't meet; a unit's edge pads to sort by number
    folded, lines = _fold(spark, d), _lines(spark)
    padded = F.lpad(F.col("edge").cast("string"), 3, "0")
    return rankings.stretches(folded.withColumn("edge", padded), lines.withColumn("edge", padded))


@query(_with(PLACED, SPANS, CHUNKS) + "SELECT stretch, count(*) AS n, round(avg(kmh), 4) AS mean, round(stddev_pop(kmh), 3) AS sd FROM (SELECT edge * 2 + way AS stretch, ride, 3.6 * sum(dist) / sum(time) AS kmh FROM chunks GROUP BY edge, way, ride HAVING sum(dist) >= 250) GROUP BY stretch")
def q_ride_paces(spark, d):
    of = spark.range(40).selectExpr("id as edge", "explode(array(0, 1)) as way").selectExpr("edge", "way", "edge * 2 + way as stretch", "explode(array(0, 1, 2)) as chunk", "500D / 3 as metres")
    paces = rankings.ride_paces(passes.pass_chunks(_points(spark, d)), of)
    return paces.select("stretch", "n", F.round("mean", 4).alias("mean"), F.round("sd", 3).alias("sd"))


@query(_with(PLACED, SPANS, CHUNKS) + "SELECT a.edge, a.chunk, a.way FROM fold a WHERE NOT EXISTS (SELECT 1 FROM fold b WHERE b.edge = a.edge AND b.chunk = a.chunk AND b.way = 1 - a.way)")
def q_one_way_units(spark, d):
    return rankings.one_way(_fold(spark, d).select("edge", "chunk", "way"))


@query("SELECT l_partkey AS edge, least(5, greatest(1, cast(round_even(l_partkey / 150.0, 0) AS int))) AS n FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey < 800)")
def q_chunk_counts(spark, d):
    lengths = table(spark, d, "lineitem").filter("l_partkey < 800").select(F.col("l_partkey").alias("edge")).distinct()
    return lengths.select("edge", F.least(F.lit(5), passes.chunks_of(F.col("edge").cast("double"))).alias("n"))


@query("SELECT p_partkey AS edge, cast(k AS int) AS chunk, round(p_size * 10.0 / 3 * k, 3) AS x0, round(p_size * 10.0 / 3 * (k + 1), 3) AS x1 FROM part, (SELECT unnest(range(0, 3)) AS k)")
def q_chunk_slices(spark, d):
    lines = table(spark, d, "part").selectExpr("p_partkey as edge", "array(named_struct('x', 0D, 'y', 0D), named_struct('x', p_size * 10D, 'y', 0D)) as points")
    ends = passes.slices(lines, F.lit(3))
    return ends.select("edge", "chunk", F.round(F.element_at("piece", 1)["x"], 3).alias("x0"), F.round(F.element_at("piece", -1)["x"], 3).alias("x1"))


@query("WITH f AS (SELECT p_partkey AS edge, p_size % 3 AS chunk, p_partkey % 2 AS way, p_size AS b FROM part) SELECT edge, CASE WHEN b * 7 % 360 > 90 AND b * 7 % 360 < 270 THEN 2 - chunk ELSE chunk END AS chunk, CASE WHEN b * 7 % 360 > 90 AND b * 7 % 360 < 270 THEN 1 - way ELSE way END AS way FROM f")
def q_oriented_chunks(spark, d):
    folded = table(spark, d, "part").selectExpr("p_partkey as edge", "p_size % 3 as chunk", "cast(p_partkey % 2 as bigint) as way", "double(p_size * 7 % 360) as b")
    lines = table(spark, d, "part").selectExpr("p_partkey as edge", "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 450D, 'y', 0D)) as points")
    return passes.oriented(folded, lines).select("edge", "chunk", "way")


@query("SELECT edge, cast(count(*) AS bigint) AS n, max(along) AS length FROM (SELECT p_partkey AS edge, least(k * 5, p_size * 3 + 1) AS along FROM (SELECT p_partkey, p_size, unnest(range(0, (p_size * 3 + 1 + 4) // 5 + 1)) AS k FROM part)) GROUP BY edge")
def q_densified(spark, d):
    lines = table(spark, d, "part").selectExpr("p_partkey as edge", "array(named_struct('x', 0D, 'y', 0D), named_struct('x', p_size * 3D + 1, 'y', 0D)) as points")
    return passes.densify(lines).groupBy("edge").agg(F.count("*").alias("n"), F.max("along").cast("bigint").alias("length"))


@query()
def q_measured_rides(spark, d):
    """Passes of rides on a grid of streets: users ride up and down, with noise, along the street of their number."""
    streets = spark.range(21).selectExpr("id as edge", "array(named_struct('x', 0D, 'y', id * 100D), named_struct('x', 2000D, 'y', id * 100D)) as points")
    way = "abs(pmod(rank * 37, 4000) - 2000)"
    w = Window.partitionBy("user_id").orderBy("event_id")
    fixes = table(spark, d, "events").select(F.col("user_id").alias("ride"), F.col("event_id").alias("seq"), F.row_number().over(w).alias("rank")).selectExpr("ride", "seq", f"double({way}) as x", "(ride % 21) * 100D + seq % 7 - 3 as y", "rank * 10D as t")
    own = fixes.select("ride", F.expr("ride % 21 as edge")).distinct()
    return passes.traversals(passes.measure_rides(fixes, streets, own))


@query()
def q_chain_units(spark, d):
    e = roles.edges(spark, d).selectExpr("edge as unit", "brand as name", "chunk as a", "(chunk + edge % 3) % 50 as b", "double(edge % 360) as bearing")
    return rankings.chain_units(e)


@query()
def q_od_clusters(spark, d):
    return conflicts.density_clusters(roles.fixes(spark, d).selectExpr("seq as id", "ride % 8 as region", "x", "y"), 100, "region")


@query()
def q_stations(spark, d):
    ends = roles.fixes(spark, d).selectExpr("seq as id", "ride % 8 as region", "x", "y")
    found = conflicts.density_clusters(ends, 100, "region").join(ends, "id")
    clusters = found.groupBy("region", F.col("cluster").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    return conflicts.pick_stations(clusters, region="region").select("region", "id", "n", F.size("absorbed").alias("absorbed"))


SWEEP = ", ".join(
    f"stretch{n} AS (SELECT edge, 'street ' || edge % 7 AS name, CASE WHEN way = 1 THEN 'E' ELSE 'W' END AS dir, avg(s1 / n) AS kmh, avg(sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0))) AS sd FROM (SELECT *, chunk - row_number() OVER (PARTITION BY edge, way ORDER BY chunk) AS island FROM fold WHERE n >= {n} AND dist >= 50) GROUP BY edge, way, island HAVING count(*) >= 2), "
    f"top{n} AS (SELECT name, dir FROM (SELECT *, row_number() OVER (PARTITION BY name, dir ORDER BY round(kmh, 1) DESC, round(sd, 1), edge) AS rank FROM stretch{n}) WHERE rank = 1 ORDER BY round(kmh, 1) DESC, round(sd, 1), name LIMIT 8)"
    for n in (3, 5, 8)
)


@query(_with(PLACED, SPANS, CHUNKS, SWEEP) + " UNION ALL ".join(f"SELECT {n} AS floor, (SELECT count(*) FROM stretch{n}) AS stretches, (SELECT count(*) FROM (SELECT * FROM top{n} INTERSECT SELECT * FROM top5)) AS shared" for n in (3, 5, 8)))
def q_floor_sweep(spark, d):
    return rankings.floor_sweep(_fold(spark, d), _lines(spark), (3, 5, 8))
