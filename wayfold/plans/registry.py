"""All queries of the engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geo, text
from wayfold.operators import corridors, graph, joins, matching, tables, traces
from wayfold.plans import roles
from wayfold.plans.catalog import oracle_sql, queries, query  # noqa: F401
from wayfold.plans.roles import sql, table
from wayfold.sources import writers

@query(sql("SELECT ride, n, start, duration, round(distance, 3) AS distance FROM (SELECT ride, count(*) AS n, min(t) AS start, arg_max(t, seq) - arg_min(t, seq) AS duration, sum(d) AS distance FROM (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM fixes WINDOW w AS (PARTITION BY ride ORDER BY seq)) GROUP BY ride) WHERE n >= 2", "fixes"))
def q_ride_stats(spark: SparkSession, d: str) -> DataFrame:
    return traces.ride_stats(roles.fixes(spark, d)).withColumn("distance", F.round("distance", 3))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_ride_stats(spark, sf_dir)


@query(sql("SELECT ride, segment, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM (SELECT *, sum(CASE WHEN t - p > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY ride ORDER BY seq) AS segment FROM (SELECT *, lag(t) OVER (PARTITION BY ride ORDER BY seq) AS p FROM fixes)) GROUP BY ride, segment", "fixes"))
def q_gap_segments(spark, d):
    cut = traces.split_at_gaps(roles.fixes(spark, d), most_m=None, most_s=21600)
    return cut.groupBy("ride", "segment").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(sql("""SELECT ride, cast(k AS bigint) AS k, round(x + (k * 500 - d0) / (d1 - d0) * (x1 - x), 2) AS x, round(y + (k * 500 - d0) / (d1 - d0) * (y1 - y), 2) AS y
FROM (SELECT *, unnest(range(cast(ceil(d0 / 500) AS bigint), cast(ceil(d1 / 500) AS bigint))) AS k FROM c WHERE d1 > d0)""", "fixes", also="""s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM fixes WINDOW w AS (PARTITION BY ride ORDER BY seq)),
c0 AS (SELECT *, sum(d) OVER (PARTITION BY ride ORDER BY seq ROWS UNBOUNDED PRECEDING) AS d0 FROM s),
c AS (SELECT *, lead(d0) OVER w AS d1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM c0 WINDOW w AS (PARTITION BY ride ORDER BY seq))"""))
def q_resample(spark, d):
    return traces.resample(roles.fixes(spark, d), 500).select("ride", "k", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query(sql("SELECT ride, count(*) AS n FROM fixes WHERE ride IN (SELECT ride FROM fixes WHERE x BETWEEN 0 AND 40 AND y BETWEEN 0 AND 400) GROUP BY ride", "fixes"))
def q_ride_any_bbox(spark, d):
    return traces.any_inside(roles.fixes(spark, d), F.col("x").between(0, 40) & F.col("y").between(0, 400)).groupBy("ride").agg(F.count("*").alias("n"))


@query(sql("""SELECT ride, count(*) AS n_out, min(seq) AS first, max(seq) AS last, max(coalesce(cast(was AS int), 0)) AS padded_before, max(coalesce(cast(will AS int), 0)) AS padded_after
FROM (SELECT *, sum(CASE WHEN NOT inside AND coalesce(was, true) THEN 1 ELSE 0 END) OVER (PARTITION BY ride ORDER BY seq) AS run FROM m) WHERE NOT inside GROUP BY ride, run""", "fixes", also="m AS (SELECT *, lag(inside) OVER (PARTITION BY ride ORDER BY seq) AS was, lead(inside) OVER (PARTITION BY ride ORDER BY seq) AS will FROM (SELECT *, x < 1500 AND y < 1500 AS inside FROM fixes))"))
def q_outside_runs(spark, d):
    return traces.outside_runs(roles.fixes(spark, d), (F.col("x") < 1500) & (F.col("y") < 1500)).drop("run")


@query(sql("SELECT ride, slot, count(*) AS n, min(seq) AS first, max(seq) AS last FROM (SELECT *, sum(CASE WHEN p IS NULL OR p <> slot OR dt <= 0 OR dt > 100000 THEN 1 ELSE 0 END) OVER (PARTITION BY ride ORDER BY seq) AS run FROM (SELECT *, lag(slot) OVER w AS p, t - lag(t) OVER w AS dt FROM (SELECT *, CASE WHEN kind = 'view' THEN -1 ELSE x // 1000 END AS slot FROM fixes) WINDOW w AS (PARTITION BY ride ORDER BY seq))) WHERE slot <> -1 GROUP BY ride, run, slot HAVING count(*) >= 2", "fixes"))
def q_edge_runs(spark, d):
    placed = roles.fixes(spark, d).withColumn("slot", F.expr("if(kind = 'view', -1, x div 1000)"))
    return traces.edge_runs(placed, 100_000, 1e9).drop("run")


@query(sql("SELECT ride, seq, cents FROM (SELECT *, max(cents) OVER (PARTITION BY ride ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS peak FROM fixes) WHERE cents > 0 AND cents >= peak", "fixes"))
def q_local_maxima(spark, d):
    return traces.local_maxima(roles.fixes(spark, d), "ride", "cents").select("ride", "seq", "cents")


@query(sql("SELECT ride, seq, dx, dy, dx * dx + dy * dy > 25 AS moved FROM (SELECT ride, seq, last_value(x) OVER w - first_value(x) OVER w AS dx, last_value(y) OVER w - first_value(y) OVER w AS dy FROM fixes WINDOW w AS (PARTITION BY ride ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))", "fixes"))
def q_headings(spark, d):
    return traces.headings(roles.fixes(spark, d)).select("ride", "seq", "dx", "dy", "moved")


@query(sql("SELECT g.kind, cast(g.k AS int) AS k, coalesce(n, 0) AS n FROM (SELECT 'hour' AS kind, unnest(range(0, 24)) AS k UNION ALL SELECT 'weekday', unnest(range(0, 7))) g LEFT JOIN (SELECT 'hour' AS kind, (t // 3600) % 24 AS k, count(*) AS n FROM fixes GROUP BY 1, 2 UNION ALL SELECT 'weekday', isodow(day) - 1, count(*) FROM fixes GROUP BY 1, 2) c ON g.kind = c.kind AND g.k = c.k", "fixes"))
def q_hour_weekday_hist(spark, d):
    f = roles.fixes(spark, d)
    hours = tables.dense(f.groupBy(F.expr("int(t div 3600 % 24)").alias("k")).agg(F.count("*").alias("n")), "k", 0, 23, ["n"]).withColumn("kind", F.lit("hour"))
    days = tables.dense(f.groupBy(F.weekday("day").alias("k")).agg(F.count("*").alias("n")), "k", 0, 6, ["n"]).withColumn("kind", F.lit("weekday"))
    return hours.unionByName(days)


@query("SELECT o_orderkey AS ride FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def q_new_files_anti(spark, d):
    from wayfold.operators.state import pending

    done = table(spark, d, "lineitem").filter("l_quantity > 40").selectExpr("l_orderkey as ride")
    return pending(table(spark, d, "orders").selectExpr("o_orderkey as ride"), done)


@query(sql("SELECT ride, seq, kind, dup FROM (SELECT *, row_number() OVER (PARTITION BY ride, kind ORDER BY seq) AS k, count(*) OVER (PARTITION BY ride, kind) - 1 AS dup FROM fixes) WHERE k = 1", "fixes"))
def q_dedupe_first(spark, d):
    f = roles.fixes(spark, d)
    first = tables.first_wins(f.select(F.struct("ride", "kind").alias("key"), "seq"), "key", "seq")
    copies = f.groupBy("ride", "kind").agg((F.count("*") - 1).alias("dup"))
    return first.select("key.ride", "key.kind", "seq").join(copies, ["ride", "kind"])


@query("SELECT coalesce(n.key, o.key) AS key, coalesce(n.v, o.v) AS v, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'kept' ELSE 'replaced' END AS state FROM (SELECT c_custkey AS key, c_name AS v FROM customer) o FULL JOIN (SELECT s_suppkey * 29 AS key, s_name AS v FROM supplier) n ON o.key = n.key")
def q_upsert_merge(spark, d):
    old = table(spark, d, "customer").selectExpr("c_custkey as key", "c_name as v")
    return tables.upsert(old, table(spark, d, "supplier").selectExpr("s_suppkey * 29 as key", "s_name as v"), "key", ["v"])


@query(sql("SELECT a.trip, count(*) AS n FROM trips a JOIN trips b ON a.trip <> b.trip AND least(a.e, b.e) - greatest(a.s, b.s) >= 60 GROUP BY a.trip", "trips"))
def q_overlap_count(spark, d):
    t = roles.trips(spark, d).select("trip", "s", "e")
    return joins.count_overlaps(t, t, 60, 3600, "trip").filter("n > 0")


@query(sql("SELECT a.trip, m.match, m.overlap FROM trips a LEFT JOIN (SELECT * FROM (SELECT a.trip, b.trip AS match, least(a.e, b.e) - greatest(a.s, b.s) AS overlap, row_number() OVER (PARTITION BY a.trip ORDER BY least(a.e, b.e) - greatest(a.s, b.s) DESC, b.trip) AS k FROM trips a JOIN trips b ON a.trip <> b.trip AND least(a.e, b.e) - greatest(a.s, b.s) >= 60) WHERE k = 1) m ON a.trip = m.trip", "trips"))
def q_overlap_longest(spark, d):
    t = roles.trips(spark, d).select("trip", "s", "e")
    return joins.longest_overlap_of_others(t, 60, 3600, "trip")


RESUME = "re AS (SELECT *, coalesce(pd = dock AND s - pe BETWEEN 0 AND {h} * 3600, false) AS resume FROM (SELECT *, lag(e) OVER w AS pe, lag(dock) OVER w AS pd FROM trips WINDOW w AS (PARTITION BY bike ORDER BY s, trip)))"


def _resumed(spark, d, hours: int) -> DataFrame:
    w = Window.partitionBy("bike").orderBy("s", "trip")
    t = roles.trips(spark, d).withColumn("pe", F.lag("e").over(w)).withColumn("pd", F.lag("dock").over(w))
    return t.withColumn("resume", F.coalesce((F.col("pd") == F.col("dock")) & (F.col("s") - F.col("pe")).between(0, hours * 3600), F.lit(False)))


@query(sql("SELECT bike, count(*) FILTER (NOT resume) AS encounters, count(*) FILTER (resume) AS resumes FROM re GROUP BY bike HAVING count(*) FILTER (NOT resume) > 1", "trips", also=RESUME.format(h=48)))
def q_resume_encounters(spark, d):
    return _resumed(spark, d, 48).groupBy("bike").agg(F.count_if(~F.col("resume")).alias("encounters"), F.count_if("resume").alias("resumes")).filter("encounters > 1")


@query(sql("SELECT bike, trip, occasion, lead(s) OVER (PARTITION BY bike ORDER BY s, trip) - s AS gap FROM (SELECT *, sum(CASE WHEN resume THEN 0 ELSE 1 END) OVER (PARTITION BY bike ORDER BY s, trip) AS occasion FROM re)", "trips", also=RESUME.format(h=48)))
def q_occasion_gaps(spark, d):
    w = Window.partitionBy("bike").orderBy("s", "trip")
    return _resumed(spark, d, 48).select("bike", "trip", F.sum(F.when(F.col("resume"), 0).otherwise(1)).over(w).alias("occasion"), (F.lead("s").over(w) - F.col("s")).alias("gap"))


@query(sql("SELECT h AS hours, count(*) FILTER (pd = dock AND s - pe BETWEEN 0 AND h * 3600) AS resumes FROM (SELECT *, lag(e) OVER w AS pe, lag(dock) OVER w AS pd FROM trips WINDOW w AS (PARTITION BY bike ORDER BY s, trip)), (SELECT unnest([6, 12, 24, 48, 96]) AS h) GROUP BY h", "trips"))
def q_resume_sensitivity(spark, d):
    t = _resumed(spark, d, 48).withColumn("hours", F.explode(F.array(*map(F.lit, (6, 12, 24, 48, 96)))))
    return t.groupBy("hours").agg(F.count_if((F.col("pd") == F.col("dock")) & (F.col("s") - F.col("pe")).between(0, F.col("hours") * 3600)).alias("resumes"))


@query(sql("SELECT dock, sum(o) AS n_out, sum(i) AS n_in FROM (SELECT dock, 1 AS o, 0 AS i FROM trips UNION ALL SELECT nd, 0, 1 FROM (SELECT lead(dock) OVER (PARTITION BY bike ORDER BY s, trip) AS nd FROM trips) WHERE nd IS NOT NULL) GROUP BY dock", "trips"))
def q_dock_out_in(spark, d):
    t = roles.trips(spark, d)
    to = t.select(F.lead("dock").over(Window.partitionBy("bike").orderBy("s", "trip")).alias("dock")).filter("dock is not null")
    both = t.selectExpr("dock", "1 as o", "0 as i").union(to.selectExpr("dock", "0 as o", "1 as i"))
    return both.groupBy("dock").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


@query(sql("SELECT least(dock, nd) AS a, greatest(dock, nd) AS b, count(*) AS n, count(*) FILTER (dock < nd) AS n_forward FROM (SELECT dock, lead(dock) OVER (PARTITION BY bike ORDER BY s, trip) AS nd FROM trips) WHERE nd <> dock GROUP BY 1, 2", "trips"))
def q_pair_counts(spark, d):
    t = roles.trips(spark, d).withColumn("nd", F.lead("dock").over(Window.partitionBy("bike").orderBy("s", "trip"))).filter("nd <> dock")
    return t.groupBy(F.least("dock", "nd").alias("a"), F.greatest("dock", "nd").alias("b")).agg(F.count("*").alias("n"), F.count_if(F.col("dock") < F.col("nd")).alias("n_forward"))


@query("SELECT cast(year(o_orderdate) AS int) AS year, count(*) FILTER (o_orderpriority LIKE '%-%') AS dashed, count(*) FILTER (o_orderpriority NOT LIKE '%-%') AS plain FROM orders GROUP BY 1")
def q_generation_by_year(spark, d):
    dashed = F.col("o_orderpriority").contains("-")
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count_if(dashed).alias("dashed"), F.count_if(~dashed).alias("plain"))


DAYS = "days AS (SELECT day, sum(cents) AS cents, max(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) AS rode, min(cents) % 100 AS temp FROM fixes GROUP BY day)"


@query(sql("SELECT band, count(*) AS days, sum(rode) AS ride_days, sum(cents) AS cents, round(100.0 * sum(rode) / sum(sum(rode)) OVER (), 1) AS share, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS expected FROM (SELECT *, CASE WHEN temp >= 0 AND temp < 25 THEN 0 WHEN temp >= 25 AND temp < 50 THEN 1 WHEN temp >= 50 AND temp < 75 THEN 2 ELSE 3 END AS band FROM days) GROUP BY band", "fixes", also=DAYS))
def q_band_share_expected(spark, d):
    days = roles.fixes(spark, d).groupBy("day").agg(F.sum("cents").alias("cents"), F.max(F.expr("if(kind = 'purchase', 1, 0)")).alias("rode"), (F.min("cents") % 100).alias("temp"))
    bands = days.groupBy(text.band("temp", [0, 25, 50, 75, 101]).alias("band")).agg(F.count("*").alias("days"), F.sum("rode").alias("ride_days"), F.sum("cents").alias("cents"))
    everything = Window.partitionBy()  # one row a band
    share = lambda c: F.round(F.lit(100.0) * F.col(c) / F.sum(c).over(everything), 1)
    return bands.select("*", share("ride_days").alias("share"), share("days").alias("expected"))


RIDDEN = "rid AS (SELECT edge, min(day) AS first_day FROM er WHERE passes >= 45 GROUP BY edge)"


@query(sql("SELECT sum(metres) AS network, sum(CASE WHEN first_day IS NOT NULL THEN metres ELSE 0 END) AS ridden, round(100.0 * sum(CASE WHEN first_day IS NOT NULL THEN metres ELSE 0 END) / sum(metres), 1) AS pct FROM edges LEFT JOIN rid USING (edge) WHERE tag NOT LIKE 'LARGE%'", "er", "edges", also=RIDDEN))
def q_coverage_conditional(spark, d):
    every = _coverage(spark, d).filter("tag not like 'LARGE%'")
    ridden = F.sum(F.when(F.col("first_day").isNotNull(), F.col("metres")).otherwise(0))
    return every.agg(F.sum("metres").alias("network"), ridden.alias("ridden"), F.round(F.lit(100.0) * ridden / F.sum("metres"), 1).alias("pct"))


def _coverage(spark, d) -> DataFrame:
    first = roles.edge_rides(spark, d).filter("passes >= 45").groupBy("edge").agg(F.min("day").alias("first_day"))
    return roles.edges(spark, d).join(first, "edge", "left")


@query(sql("SELECT tag, sum(metres) AS metres FROM edges JOIN rid USING (edge) WHERE tag LIKE 'LARGE%' GROUP BY tag", "er", "edges", also=RIDDEN))
def q_excluded_by_tag(spark, d):
    return _coverage(spark, d).filter("first_day is not null and tag like 'LARGE%'").groupBy("tag").agg(F.sum("metres").alias("metres"))


@query(sql("SELECT cast(year(first_day) AS int) AS year, sum(metres) AS metres, sum(sum(metres)) OVER (ORDER BY year(first_day)) AS running FROM edges JOIN rid USING (edge) GROUP BY year(first_day)", "er", "edges", also=RIDDEN))
def q_new_by_year(spark, d):
    by_year = _coverage(spark, d).filter("first_day is not null").groupBy(F.year("first_day").alias("year")).agg(F.sum("metres").alias("metres"))
    return by_year.withColumn("running", F.sum("metres").over(Window.orderBy("year")))


@query(sql("SELECT edge, count(DISTINCT ride) AS n FROM er GROUP BY edge", "er"))
def q_edge_counts(spark, d):
    return roles.edge_rides(spark, d).select("edge", "ride").distinct().groupBy("edge").agg(F.count("*").alias("n"))


@query(sql("SELECT edge, sum(greatest(1, f + r)) AS passes FROM (SELECT edge, ride, sum(CASE WHEN dir = 1 AND passes > 25 THEN 1 ELSE 0 END) AS f, sum(CASE WHEN dir = 0 AND passes > 25 THEN 1 ELSE 0 END) AS r FROM er GROUP BY edge, ride) GROUP BY edge", "er"))
def q_floor_passes(spark, d):
    fast = lambda way: F.count_if((F.col("dir") == way) & (F.col("passes") > 25))
    by_ride = roles.edge_rides(spark, d).groupBy("edge", "ride").agg(fast(1).alias("f"), fast(0).alias("r"))
    return by_ride.groupBy("edge").agg(F.sum(F.greatest(F.lit(1), F.col("f") + F.col("r"))).alias("passes"))


@query(sql("SELECT street, sum(greatest(1, f + r)) AS passes FROM (SELECT street, ride, max(f) AS f, max(r) AS r FROM (SELECT edge, street, ride, sum(dir) AS f, sum(1 - dir) AS r FROM er JOIN edges USING (edge) GROUP BY edge, street, ride) GROUP BY street, ride) GROUP BY street", "er", "edges"))
def q_dir_max_sum(spark, d):
    e = roles.edge_rides(spark, d).join(roles.edges(spark, d).select("edge", "street"), "edge")
    by_edge = e.groupBy("edge", "street", "ride").agg(F.sum("dir").alias("f"), F.sum(1 - F.col("dir")).alias("r"))
    by_ride = by_edge.groupBy("street", "ride").agg(F.max("f").alias("f"), F.max("r").alias("r"))
    return by_ride.groupBy("street").agg(F.sum(F.greatest(F.lit(1), F.col("f") + F.col("r"))).alias("passes"))


@query(sql("SELECT edge, dir, n, round(s1 / n, 4) AS mean, round(sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0)), 4) AS spread FROM (SELECT edge, dir, count(*) AS n, cast(sum(passes) AS double) AS s1, cast(sum(passes * passes) AS double) AS s2 FROM er GROUP BY edge, dir)", "er"))
def q_chunk_speed_spread(spark, d):
    sums = roles.edge_rides(spark, d).groupBy("edge", "dir").agg(F.count("*").alias("n"), F.sum("passes").cast("double").alias("s1"), F.sum(F.col("passes") * F.col("passes")).cast("double").alias("s2"))
    mean = F.col("s1") / F.col("n")
    return sums.select("edge", "dir", "n", F.round(mean, 4).alias("mean"), F.round(F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))), 4).alias("spread"))


@query(sql("SELECT edge, sign, min(line) AS first, count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS DISTINCT FROM sign THEN 1 ELSE 0 END) OVER (PARTITION BY edge ORDER BY day, ride, line) AS run FROM (SELECT *, dir AS sign, lag(dir) OVER (PARTITION BY edge ORDER BY day, ride, line) AS p FROM er)) GROUP BY edge, sign, run", "er"))
def q_runs_one_sign(spark, d):
    w = Window.partitionBy("edge").orderBy("day", "ride", "line")
    rows = roles.edge_rides(spark, d).withColumn("sign", F.col("dir")).withColumn("p", F.lag("dir").over(w))
    runs = traces.islands(rows, ("edge",), ~F.col("p").eqNullSafe(F.col("sign")), "run", by=("day", "ride", "line"))
    return runs.groupBy("edge", "sign", "run").agg(F.min("line").alias("first"), F.count("*").alias("n")).drop("run")


@query(sql("SELECT street, dir, edge, n FROM (SELECT *, row_number() OVER (PARTITION BY street, dir ORDER BY n DESC, edge) AS k FROM (SELECT street, dir, edge, sum(passes) AS n FROM er JOIN edges USING (edge) GROUP BY street, dir, edge)) WHERE k = 1", "er", "edges"))
def q_top_per_group(spark, d):
    n = roles.edge_rides(spark, d).join(roles.edges(spark, d).select("edge", "street"), "edge").groupBy("street", "dir", "edge").agg(F.sum("passes").alias("n"))
    return tables.top_per_group(n, ["street", "dir"], F.desc("n"), F.col("edge")).drop("rank")


@query(sql("SELECT edge, street, n, metres FROM (SELECT edge, sum(passes) AS n FROM er GROUP BY edge) JOIN edges USING (edge) ORDER BY n DESC, metres DESC, edge LIMIT 8", "er", "edges"))
def q_busiest_topk(spark, d):
    n = roles.edge_rides(spark, d).groupBy("edge").agg(F.sum("passes").alias("n"))
    return n.join(roles.edges(spark, d), "edge").orderBy(F.desc("n"), F.desc("metres"), "edge").limit(8).select("edge", "street", "n", "metres")


AREAS = "SELECT {0} count(*) AS n, sum(cast(round(c_acctbal * 100) AS bigint)) AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey {1}"


def _areas(spark, d) -> DataFrame:
    small = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(small, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("r_name", "n_name", "cast(round(c_acctbal * 100) as bigint) as c")


@query(AREAS.format("r_name AS boro, n_name AS area,", "GROUP BY r_name, n_name"))
def q_area_rollup(spark, d):
    return _areas(spark, d).groupBy(F.col("r_name").alias("boro"), F.col("n_name").alias("area")).agg(F.count("*").alias("n"), F.sum("c").alias("cents"))


@query(AREAS.format("r_name AS boro, n_name AS area,", "GROUP BY ROLLUP (r_name, n_name)"))
def q_boro_rollup(spark, d):
    return _areas(spark, d).rollup(F.col("r_name").alias("boro"), F.col("n_name").alias("area")).agg(F.count("*").alias("n"), F.sum("c").alias("cents"))


@query("SELECT rank, nation, n, round(100.0 * sum(n) OVER (ORDER BY rank) / sum(n) OVER (), 2) AS running FROM (SELECT n_name AS nation, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, n_name) AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)")
def q_concentration_topn(spark, d):
    n = _areas(spark, d).groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("n"))
    ranked = n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "nation")))
    running = F.lit(100.0) * F.sum("n").over(Window.orderBy("rank")) / F.sum("n").over(Window.partitionBy())
    return ranked.select("rank", "nation", "n", F.round(running, 2).alias("running"))


@query("SELECT round(corr(a, b), 6) AS rho FROM (SELECT row_number() OVER (ORDER BY n, n_name) AS a, row_number() OVER (ORDER BY s, n_name) AS b FROM (SELECT n_name, count(*) AS n, sum(cast(round(c_acctbal * 100) AS bigint)) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name))")
def q_spearman_ordinal(spark, d):
    n = _areas(spark, d).groupBy("n_name").agg(F.count("*").alias("n"), F.sum("c").alias("s"))
    ranks = n.select(F.row_number().over(Window.orderBy("n", "n_name")).alias("a"), F.row_number().over(Window.orderBy("s", "n_name")).alias("b"))
    return ranks.agg(F.round(F.corr("a", "b"), 6).alias("rho"))


VERSIONS = "v AS (SELECT o_custkey AS key, o_orderkey AS version, cast(o_orderdate AS date) AS inst, lead(cast(o_orderdate AS date)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ret FROM orders), fact AS (SELECT l_orderkey AS f, l_linenumber AS line, o_custkey AS key, cast(l_shipdate AS date) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").selectExpr("o_custkey as key", "o_orderkey as version", "to_date(o_orderdate) as inst", "o_orderdate as at")
    v = o.withColumn("ret", F.lead("inst").over(Window.partitionBy("key").orderBy("at", "version"))).drop("at")
    fact = table(spark, d, "lineitem").join(o.select("key", "version"), F.col("l_orderkey") == F.col("version")).selectExpr("l_orderkey as f", "l_linenumber as line", "key", "to_date(l_shipdate) as day")
    return v, fact


@query(f"WITH {VERSIONS} SELECT f, line, version FROM fact JOIN v USING (key) WHERE inst <= day AND (ret IS NULL OR ret > day)")
def q_validity_join(spark, d):
    v, fact = _versions(spark, d)
    return joins.valid_at(fact, v, "key", "day").select("f", "line", "version")


@query(f"WITH {VERSIONS} SELECT version, min(CASE WHEN day >= inst AND (ret IS NULL OR day < ret) THEN day END) AS first_day FROM v LEFT JOIN fact USING (key) GROUP BY version")
def q_first_in_lifetime(spark, d):
    v, fact = _versions(spark, d)
    return joins.first_within(v, fact, "key", "day").select("version", "first_day")


@query(f"WITH {VERSIONS} SELECT cast(year(day) AS int) AS year, sum(m) AS metres, sum(CASE WHEN share >= 0.5 THEN m ELSE 0 END) AS on_lane FROM (SELECT f, day, count(*) AS m, avg(CASE WHEN version % 3 = 0 THEN 1.0 ELSE 0.0 END) AS share FROM fact JOIN v USING (key) WHERE inst <= day AND (ret IS NULL OR ret > day) GROUP BY f, day) GROUP BY 1")
def q_on_lane_share(spark, d):
    v, fact = _versions(spark, d)
    by_ride = joins.valid_at(fact, v, "key", "day").groupBy("f", "day").agg(F.count("*").alias("m"), F.avg(F.expr("if(version % 3 = 0, 1D, 0D)")).alias("share"))
    return by_ride.groupBy(F.year("day").alias("year")).agg(F.sum("m").alias("metres"), F.sum(F.when(F.col("share") >= 0.5, F.col("m")).otherwise(0)).alias("on_lane"))


@query("SELECT o_custkey AS key, o_orderkey AS version, lag(o_orderkey) OVER w AS prev, row_number() OVER w AS depth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def q_version_chain(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.lag("o_orderkey").over(w).alias("prev"), F.row_number().over(w).alias("depth"))


ORDERED = "SELECT edge, cents, n FROM (SELECT edge, cents, count(*) OVER (PARTITION BY edge) AS n, row_number() OVER (PARTITION BY edge ORDER BY cents) AS k FROM er) WHERE k = {0}"


@query(sql(ORDERED.format("(n + 1) // 2"), "er"))
def q_half_order_stat(spark, d):
    return tables.order_statistic(roles.edge_rides(spark, d).select("edge", "cents"), ["edge"], "cents", "(n + 1) div 2")


@query(sql(ORDERED.format("n // 2 + 1"), "er"))
def q_upper_median(spark, d):
    return tables.order_statistic(roles.edge_rides(spark, d).select("edge", "cents"), ["edge"], "cents", "n div 2 + 1")


@query(sql("SELECT dir, round(median(cents), 3) AS med, round(quantile_cont(cents, 0.25), 3) AS q1, round(quantile_cont(cents, 0.9), 3) AS q9 FROM er GROUP BY dir", "er"))
def q_quantiles(spark, d):
    found = tables.quantiles(roles.edge_rides(spark, d), "dir", "cents", [0.25, 0.5, 0.9])
    at = lambda f, name: F.round(F.max(F.when(F.col("fraction") == f, F.col("quantile"))), 3).alias(name)
    return found.groupBy("dir").agg(at(0.5, "med"), at(0.25, "q1"), at(0.9, "q9"))


@query(sql("SELECT a.seq, count(*) AS n FROM fixes a JOIN fixes b ON a.seq <> b.seq AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900 GROUP BY a.seq", "fixes"))
def q_grid_radius(spark, d):
    f = roles.fixes(spark, d).select("seq", "x", "y")
    return joins.count_within(f, 30, "seq").withColumnRenamed("id", "seq")


KNN = "SELECT {2} FROM (SELECT a.seq AS id, b.seq AS near, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, row_number() OVER (PARTITION BY a.seq ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.seq) AS rank FROM fixes a JOIN fixes b ON a.seq <> b.seq AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {0}) WHERE rank <= {1}"


@query(sql(KNN.format(625, 4, "id, near, d2, rank"), "fixes"))
def q_knn_bounded(spark, d):
    f = roles.fixes(spark, d).select("seq", "x", "y")
    return joins.nearest(f, f, 25, 4, "seq", "seq", other=True)


@query(sql(KNN.format(160000, 1, "id, near, d2"), "fixes"))
def q_nearest_min_by(spark, d):
    f = roles.fixes(spark, d).select("seq", "x", "y")
    return joins.nearest_one(f, f, 400, "seq", "seq", other=True)


@query(sql("SELECT a.ride AS fid, b.ride AS fid2, count(DISTINCT a.seq) AS hits FROM h a JOIN h b ON a.ride < b.ride AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 400 AND pow(a.dx * b.dx + a.dy * b.dy, 2) >= 0.75 * (a.dx * a.dx + a.dy * a.dy) * (b.dx * b.dx + b.dy * b.dy) GROUP BY 1, 2", "fixes", also="h AS (SELECT ride, seq, x, y, last_value(x) OVER w - first_value(x) OVER w AS dx, last_value(y) OVER w - first_value(y) OVER w AS dy FROM fixes WINDOW w AS (PARTITION BY ride ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"))
def q_self_parallel(spark, d):
    h = traces.headings(roles.fixes(spark, d)).select("ride", "seq", "x", "y", "dx", "dy")
    return joins.hits_along(h, 20)


BOXES = "SELECT n_nationkey AS area, (n_nationkey * 311) % 1800 AS x0, (n_nationkey * 173) % 1800 AS y0, (n_nationkey * 311) % 1800 + 150 AS x1, (n_nationkey * 173) % 1800 + 170 AS y1 FROM nation"


@query(sql(f"SELECT area, count(*) AS n FROM fixes JOIN ({BOXES}) ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY area", "fixes"))
def q_pip_box(spark, d):
    key = "cast(n_nationkey as bigint)"
    boxes = table(spark, d, "nation").selectExpr("n_nationkey as area", f"({key} * 311) % 1800 as x0", f"({key} * 173) % 1800 as y0", f"({key} * 311) % 1800 + 150 as x1", f"({key} * 173) % 1800 + 170 as y1")
    return joins.in_boxes(roles.fixes(spark, d).select("seq", "x", "y"), boxes, 100).groupBy("area").agg(F.count("*").alias("n"))


OD = "od AS (SELECT s_nationkey AS a, c_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def _od(spark, d) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    buyers = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "customer").selectExpr("c_custkey as o_custkey", "c_nationkey as b"), "o_custkey")
    sellers = table(spark, d, "supplier").selectExpr("s_suppkey as l_suppkey", "s_nationkey as a")
    return line.join(sellers, "l_suppkey").join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("a", "b").agg(F.count("*").alias("n"))


@query(f"WITH {OD} SELECT least(a, b) AS a, greatest(a, b) AS b, sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS loops FROM od GROUP BY 1, 2")
def q_od_demand(spark, d):
    return _od(spark, d).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("n"), F.sum(F.expr("if(a = b, n, 0)")).alias("loops")).select("a", "b", "n", "loops")


@query(f"WITH {OD}, st AS (SELECT n_nationkey AS s, n_regionkey AS l FROM nation UNION ALL SELECT n_nationkey, 9 FROM nation WHERE n_nationkey % 6 = 0), di AS (SELECT DISTINCT x.s AS a, y.s AS b FROM st x JOIN st y ON x.l = y.l), ch AS (SELECT DISTINCT x.a, y.b FROM di x JOIN di y ON x.b = y.a) SELECT CASE WHEN di.a IS NOT NULL THEN 'direct' WHEN ch.a IS NOT NULL THEN 'change' ELSE 'stranded' END AS kind, sum(n) AS n FROM od LEFT JOIN di ON od.a = di.a AND od.b = di.b LEFT JOIN ch ON od.a = ch.a AND od.b = ch.b GROUP BY 1")
def q_network_score(spark, d):
    n = table(spark, d, "nation")
    stops = n.selectExpr("n_nationkey as s", "n_regionkey as l").union(n.filter("n_nationkey % 6 = 0").selectExpr("n_nationkey", "9"))
    direct = stops.selectExpr("s as a", "l").join(stops.selectExpr("s as b", "l"), "l").select("a", "b").distinct()
    change = direct.selectExpr("a", "b as via").join(direct.selectExpr("a as via", "b"), "via").select("a", "b").distinct()
    reach = change.withColumn("c", F.lit(1)).join(direct.withColumn("d", F.lit(1)), ["a", "b"], "full_outer")
    kind = F.when(F.col("d") == 1, "direct").when(F.col("c") == 1, "change").otherwise("stranded")
    return _od(spark, d).join(reach, ["a", "b"], "left").groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"))


@query(sql("SELECT street, sum(passes * metres) AS pass_metres, max(passes) AS busiest, round(cast(sum(passes * metres * chunk) AS double) / sum(passes * metres), 4) AS centre FROM er JOIN edges USING (edge) GROUP BY street", "er", "edges"))
def q_street_pass_metres(spark, d):
    e = roles.edge_rides(spark, d).join(roles.edges(spark, d), "edge").withColumn("pm", F.col("passes") * F.col("metres"))
    return e.groupBy("street").agg(F.sum("pm").alias("pass_metres"), F.max("passes").alias("busiest"), F.round(F.sum(F.col("pm") * F.col("chunk")).cast("double") / F.sum("pm"), 4).alias("centre"))


@query(sql("SELECT supp, brand, m, round(100.0 * m / sum(m) OVER (PARTITION BY supp), 3) AS share FROM (SELECT supp, brand, sum(metres) AS m FROM er JOIN edges USING (edge) GROUP BY supp, brand)", "er", "edges"))
def q_pair_street_share(spark, d):
    m = roles.edge_rides(spark, d).join(roles.edges(spark, d), "edge").groupBy("supp", "brand").agg(F.sum("metres").alias("m"))
    return m.withColumn("share", F.round(F.lit(100.0) * F.col("m") / F.sum("m").over(Window.partitionBy("supp")), 3))


@query(sql("SELECT edge, count(*) AS n FROM (SELECT DISTINCT edge, ride FROM er WHERE day BETWEEN DATE '1995-01-01' AND DATE '1996-12-31') GROUP BY edge", "er"))
def q_date_range_passes(spark, d):
    return roles.edge_rides(spark, d).filter("day between date'1995-01-01' and date'1996-12-31'").select("edge", "ride").distinct().groupBy("edge").agg(F.count("*").alias("n"))


@query(sql("SELECT kind AS source, day, count(DISTINCT ride) AS rides, sum(cents) AS cents FROM fixes WHERE kind IN ('click', 'purchase') GROUP BY kind, day", "fixes"))
def q_source_filter(spark, d):
    return roles.fixes(spark, d).filter("kind in ('click', 'purchase')").groupBy(F.col("kind").alias("source"), "day").agg(F.countDistinct("ride").alias("rides"), F.sum("cents").alias("cents"))


@query(sql("SELECT g.day, coalesce(n, 0) AS n FROM (SELECT cast(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS date) AS day) g LEFT JOIN (SELECT day, count(*) AS n FROM fixes GROUP BY day) c ON g.day = c.day", "fixes"))
def q_calendar(spark, d):
    every = spark.range(1).select(F.explode(F.expr("sequence(date'2024-01-01', date'2024-01-31')")).alias("day"))
    return every.join(roles.fixes(spark, d).groupBy("day").agg(F.count("*").alias("n")), "day", "left").fillna(0, ["n"])


@query("SELECT cast(y AS int) AS year, n, cents, n - lag(n) OVER (ORDER BY y) AS change FROM (SELECT year(o_orderdate) AS y, count(*) AS n, sum(cast(round(o_totalprice * 100) AS bigint)) AS cents FROM orders GROUP BY 1)")
def q_year_recap(spark, d):
    y = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.sum(F.expr("cast(round(o_totalprice * 100) as bigint)")).alias("cents"))
    return y.withColumn("change", F.col("n") - F.lag("n").over(Window.orderBy("year")))


@query(r"SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\bAv\b', 'Ave', 'g') AS name FROM documents")
def q_norm_names(spark, d):
    return table(spark, d, "documents").select("doc_id", text.norm_name("text").alias("name"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'idiot')")
def q_name_search(spark, d):
    return table(spark, d, "documents").filter(text.name_matches("text", "the+idiot")).select("doc_id")


@query("SELECT cast(json_extract_string(props, '$.k') AS bigint) AS k, count(*) AS n FROM events GROUP BY 1")
def q_json_extract(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, cast(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * (o_orderkey % 100000) / 100.0 END AS decimal(10, 2)) AS amount FROM orders")
def q_money(spark, d):
    shown = F.expr("if(o_orderkey % 7 = 0, 'free', concat(if(o_orderkey % 2 = 0, '-$', '$'), format_number(cast(o_orderkey % 100000 as decimal(12, 2)) / 100, 2)))")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.money(shown).alias("amount"))


@query("SELECT p_brand, cast(row_number() OVER (ORDER BY p_brand) - 1 AS int) AS index FROM (SELECT DISTINCT p_brand FROM part)")
def q_dictionary_encode(spark, d):
    return tables.dictionary(table(spark, d, "part"), "p_brand")


@query(sql("SELECT street, cast(count(*) AS bigint) AS n, round(sum(ln), 3) AS length FROM (SELECT street, sqrt(pow(chunk - lag(chunk) OVER w, 2) + pow(metres - lag(metres) OVER w, 2)) AS ln FROM edges WINDOW w AS (PARTITION BY street ORDER BY edge)) GROUP BY street HAVING count(*) > 1", "edges"))
def q_path_length(spark, d):
    lines = roles.edges(spark, d).groupBy("street").agg(F.expr("transform(array_sort(collect_list(struct(edge, double(chunk) as x, double(metres) as y))), p -> struct(p.x as x, p.y as y))").alias("points"))
    return lines.filter("size(points) > 1").select("street", F.size("points").cast("bigint").alias("n"), F.round(geo.path_length("points"), 3).alias("length"))


OCTANTS = "['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW']"


@query(sql(f"SELECT way, count(*) AS n FROM (SELECT ({OCTANTS})[cast(floor(((((degrees(atan2(dx, dy)) + 360) % 360) + 22.5) % 360) / 45) AS int) + 1] AS way FROM (SELECT x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM fixes WINDOW w AS (PARTITION BY ride ORDER BY seq)) WHERE dx IS NOT NULL) GROUP BY way", "fixes"))
def q_octants(spark, d):
    w = traces.in_order("ride")
    steps = roles.fixes(spark, d).select((F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).alias("dy")).filter("dx is not null")
    return steps.groupBy(geo.octant(geo.compass("dx", "dy")).alias("way")).agg(F.count("*").alias("n"))


@query(sql("SELECT edge, street, ride, dir FROM (SELECT *, row_number() OVER (PARTITION BY edge ORDER BY passes DESC, ride, line) AS k FROM er JOIN edges USING (edge)) WHERE k <= 3", "er", "edges"))
def q_top3_rides(spark, d):
    e = roles.edge_rides(spark, d).join(roles.edges(spark, d).select("edge", "street"), "edge")
    return tables.top_per_group(e, ["edge"], F.desc("passes"), F.col("ride"), F.col("line"), n=3).select("edge", "street", "ride", "dir")


@query(sql("SELECT n, count(*) AS edges FROM (SELECT edge, count(*) AS n FROM er GROUP BY edge) GROUP BY n", "er"))
def q_pass_histogram(spark, d):
    return roles.edge_rides(spark, d).groupBy("edge").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("edges"))


#: The least node each node reaches, over edges e (a, b).
REACHED = """both_ways AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
cc(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM both_ways UNION (SELECT DISTINCT ON (x.node) x.node, y.component FROM recurring.cc x, both_ways e, cc y WHERE e.a = x.node AND e.b = y.node AND y.component < x.component ORDER BY x.node, y.component))"""


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT l_suppkey AS a, l_partkey + 1000000 AS b FROM lineitem), {REACHED} SELECT node, component FROM cc")
def q_components(spark, d):
    links = table(spark, d, "lineitem").selectExpr("l_suppkey as u", "l_partkey + 1000000 as v").distinct()
    return tables.components(links)


@query()
def q_hmm_grid(spark, d):
    nodes = spark.range(0, 441).selectExpr("id", "double(id % 21) * 100 as x", "double(id div 21) * 100 as y")
    right = nodes.filter("id % 21 < 20").selectExpr("id as u", "id + 1 as v", "x as ax", "y as ay", "x + 100 as bx", "y as by")
    up = nodes.filter("id < 420").selectExpr("id as u", "id + 21 as v", "x as ax", "y as ay", "x as bx", "y + 100 as by")
    fixes = roles.fixes(spark, d).selectExpr("ride", "seq", "double(x) as x", "double(y) as y")
    return matching.likeliest(fixes, right.union(up)).select("ride", "seq", "u", "v")


@query()
def q_permutation(spark, d):
    f = roles.fixes(spark, d)
    first = f.groupBy("ride").agg(F.min_by(F.struct("kind", "day", "cents"), "seq").alias("e")).selectExpr("ride as id", "e.cents as value", "concat(e.kind, ' ', e.day) as pool")
    return graph.permutation_test(first, f.selectExpr("concat(kind, ' ', day) as pool", "cents as value"), 20_000)


def _streets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as lines of 300 m, on parallel streets ten metres apart, with the passes of their line items."""
    lines = table(spark, d, "supplier").selectExpr("s_suppkey as fid", "concat('street ', s_nationkey) as name", "array(struct(double((s_suppkey * 90) % 1800) as x, double(s_nationkey * 10) as y), struct(double((s_suppkey * 90) % 1800 + 300) as x, double(s_nationkey * 10) as y)) as points")
    rides = roles.edge_rides(spark, d).repartition("ride").groupBy(F.col("supp").alias("fid"), "ride").agg(F.expr("count_if(dir = 1)").alias("fwd"), F.expr("count_if(dir = 0)").alias("rev"))
    return lines, rides


@query()
def q_merge_corridors(spark, d):
    shown, _ = corridors.merge_corridors(*_streets(spark, d))
    return shown.select("fid", "n", F.size("points").alias("vertices"))


@query()
def q_busiest_stretches(spark, d):
    lines, rides = _streets(spark, d)
    return graph.busiest_stretches(lines.join(corridors.passes(rides, "fid"), "fid"))


@query()
def q_export_features(spark, d):
    lines, rides = _streets(spark, d)
    days = table(spark, d, "orders").selectExpr("o_orderkey as ride", "to_date(o_orderdate) as day", "'' as clock", "o_totalprice as km")
    return writers.export_parts(lines.join(corridors.passes(rides, "fid"), "fid"), rides, days)[1]


@query()
def q_merge_audit(spark, d):
    return corridors.audit(_streets(spark, d)[0])
