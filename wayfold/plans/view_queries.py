"""Queries of the map's reader, of lanes, transit and state, with SQL where it can be written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import harmony, lanes, matching, state, tables, transit, views
from wayfold.plans import area_queries, roles
from wayfold.plans.catalog import query
from wayfold.plans.roles import sql, table
from wayfold.sources import readers, writers

FIRST, LAST = "1995-01-01", "1996-12-31"


def _passes(spark, d) -> DataFrame:
    return roles.edge_rides(spark, d).select(F.col("supp").alias("feature"), "day", "ride", F.lit(1).alias("n"))


@query(sql("SELECT feature, n, max(n) OVER () AS top FROM (SELECT supp AS feature, count(*) AS n FROM er WHERE day BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY supp)", "er"))
def q_features_in_dates(spark, d):
    return views.in_dates(_passes(spark, d), F.lit(FIRST).cast("date"), F.lit(LAST).cast("date"))


@query("SELECT 'own' AS source, count(*) AS rides, (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) AS hidden FROM orders WHERE o_orderkey % 5 = 1 UNION ALL SELECT 'dock', count(*), (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) FROM orders WHERE o_orderkey % 5 > 1")
def q_rides_by_source(spark, d):
    rides = table(spark, d, "orders").selectExpr("o_orderkey as ride", "o_orderkey % 5 - 1 as source")
    each = []
    for wanted in ("own", "dock"):
        shown, hidden = views.by_source(rides, wanted)
        each.append(shown.agg(F.count("*").alias("rides")).join(hidden).select(F.lit(wanted).alias("source"), "rides", "hidden"))
    return each[0].unionByName(each[1])


@query(sql("SELECT supp AS feature, ride, count(*) AS passes FROM er GROUP BY supp, ride", "er"))
def q_feature_detail(spark, d):
    return views.detail(_passes(spark, d))


@query(sql("SELECT area, rank FROM (SELECT area, cast(row_number() OVER (ORDER BY ridden_m / net_m DESC, name) AS int) AS rank FROM rows_ WHERE net_m > 0)", "er", also=f"{area_queries.BOXES}, {area_queries.LINES}, {area_queries.HOME}, {area_queries.AREA}"))
def q_areas_explored(spark, d):
    rows = area_queries._measured(spark, d)[0].filter("net_m > 0")
    return views.ranked_areas(rows, "explored").select("area", "rank")


@query(sql("SELECT b.area, coalesce(f.metres, 0) AS metres FROM rows_ b LEFT JOIN (SELECT area, sum(metres) AS metres FROM home JOIN line USING (edge) JOIN seen USING (edge) WHERE rideable AND first_day <= DATE '1992-12-31' GROUP BY area) f ON f.area = b.area", "er", also=f"{area_queries.BOXES}, {area_queries.LINES}, {area_queries.HOME}, {area_queries.AREA}"))
def q_area_fill(spark, d):
    rows, first = area_queries._measured(spark, d)
    return views.filled(rows, first, F.lit("1992-12-31").cast("date")).select("area", "metres")


@query(sql("SELECT area, count(DISTINCT ride) AS rides FROM home JOIN er USING (edge) WHERE day BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY area", "er", also=f"{area_queries.BOXES}, {area_queries.LINES}, {area_queries.HOME}"))
def q_rides_through_areas(spark, d):
    rings = area_queries._boxes(spark, d)[1]
    placed = area_queries.areas.placed_lines(area_queries._lines(spark, d), rings, 100)
    return views.rides_through(placed, roles.edge_rides(spark, d).select("edge", "ride", "day"), F.lit(FIRST).cast("date"), F.lit(LAST).cast("date"))


PARTNERS = "t AS (SELECT 'dock ' || event_id % 20 AS a, 'dock ' || event_id * 7 % 20 AS b, cast(ts AS date) AS day, event_id % 9 - 2 AS cited FROM events)"


@query(f"WITH {PARTNERS} SELECT dock, partner, sum(o) AS out, sum(i) AS \"in\", count(DISTINCT CASE WHEN cited >= 0 THEN cited END) AS rides FROM (SELECT a AS dock, b AS partner, 1 AS o, 0 AS i, cited FROM t WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' UNION ALL SELECT b, a, 0, 1, cited FROM t WHERE a <> b AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20') GROUP BY dock, partner")
def q_dock_partners(spark, d):
    t = table(spark, d, "events").selectExpr("concat('dock ', event_id % 20) as a", "concat('dock ', event_id * 7 % 20) as b", "to_date(ts) as day", "event_id % 9 - 2 as at")
    return views.dock_partners(t, F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date"))


@query("WITH v AS (SELECT cast(o_orderdate AS date) AS inst, lead(cast(o_orderdate AS date)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ret, o_orderkey % 900 AS metres, CASE WHEN o_orderkey % 3 = 0 THEN cast(o_orderdate AS date) + 30 END AS first FROM orders) SELECT count(*) AS lanes, sum(metres) AS metres, sum(CASE WHEN first <= DATE '1996-06-30' THEN metres ELSE 0 END) AS ridden_m FROM v WHERE inst <= DATE '1996-06-30' AND (ret IS NULL OR ret > DATE '1996-06-30')")
def q_lanes_standing(spark, d):
    w = views.Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("inst"), F.lead(F.to_date("o_orderdate")).over(w).alias("ret"), F.expr("o_orderkey % 900 as metres"), F.expr("if(o_orderkey % 3 = 0, date_add(to_date(o_orderdate), 30), null) as first"))
    return views.standing(v, F.lit("1996-06-30").cast("date"))


@query(sql("SELECT seq AS point, arg_min(k, abs(y - k * 100) * 1000 + k) AS fid, min(abs(y - k * 100)) * 1.0 AS d FROM fixes, (SELECT unnest(range(0, 21)) AS k) WHERE abs(y - k * 100) <= 30 GROUP BY seq", "fixes"))
def q_clicked(spark, d):
    streets = spark.range(21).selectExpr("id as fid", "array(named_struct('x', -100D, 'y', id * 100D), named_struct('x', 2100D, 'y', id * 100D)) as points")
    return views.clicked(roles.fixes(spark, d).selectExpr("seq as point", "double(x) as x", "double(y) as y"), streets, 30)


@query(sql("SELECT sum(n) AS passes, count(*) AS rides, round(sum(n) * 1.0 / count(*), 6) AS ratio FROM (SELECT supp, ride, count(*) AS n FROM er GROUP BY supp, ride)", "er"))
def q_inflation(spark, d):
    return views.inflation(views.detail(_passes(spark, d)).withColumnRenamed("passes", "n")).withColumn("ratio", F.round("ratio", 6))


@query(sql("SELECT round(100.0 * (SELECT sum(n) FROM (SELECT count(*) AS n FROM er GROUP BY supp ORDER BY n DESC LIMIT 20)) / count(*), 6) AS share FROM er", "er"))
def q_top_share(spark, d):
    return views.top_share(_passes(spark, d).groupBy("feature").agg(F.sum("n").alias("n")), "n", 20, F.desc("n")).withColumn("share", F.round("share", 6))


RULES = "m AS (SELECT street, edge, ride, sum(dir) AS f, sum(1 - dir) AS r FROM er JOIN edges USING (edge) GROUP BY street, edge, ride), c AS (SELECT street, sum(d) AS n_dir, sum(x) AS n_max, sum(s) AS n_sum FROM (SELECT street, ride, greatest(1, max(f) + max(r)) AS d, greatest(1, max(f + r)) AS x, greatest(1, sum(f + r)) AS s FROM m GROUP BY street, ride) GROUP BY street)"


@query(sql("SELECT street, n_dir, n_max, n_sum FROM c WHERE n_dir <> n_max OR n_dir <> n_sum", "er", "edges", also=RULES))
def q_merge_rules(spark, d):
    e = roles.edge_rides(spark, d).join(roles.edges(spark, d).select("edge", "street"), "edge")
    members = e.groupBy("street", "edge", "ride").agg(F.sum("dir").alias("fwd"), F.sum(1 - F.col("dir")).alias("rev"))
    return harmony.compare_rules(members, "street")


@query(sql("SELECT a.edge, a.ride, b.ride IS NOT NULL AND CASE WHEN a.f + a.r = 0 OR b.f + b.r = 0 THEN greatest(1, b.f + b.r) >= greatest(1, a.f + a.r) ELSE b.f >= a.f AND b.r >= a.r END AS covered FROM m a LEFT JOIN m b ON b.ride = a.ride AND b.edge = a.edge + 1", "er", also="m AS (SELECT edge, ride, sum(CASE WHEN passes > 20 THEN dir ELSE 0 END) AS f, sum(CASE WHEN passes > 20 THEN 1 - dir ELSE 0 END) AS r FROM er GROUP BY edge, ride)"))
def q_covered_passes(spark, d):
    way = lambda w: F.sum(F.when(F.col("passes") > 20, w).otherwise(0))
    m = roles.edge_rides(spark, d).groupBy("edge", "ride").agg(way(F.col("dir")).alias("fwd"), way(1 - F.col("dir")).alias("rev"))
    other = m.select((F.col("edge") - 1).alias("edge"), "ride", F.col("fwd").alias("hf"), F.col("rev").alias("hr"))
    return m.join(other, ["edge", "ride"], "left").select("edge", "ride", F.coalesce(harmony.covers("fwd", "rev", "hf", "hr"), F.lit(False)).alias("covered"))


OD = "od AS (SELECT least(s_nationkey, c_nationkey) AS a, greatest(s_nationkey, c_nationkey) AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2), st AS (SELECT n_nationkey AS station, n_regionkey AS line FROM nation UNION ALL SELECT n_nationkey, 9 FROM nation WHERE n_nationkey % 6 = 0)"


def _pairs(spark, d) -> DataFrame:
    homes = spark.range(25).selectExpr("int(id) as id", "int(id) as station")
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    ends = line.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "supplier").selectExpr("s_suppkey as l_suppkey", "s_nationkey as ca"), "l_suppkey").join(table(spark, d, "customer").selectExpr("c_custkey as o_custkey", "c_nationkey as cb"), "o_custkey")
    return transit.demand(ends, homes)


def _stops(spark, d) -> DataFrame:
    n = table(spark, d, "nation")
    return n.selectExpr("n_nationkey as station", "n_regionkey as line").union(n.filter("n_nationkey % 6 = 0").selectExpr("n_nationkey", "9"))


@query(f"WITH {OD} SELECT a, b, n FROM od")
def q_station_demand(spark, d):
    return _pairs(spark, d)


@query(f"WITH {OD}, di AS (SELECT DISTINCT x.station AS a, y.station AS b FROM st x JOIN st y ON x.line = y.line), ch AS (SELECT DISTINCT x.a, y.b FROM di x JOIN di y ON x.b = y.a) SELECT sum(CASE WHEN di.a IS NOT NULL THEN n ELSE 0 END) AS direct, sum(CASE WHEN di.a IS NULL AND ch.a IS NOT NULL THEN n ELSE 0 END) AS one_change, sum(CASE WHEN ch.a IS NULL THEN n ELSE 0 END) AS stranded FROM od LEFT JOIN di ON od.a = di.a AND od.b = di.b LEFT JOIN ch ON od.a = ch.a AND od.b = ch.b")
def q_transit_score(spark, d):
    return transit.score(_stops(spark, d), _pairs(spark, d))


@query(f"WITH {OD} SELECT DISTINCT x.station AS a, y.station AS b FROM st x JOIN st y ON x.line = y.line WHERE x.station <> y.station")
def q_stations_reachable(spark, d):
    return transit.reachable(_stops(spark, d))


@query("WITH s AS (SELECT p_partkey AS id, p_size % 5 AS line, (p_partkey * 7919) % 5000 AS x, (p_partkey * 104729) % 5000 AS y FROM part) SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.id < b.id AND a.line <> b.line AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 360 * 360")
def q_transfers(spark, d):
    s = table(spark, d, "part").selectExpr("p_partkey as id", "p_size % 5 as line", "(p_partkey * 7919) % 5000 as x", "(p_partkey * 104729) % 5000 as y")
    return transit.transfers(s)


@query("WITH c AS (SELECT p_partkey AS id, (p_partkey * 7919) % 9000 AS x, (p_partkey * 104729) % 9000 AS y FROM part), s AS (SELECT s_suppkey AS sid, (s_suppkey * 911) % 9000 AS x, (s_suppkey * 577) % 9000 AS y FROM supplier) SELECT id, (SELECT arg_min(sid, (pow(c.x - s.x, 2) + pow(c.y - s.y, 2)) * 10000 + sid) FROM s WHERE pow(c.x - s.x, 2) + pow(c.y - s.y, 2) <= 640000) AS station FROM c")
def q_home_stations(spark, d):
    c = table(spark, d, "part").selectExpr("p_partkey as id", "(p_partkey * 7919) % 9000 as x", "(p_partkey * 104729) % 9000 as y")
    return transit.home_stations(c, table(spark, d, "supplier").selectExpr("s_suppkey as id", "(s_suppkey * 911) % 9000 as x", "(s_suppkey * 577) % 9000 as y"))


@query()
def q_transit_lines(spark, d):
    stations = table(spark, d, "nation").selectExpr("n_nationkey as id", "double((n_nationkey * 911) % 25) * 300 as x", "double(n_nationkey) * 200 as y")
    return transit.lay_lines(stations, _pairs(spark, d), (4, 5))


@query()
def q_matched_edges(spark, d):
    nodes = spark.range(441).selectExpr("id", "double(id % 21) * 100 as x", "double(id div 21) * 100 as y")
    right = nodes.filter("id % 21 < 20").selectExpr("id as u", "id + 1 as v", "x as ax", "y as ay", "x + 100 as bx", "y as by")
    up = nodes.filter("id < 420").selectExpr("id as u", "id + 21 as v", "x as ax", "y as ay", "x as bx", "y + 100 as by")
    w = views.Window.partitionBy("user_id").orderBy("event_id")
    fixes = table(spark, d, "events").select(F.col("user_id").alias("ride"), F.col("event_id").alias("seq"), F.row_number().over(w).alias("k")).selectExpr("ride", "seq", "double(abs(pmod(k * 20, 4000) - 2000)) as x", "(ride % 21) * 100D + seq % 9 - 4 as y")
    return matching.match(fixes, right.union(up))[0]


@query("WITH s AS (SELECT p_partkey AS edge, (p_partkey * 7919) % 2000 AS x, p_partkey % 40 AS row FROM part), l AS (SELECT s_suppkey AS lane, (s_suppkey * 911) % 2000 AS x, s_suppkey % 40 AS row FROM supplier) SELECT edge, lane, round(count(*) / 21.0, 6) AS share FROM s JOIN l USING (row), (SELECT unnest(range(0, 21)) AS k) WHERE pow(greatest(0, l.x - (s.x + 10 * k), s.x + 10 * k - l.x - 150), 2) + 64 <= 144 GROUP BY edge, lane")
def q_lane_cover(spark, d):
    streets = table(spark, d, "part").selectExpr("p_partkey as edge", "double((p_partkey * 7919) % 2000) as x", "double(p_partkey % 40 * 50) as y").selectExpr("edge", "array(struct(x, y), struct(x + 200 as x, y)) as points")
    built = table(spark, d, "supplier").selectExpr("s_suppkey as lane", "0 as part", "double((s_suppkey * 911) % 2000) as x", "double(s_suppkey % 40 * 50 + 8) as y").selectExpr("lane", "part", "array(struct(x, y), struct(x + 150 as x, y)) as points")
    return lanes.edge_cover(built, streets).withColumn("share", F.round("share", 6))


@query("WITH v AS (SELECT l_suppkey % 50 AS lane, l_partkey % 200 AS edge, max(l_quantity) / 100 AS share FROM lineitem GROUP BY 1, 2), l AS (SELECT s_suppkey AS lane, CASE WHEN s_suppkey % 2 = 0 THEN 'I' ELSE 'II' END AS cls, DATE '1993-01-01' + cast(s_suppkey * 9 AS int) AS inst, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1996-01-01' END AS ret FROM supplier WHERE s_suppkey < 50), r AS (SELECT l_partkey % 200 AS edge, l_orderkey AS ride, cast(l_shipdate AS date) AS day, 100 + l_partkey % 200 AS metres, max(l_linenumber) AS passes FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2, 3, 4), h AS (SELECT r.edge, ride, day, metres * passes AS m, coalesce(sum(share) FILTER (inst <= day AND (ret IS NULL OR ret > day)), 0) AS lane, coalesce(sum(share) FILTER (cls = 'I' AND inst <= day AND (ret IS NULL OR ret > day)), 0) AS prot FROM r LEFT JOIN v USING (edge) LEFT JOIN l ON l.lane = v.lane GROUP BY r.edge, ride, day, metres, passes) SELECT cast(year(day) AS int) AS year, cast(sum(m) AS bigint) AS metres, cast(sum(CASE WHEN lane >= 0.5 THEN m ELSE 0 END) AS bigint) AS on_lane, cast(sum(CASE WHEN prot >= 0.5 THEN m ELSE 0 END) AS bigint) AS on_protected FROM h GROUP BY 1")
def q_riding_share(spark, d):
    line = table(spark, d, "lineitem")
    cover = line.selectExpr("l_suppkey % 50 as lane", "l_partkey % 200 as edge", "l_quantity").groupBy("lane", "edge").agg((F.max("l_quantity") / 100).alias("share"))
    built = table(spark, d, "supplier").filter("s_suppkey < 50").selectExpr("s_suppkey as lane", "if(s_suppkey % 2 = 0, 'I', 'II') as cls", "date_add(date'1993-01-01', int(s_suppkey * 9)) as inst", "if(s_suppkey % 3 = 0, date'1996-01-01', null) as ret")
    rides = line.filter("l_linenumber <= 2").selectExpr("l_partkey % 200 as edge", "l_orderkey as ride", "to_date(l_shipdate) as day", "100 + l_partkey % 200 as metres", "l_linenumber as passes")
    return lanes.riding_share(cover, built, rides)


@query("SELECT l_partkey AS edge, array_to_string(list_sort(list(DISTINCT cast(l_shipdate AS date)::varchar)), ',') AS days FROM lineitem GROUP BY 1")
def q_ride_days(spark, d):
    days = lanes.ride_days(roles.edge_rides(spark, d).select("edge", "day"))
    return days.select("edge", F.array_join(F.col("days").cast("array<string>"), ",").alias("days"))


@query("SELECT o_orderkey AS ride, cast(k % 7 AS int) AS stripe FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) - 1 AS k FROM orders)")
def q_striped(spark, d):
    return tables.striped(table(spark, d, "orders").selectExpr("o_orderkey as ride", "o_custkey as size"), 7).select("ride", "stripe")


@query("SELECT l_orderkey AS ride, count(*) AS parts FROM lineitem WHERE l_quantity > 2 AND l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT CASE WHEN l_quantity > 2 THEN l_linenumber END) >= count(DISTINCT l_linenumber)) GROUP BY 1")
def q_ready_rides(spark, d):
    line = table(spark, d, "lineitem")
    expected = line.groupBy(F.col("l_orderkey").alias("ride")).agg(F.count_distinct("l_linenumber").alias("parts"))
    landed = line.filter("l_quantity > 2").selectExpr("l_orderkey as ride", "l_linenumber as part")
    return state.ready(landed, expected).groupBy("ride").agg(F.count("*").alias("parts"))


@query("SELECT user_id AS ride, arg_min(event_id % 360, event_id) AS lon0, arg_max(event_id % 360, event_id) AS lon1 FROM events GROUP BY 1 HAVING count(*) >= 2")
def q_ride_ends(spark, d):
    ends = readers.ride_ends(table(spark, d, "events").selectExpr("user_id as ride", "event_id as seq", "event_id % 360 as lon", "event_id % 90 as lat"))
    return ends.select("ride", "lon0", "lon1")


@query("SELECT event_type AS type, count(*) AS n FROM events WHERE event_id % 10 <> 0 AND event_type NOT IN ('indoor_cycling') GROUP BY 1")
def q_outdoor(spark, d):
    rides = table(spark, d, "events").selectExpr("if(event_id % 10 = 0, null, event_id) as id", "event_type as type")
    return readers.outdoor(rides).groupBy("type").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT p_partkey AS fid, p_size AS n FROM part) SELECT fid, round(sqrt(n * 1.0 / (SELECT max(n) FROM c)), 6) AS shade FROM c WHERE fid % 100 BETWEEN 20 AND 40")
def q_shades(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey as fid", "p_size as n", "array(named_struct('x', double(p_partkey % 100), 'y', 0D)) as points")
    return writers.shades(rows, (20, -1, 40, 1)).select("fid", F.round("shade", 6).alias("shade"))


@query("SELECT cast(floor(event_id % 5000 / 100.0) + i AS bigint) AS cx, cast(floor(event_id % 700 / 100.0) + j AS bigint) AS cy FROM events, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j) WHERE event_id % 50 = 0 GROUP BY 1, 2")
def q_region_cells(spark, d):
    seen = table(spark, d, "events").filter("event_id % 50 = 0").selectExpr("double(event_id % 5000) as x", "double(event_id % 700) as y")
    return state.grown(state.region_cells(seen, 100, 100), state.region_cells(seen.limit(0), 100, 100))
