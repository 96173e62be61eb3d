"""Queries of areas: nations as quadrilaterals, events as points, parts as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import areas
from wayfold.plans import roles
from wayfold.plans.catalog import query
from wayfold.plans.roles import sql, table

SIZE, NEAR = 64, 55

CORNERS = "[{'x': x0, 'y': y0 + 40}, {'x': x0 + 300, 'y': y0}, {'x': x0 + 340, 'y': y0 + 260}, {'x': x0 + 60, 'y': y0 + 300}]"
RINGS = f"""corner AS (SELECT area, unnest(range(1, 5)) AS i, {CORNERS} AS c FROM (SELECT n_nationkey AS area, (n_nationkey * 311) % 1600 AS x0, (n_nationkey * 173) % 1600 AS y0 FROM nation)),
ring AS (SELECT area, cast(c[i].x AS double) AS ax, cast(c[i].y AS double) AS ay, cast(c[i % 4 + 1].x AS double) AS bx, cast(c[i % 4 + 1].y AS double) AS by_ FROM corner)"""
HELD = """met AS (SELECT seq, area, sum(CASE WHEN (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / (by_ - ay) + ax THEN 1 ELSE 0 END) % 2 = 1 OR bool_or((bx - ax) * (y - ay) = (by_ - ay) * (x - ax) AND x BETWEEN least(ax, bx) AND greatest(ax, bx) AND y BETWEEN least(ay, by_) AND greatest(ay, by_)) AS held,
  min(sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (by_ - ay), 2))) AS d
  FROM (SELECT seq, x, y, ring.*, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t FROM fixes, ring) GROUP BY seq, area),
placed AS (SELECT f.seq, coalesce(h.area, s.area) AS area FROM fixes f LEFT JOIN (SELECT seq, min(area) AS area FROM met WHERE held GROUP BY seq) h USING (seq) LEFT JOIN (SELECT seq, arg_min(area, d * 1000 + area / 1000.0) AS area FROM met WHERE d <= 55 GROUP BY seq) s USING (seq))"""


def _rings(spark: SparkSession, d: str) -> DataFrame:
    key = "cast(n_nationkey as bigint)"
    at = table(spark, d, "nation").selectExpr("n_nationkey as area", f"double(({key} * 311) % 1600) as x", f"double(({key} * 173) % 1600) as y")
    corners = at.selectExpr("area", "array(struct(x, y + 40 as y), struct(x + 300 as x, y), struct(x + 340 as x, y + 260 as y), struct(x + 60 as x, y + 300 as y)) as c")
    edges = corners.select("area", F.explode(F.expr("transform(sequence(0, 3), i -> struct(c[i].x as ax, c[i].y as ay, c[(i + 1) % 4].x as bx, c[(i + 1) % 4].y as by))")).alias("e"))
    return edges.select("area", "e.*")


def _points(spark, d) -> DataFrame:
    return roles.fixes(spark, d).selectExpr("seq", "double(x) as x", "double(y) as y")


@query(sql("SELECT area, count(*) AS n FROM met WHERE held GROUP BY area", "fixes", also=f"{RINGS}, {HELD}"))
def q_points_in_polygons(spark, d):
    return areas.inside(_points(spark, d), _rings(spark, d), SIZE, "seq").groupBy("area").agg(F.count("*").alias("n"))


@query(sql("SELECT seq, area FROM placed", "fixes", also=f"{RINGS}, {HELD}"))
def q_locate(spark, d):
    return areas.locate(_points(spark, d), _rings(spark, d), SIZE, NEAR, "seq")


#: Disjoint square areas in a grid of five by five, and lines from parts: an edge from (x, y) to the right.
BOXES = "box AS (SELECT n_nationkey AS area, (n_nationkey % 5) * 400.0 AS x0, (n_nationkey // 5) * 400.0 AS y0, (n_nationkey % 5) * 400.0 + 350 AS x1, (n_nationkey // 5) * 400.0 + 350 AS y1, n_name AS name, r_name AS boro FROM nation JOIN region ON n_regionkey = r_regionkey)"
LINES = "line AS (SELECT p_partkey AS edge, (p_partkey * 7919) % 1800 + 0.5 AS x0, (p_partkey * 104729) % 2000 + 0.5 AS y, (p_partkey * 7919) % 1800 + 0.5 + p_size * 6 AS x1, p_size * 6.0 AS metres, p_type NOT LIKE 'LARGE%' AS rideable FROM part)"
#: The middle vertex of a line of two points is its second one.
HOME = "home AS (SELECT edge, area FROM line JOIN box ON line.x1 > box.x0 AND line.x1 < box.x1 AND line.y > box.y0 AND line.y < box.y1)"
AREA = """seen AS (SELECT edge, min(day) AS first_day FROM er GROUP BY edge),
speed AS (SELECT edge, cast(sum(passes) AS double) AS metres, cast(sum(chunk) AS double) AS seconds FROM (SELECT er.edge, passes, passes % 7 AS chunk FROM er) GROUP BY edge),
rows_ AS (SELECT b.area, b.name, b.boro, coalesce(n.net_m, 0) AS net_m, coalesce(n.ridden_m, 0) AS ridden_m, coalesce(s.dist_m, 0) AS dist_m, coalesce(s.time_s, 0) AS time_s, coalesce(r.rides, 0) AS rides FROM box b
  LEFT JOIN (SELECT area, sum(metres) AS net_m, sum(CASE WHEN first_day IS NOT NULL THEN metres ELSE 0 END) AS ridden_m FROM home JOIN line USING (edge) LEFT JOIN seen USING (edge) WHERE rideable GROUP BY area) n ON n.area = b.area
  LEFT JOIN (SELECT area, sum(metres) AS dist_m, sum(seconds) AS time_s FROM home JOIN speed USING (edge) GROUP BY area) s ON s.area = b.area
  LEFT JOIN (SELECT area, count(DISTINCT ride) AS rides FROM home JOIN line USING (edge) JOIN er USING (edge) WHERE rideable GROUP BY area) r ON r.area = b.area)"""


def _boxes(spark, d) -> tuple[DataFrame, DataFrame]:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    at = n.selectExpr("n_nationkey as area", "n_name as name", "r_name as boro", "(n_nationkey % 5) * 400D as x", "(n_nationkey div 5) * 400D as y")
    sides = at.select("area", F.explode(F.expr("array(struct(x as ax, y as ay, x + 350 as bx, y as by), struct(x + 350 as ax, y as ay, x + 350 as bx, y + 350 as by), struct(x + 350 as ax, y + 350 as ay, x as bx, y + 350 as by), struct(x as ax, y + 350 as ay, x as bx, y as by))")).alias("e"))
    return at.select("area", "name", "boro"), sides.select("area", "e.*")


def _lines(spark, d) -> DataFrame:
    at = table(spark, d, "part").selectExpr("p_partkey as edge", "(p_partkey * 7919) % 1800 + 0.5D as x", "(p_partkey * 104729) % 2000 + 0.5D as y", "p_size * 6D as metres", "p_type not like 'LARGE%' as rideable")
    return at.selectExpr("edge", "metres", "rideable", "array(struct(x, y), struct(x + metres as x, y)) as points")


def _measured(spark, d) -> tuple[DataFrame, DataFrame]:
    names, rings = _boxes(spark, d)
    lines, er = _lines(spark, d), roles.edge_rides(spark, d)
    speed = er.groupBy("edge").agg(F.sum("passes").cast("double").alias("metres"), F.sum(F.col("passes") % 7).cast("double").alias("seconds"))
    return areas.measure(names, areas.placed_lines(lines, rings, 100), lines.select("edge", "metres", "rideable"), er.select("edge", "ride", "day"), speed)


@query(sql("SELECT edge, area FROM line LEFT JOIN home USING (edge)", "er", also=f"{BOXES}, {LINES}, {HOME}"))
def q_placed_lines(spark, d):
    return areas.placed_lines(_lines(spark, d), _boxes(spark, d)[1], 100)


@query(sql("SELECT * FROM rows_", "er", also=f"{BOXES}, {LINES}, {HOME}, {AREA}"))
def q_area_measure(spark, d):
    return _measured(spark, d)[0]


@query(sql("SELECT area, first_day AS day, sum(metres) AS metres FROM home JOIN line USING (edge) JOIN seen USING (edge) WHERE rideable GROUP BY area, first_day", "er", also=f"{BOXES}, {LINES}, {HOME}, {AREA}"))
def q_area_first_days(spark, d):
    return _measured(spark, d)[1]


@query(sql("SELECT area, name, boro, cast(row_number() OVER (ORDER BY ridden_m DESC, name) - 1 AS int) AS rank, cast(round(net_m) AS bigint) AS net_m, cast(round(ridden_m) AS bigint) AS ridden_m, cast(round(dist_m) AS bigint) AS dist_m, cast(round(time_s) AS bigint) AS time_s FROM rows_ WHERE net_m > 0", "er", also=f"{BOXES}, {LINES}, {HOME}, {AREA}"))
def q_area_summary(spark, d):
    return areas.summary(*_measured(spark, d)).drop("new")


@query(sql("SELECT cast(sum(round(net_m)) AS bigint) AS net_m, cast(sum(round(ridden_m)) AS bigint) AS ridden_m, cast(sum(round(dist_m)) AS bigint) AS dist_m, cast(sum(round(time_s)) AS bigint) AS time_s FROM rows_ WHERE net_m > 0", "er", also=f"{BOXES}, {LINES}, {HOME}, {AREA}"))
def q_area_totals(spark, d):
    return areas.totals(areas.summary(*_measured(spark, d)))


@query(sql("SELECT edge AS fid, cast(coalesce(rank, -1) AS int) AS n FROM line LEFT JOIN home USING (edge) LEFT JOIN (SELECT area, row_number() OVER (ORDER BY ridden_m DESC, name) - 1 AS rank FROM rows_ WHERE net_m > 0) USING (area)", "er", also=f"{BOXES}, {LINES}, {HOME}, {AREA}"))
def q_area_tags(spark, d):
    rings = _boxes(spark, d)[1]
    features = _lines(spark, d).selectExpr("edge as fid", "points")
    return areas.tag(features, areas.summary(*_measured(spark, d)), rings, 100)


@query(sql("SELECT edge, area, round(least(line.x1, box.x1) - greatest(line.x0, box.x0), 3) AS metres FROM line JOIN box ON least(line.x1, box.x1) > greatest(line.x0, box.x0) AND line.y > box.y0 AND line.y < box.y1", "er", also=f"{BOXES}, {LINES}"))
def q_boundary_shares(spark, d):
    return areas.shares(_lines(spark, d).select("edge", "points"), _boxes(spark, d)[1], 100).filter("area is not null").withColumn("metres", F.round("metres", 3))


@query(sql("SELECT area, boro, count(*) AS ends FROM home JOIN box USING (area) GROUP BY area, boro", "er", also=f"{BOXES}, {LINES}, {HOME}"))
def q_ends_by_area(spark, d):
    names, rings = _boxes(spark, d)
    return areas.placed_lines(_lines(spark, d), rings, 100).join(names, "area").groupBy("area", "boro").agg(F.count("*").alias("ends"))
