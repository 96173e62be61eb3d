"""Queries of geometry and text expressions, over coordinates and strings made from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import geo, text
from wayfold.plans.catalog import query
from wayfold.plans.roles import table
from wayfold.streaming import ingest

PLACES = "p AS (SELECT event_id AS id, 40.5 + (event_id % 97) / 200.0 AS la, -74.2 + (event_id % 89) / 150.0 AS lo, 40.5 + (event_id % 83) / 200.0 AS lb, -74.2 + (event_id % 79) / 150.0 AS lp, cast(event_id % 61 - 30 AS double) AS dx, cast(event_id % 53 - 26 AS double) AS dy, cast(event_id % 47 - 23 AS double) AS ex, cast(event_id % 43 - 21 AS double) AS ey FROM events)"
COLUMNS = ("event_id as id", "40.5D + (event_id % 97) / 200D as la", "-74.2D + (event_id % 89) / 150D as lo", "40.5D + (event_id % 83) / 200D as lb", "-74.2D + (event_id % 79) / 150D as lp", "double(event_id % 61 - 30) as dx", "double(event_id % 53 - 26) as dy", "double(event_id % 47 - 23) as ex", "double(event_id % 43 - 21) as ey")
KX = "111320.0 * cos(radians(40.73))"


def _places(spark, d):
    return table(spark, d, "events").selectExpr(*COLUMNS)


def _haversine(radius: str) -> str:
    return f"2 * {radius} * asin(sqrt(least(1, pow(sin(radians(lb - la) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * pow(sin(radians(lp - lo) / 2), 2))))"


@query(f"WITH {PLACES} SELECT id, round({_haversine('6371000.0')}, 3) AS m, round({_haversine('6371.0')}, 6) AS km, round(sqrt(pow((lp - lo) * {KX}, 2) + pow((lb - la) * 110540.0, 2)), 3) AS flat, round(111320.0 * sqrt(pow((lp - lo) * cos(radians((la + lb) / 2)), 2) + pow(lb - la, 2)), 3) AS mid FROM p")
def q_distances(spark, d):
    ends = ("la", "lo", "lb", "lp")
    return _places(spark, d).select("id", F.round(geo.haversine(*ends), 3).alias("m"), F.round(geo.haversine(*ends, geo.EARTH_KM), 6).alias("km"), F.round(geo.planar(*ends), 3).alias("flat"), F.round(geo.planar_mid(*ends), 3).alias("mid"))


@query(f"WITH {PLACES}, a AS (SELECT *, (degrees(atan2(dx, dy)) + 360) % 360 AS c, (degrees(atan2(dy, dx)) + 360) % 360 AS g, (degrees(atan2(ex, ey)) + 360) % 360 AS e FROM p) SELECT id, round(c, 6) AS compass, round(g, 6) AS angle, round(least(abs(c - e) % 360, 360 - abs(c - e) % 360), 6) AS turn, round(least(abs(c - e) % 180, 180 - abs(c - e) % 180), 6) AS aslant, dx * ex + dy * ey < 0 AS opposed FROM a")
def q_bearings(spark, d):
    c, e = geo.compass("dx", "dy"), geo.compass("ex", "ey")
    return _places(spark, d).select("id", F.round(c, 6).alias("compass"), F.round(geo.math_angle("dx", "dy"), 6).alias("angle"), F.round(geo.turn(c, e), 6).alias("turn"), F.round(geo.turn(c, e, 180.0), 6).alias("aslant"), geo.opposed("dx", "dy", "ex", "ey").alias("opposed"))


@query(f"WITH {PLACES}, t AS (SELECT *, greatest(0, least(1, CASE WHEN ex * ex + ey * ey > 0 THEN (dx * ex + dy * ey) / (ex * ex + ey * ey) ELSE 0 END)) AS t FROM p) SELECT id, round(sqrt(pow(dx - t * ex, 2) + pow(dy - t * ey, 2)), 6) AS d FROM t")
def q_point_segments(spark, d):
    zero = F.lit(0.0)
    return _places(spark, d).select("id", F.round(geo.point_segment("dx", "dy", zero, zero, "ex", "ey"), 6).alias("d"))


@query(f"WITH {PLACES} SELECT id, round(dx * cos(radians(29)) + dy * sin(radians(29)), 6) AS x, round((dy * cos(radians(29)) - dx * sin(radians(29))) * 1.5, 6) AS y, round(dx / 7) * 7 AS cell FROM p")
def q_rotated(spark, d):
    x, y = geo.rotated("dx", "dy", 29.0, 1.5)
    return _places(spark, d).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), geo.gridded("dx", 7.0).alias("cell"))


@query(f"WITH {PLACES} SELECT round(greatest(min(lo), -74.1) - 0.005, 6) AS west, round(greatest(min(la), 40.45) - 0.005, 6) AS south, round(least(max(lo), -73.9) + 0.005, 6) AS east, round(least(max(la), 40.95) + 0.005, 6) AS north FROM p")
def q_bounding_box(spark, d):
    box = geo.bounding_box(_places(spark, d).selectExpr("lo as lon", "la as lat"), (-74.1, 40.45, -73.9, 40.95))
    return box.select(*[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")])


@query("SELECT p_partkey AS id, p_size % 7 // 2 * 10 AS x FROM part")
def q_middle_vertices(spark, d):
    lines = table(spark, d, "part").selectExpr("p_partkey as id", "transform(sequence(0, int(p_size % 7) - 1 + if(p_size % 7 = 0, 1, 0)), i -> struct(i * 10 as x, 0 as y)) as points")
    return lines.select("id", geo.middle("points")["x"].alias("x"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE epoch_us(ts) // 1000000 + CASE WHEN event_id % 3 = 0 THEN 14400 ELSE 0 END END AS at FROM events")
def q_ride_times(spark, d):
    e = table(spark, d, "events")
    shown = F.expr("case event_id % 3 when 0 then concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' -0400') when 1 then concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z') else date_format(ts, 'yyyy-MM-dd HH:mm:ss') end")
    return e.select(F.col("event_id").alias("id"), F.unix_seconds(text.ride_time(shown)).alias("at"))


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN event_id::varchar WHEN 1 THEN event_id::varchar ELSE event_id || '-7417' END AS bike FROM events")
def q_vehicle_ids(spark, d):
    shown = F.expr("case event_id % 3 when 0 then concat(event_id, '.0') when 1 then string(event_id) else concat(event_id, '-7417') end")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), text.vehicle_id(shown).alias("bike"))


@query("SELECT epoch_us(ts) // 3600000000 AS hour, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2")
def q_hourly_counts(spark, d):
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = ingest.windowed_counts(rows)
    return counts.select((F.unix_seconds("window.start") / 3600).cast("bigint").alias("hour"), F.col("event_type").alias("type"), "n")
