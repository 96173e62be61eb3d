"""What a reader of the map asks: by dates, sources, areas, docks, lanes, or at a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import joins, network


def in_dates(passes: DataFrame, first, last) -> DataFrame:
    """feature, n, top: passes in a range of days; features without one vanish, and the scale is theirs. passes: feature, day, n."""
    counts = passes.filter(F.col("day").between(first, last)).groupBy("feature").agg(F.sum("n").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.max("n").alias("top"))))


def by_source(rides: DataFrame, wanted: str) -> tuple[DataFrame, DataFrame]:
    """(rides of a source: 'all', 'dock' (1 or more trips) or 'own' (0); hidden: how many rides of unknown source are in neither)."""
    keep = {"all": F.lit(True), "dock": F.col("source") >= 1, "own": F.col("source") == 0}[wanted]
    return rides.filter(keep), rides.agg(F.count_if(F.col("source") == -1).alias("hidden") if wanted != "all" else F.lit(0).cast("bigint").alias("hidden"))


def detail(feature_rides: DataFrame) -> DataFrame:
    """feature, ride, passes: a row for each ride along a feature."""
    return feature_rides.groupBy("feature", "ride").agg(F.count("*").alias("passes"))


def ranked_areas(areas: DataFrame, by: str) -> DataFrame:
    """Areas by 'dist', 'time' or 'explored' (the ridden share of the network), the most first; ties by name. A row an area."""
    key = {"dist": F.col("dist_m"), "time": F.col("time_s"), "explored": F.try_divide("ridden_m", "net_m")}[by]
    return areas.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(key), "name")))


def filled(areas: DataFrame, first: DataFrame, last) -> DataFrame:
    """area, metres, share of the network that was ridden up to a day."""
    sums = first.filter(F.col("day") <= last).groupBy("area").agg(F.sum("metres").alias("metres"))
    return areas.select("area", "net_m").join(sums, "area", "left").select("area", F.coalesce("metres", F.lit(0)).alias("metres"), F.try_divide(F.coalesce("metres", F.lit(0)), "net_m").alias("share"))


def rides_through(placed: DataFrame, edge_rides: DataFrame, first, last) -> DataFrame:
    """area, rides: different rides through each area in a range of days."""
    days = edge_rides.filter(F.col("day").between(first, last)).select("edge", "ride").distinct()
    return days.join(placed.filter("area is not null"), "edge").select("area", "ride").distinct().groupBy("area").agg(F.count("*").alias("rides"))


def dock_partners(trips: DataFrame, first, last) -> DataFrame:
    """dock, partner, out, in, rides (cited recordings): where trips between two docks go, in a range of days. trips: a, b, day, at."""
    days = trips.filter(F.col("day").between(first, last))
    ways = days.select(F.col("a").alias("dock"), F.col("b").alias("partner"), F.lit(1).alias("o"), F.lit(0).alias("i"), "at").unionByName(days.filter("a <> b").select(F.col("b").alias("dock"), F.col("a").alias("partner"), F.lit(0).alias("o"), F.lit(1).alias("i"), "at"))
    return ways.groupBy("dock", "partner").agg(F.sum("o").alias("out"), F.sum("i").alias("in"), F.count_distinct(F.when(F.col("at") >= 0, F.col("at"))).alias("rides"))


def standing(lanes: DataFrame, day) -> DataFrame:
    """lanes, metres, ridden_m of those that stand on a day; ridden: first ridden by then. lanes: inst, ret, first, metres."""
    there = lanes.filter((F.col("inst") <= day) & (F.col("ret").isNull() | (F.col("ret") > day)))
    return there.agg(F.count("*").alias("lanes"), F.coalesce(F.sum("metres"), F.lit(0)).alias("metres"), F.coalesce(F.sum(F.when(F.col("first") <= day, F.col("metres"))), F.lit(0)).alias("ridden_m"))


def clicked(points: DataFrame, lines: DataFrame, radius: int) -> DataFrame:
    """point, fid, d: the line nearest to each point within a radius; ties to the least line."""
    size = float(radius)
    cells = lambda c: F.explode(F.sequence(F.floor((F.least(f"a{c}", f"b{c}") - size) / size), F.floor((F.greatest(f"a{c}", f"b{c}") + size) / size)))
    dealt = network.segments(lines, "fid").withColumn("cx", cells("x")).withColumn("cy", cells("y"))
    met = points.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size)).join(dealt, ["cx", "cy"])
    near = met.withColumn("d", geo.point_segment("x", "y", "ax", "ay", "bx", "by")).filter(F.col("d") <= radius)
    return near.groupBy("point").agg(F.min(F.struct("d", "fid")).alias("m")).select("point", F.col("m.fid").alias("fid"), F.col("m.d").alias("d"))


def inflation(passes: DataFrame) -> DataFrame:
    """passes, rides, ratio: how many more passes than rides the features have. passes: feature, ride, n."""
    return passes.agg(F.sum("n").alias("passes"), F.count("*").alias("rides")).withColumn("ratio", F.try_divide("passes", "rides"))


def top_share(ranked: DataFrame, value: str, n: int, order: Column) -> DataFrame:
    """share of a value that the first n rows in order hold."""
    top = ranked.orderBy(order).limit(n).agg(F.sum(value).alias("top"))
    return ranked.agg(F.sum(value).alias("whole")).join(F.broadcast(top)).select((100.0 * F.col("top") / F.col("whole")).alias("share"))


def ends_near(features: DataFrame, points: DataFrame, reach: int) -> DataFrame:
    """point, passes: length-weighted passes of features (x, y, n, metres) within reach of points."""
    pairs = joins.within(points, features, reach)
    weight = F.col("r.metres")
    return pairs.groupBy(F.col("l.point").alias("point")).agg((F.sum(F.col("r.n") * weight) / F.sum(weight)).alias("passes"))
