"""Sinks: feature rows as JSON lines, the map's export, the trip cache, and shades for drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import tables


def features(rows: DataFrame, geometry: str = "points", places: int = 5) -> DataFrame:
    """One GeoJSON feature a row (column value): a line of rounded points with all other columns as properties."""
    others = [c for c in rows.columns if c != geometry]
    points = F.transform(geometry, lambda p: F.array(F.round(p["x"], places), F.round(p["y"], places)))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), points.alias("coordinates")).alias("geometry"), F.struct(*others).alias("properties"))
    return rows.select(F.to_json(feature).alias("value"))


def write_features(rows: DataFrame, path: str, **options) -> None:
    """Features as gzip JSON lines, written in parallel."""
    features(rows, **options).write.mode("overwrite").option("compression", "gzip").text(path)


def export_parts(lines: DataFrame, passes: DataFrame, rides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(properties: one JSON row; features: JSON rows, fewest passes first) of the map's export.

    lines: fid, points, n, name; passes: fid, ride, fwd, rev; rides: ride (names in order of time), day, clock, km.
    Rides and days are encoded by index; a feature lists the index of a ride once for each pass, once at least.
    """
    days = tables.dictionary(rides, "day")
    coded = tables.dictionary(rides, "ride").join(rides, "ride").join(F.broadcast(days.withColumnRenamed("index", "date")), "day")
    times = F.greatest(F.lit(1), F.coalesce("fwd", F.lit(0)) + F.coalesce("rev", F.lit(0)))
    listed = passes.join(coded.select("ride", "index"), "ride").groupBy("fid").agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat("index", times.cast("int"))))).alias("rides"))
    shown = lines.join(listed, "fid")
    top = shown.agg(F.max(F.struct("n", "fid", "name", F.element_at("points", F.floor(F.size("points") / 2).cast("int") + 1).alias("at"))).alias("top"))
    head = coded.agg(
        F.count("*").alias("total_rides"),
        F.transform(F.array_sort(F.collect_list(F.struct("index", "date", "clock", "km"))), lambda r: F.struct(r["date"], r["clock"], r["km"])).alias("rides"),
        F.array_sort(F.collect_set(F.col("day").cast("string"))).alias("dates"),
    )
    both = head.join(top.select(F.col("top.n").alias("max_count"), F.struct(F.col("top.name").alias("name"), F.col("top.at.x").alias("x"), F.col("top.at.y").alias("y")).alias("top_segment")))
    return both.select(F.to_json(F.struct("*")).alias("value")), features(shown.orderBy("n", "fid").select("points", "name", "rides"))


def write_trips(trips: DataFrame, docks: DataFrame, path: str, source: str) -> None:
    """The trip cache as tables: trips and docks, with the export's name."""
    trips.withColumn("source", F.lit(source)).write.mode("overwrite").parquet(f"{path}/trips")
    docks.write.mode("overwrite").parquet(f"{path}/docks")


def shades(features: DataFrame, view: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Features (fid, points, n) with shade, the root of n over the most, rare ones first; a view keeps those inside it.

    The scale is that of all features, whatever the view shows.
    """
    top = features.agg(F.max("n").alias("top"))  # one row
    shaded = features.join(F.broadcast(top)).withColumn("shade", F.sqrt(F.col("n") / F.col("top"))).drop("top")
    if view:
        west, south, east, north = view
        shaded = shaded.filter(F.exists("points", lambda p: p["x"].between(west, east) & p["y"].between(south, north)))
    return shaded.orderBy("n", "fid")
