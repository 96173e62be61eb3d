"""Readers with explicit schemas: ride CSV files, GPX, dock-trip exports, polygons, weather arrays, lane versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import text
from wayfold.operators import network as graph

RIDE_CSV = "longitude string, latitude string, timestamp string"
TRIPS_JSON = (
    "rideId string, startTimeMs string, endTimeMs string, duration bigint, rideableName string, startAddress string, endAddress string, "
    "price struct<formatted: string>, lineItems array<struct<title: string, amount: struct<formatted: string>>>"
)
FEATURES = "features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
WEATHER = "daily struct<time: array<string>, tmax: array<double>, precip: array<double>>"


def rides(spark: SparkSession, path: str) -> DataFrame:
    """ride (file name), seq, lon, lat, ts. Rows without a zoned time are dropped.

    A ride with a bad coordinate on a row with a good time is dropped whole, and so is one with fewer than two rows.
    """
    raw = spark.read.schema(RIDE_CSV).option("header", True).option("mode", "PERMISSIVE").csv(path)
    rows = raw.select(F.col("_metadata.file_name").alias("ride"), F.monotonically_increasing_id().alias("seq"), F.col("longitude").try_cast("double").alias("lon"), F.col("latitude").try_cast("double").alias("lat"), text.ride_time("timestamp").alias("ts"))
    whole = Window.partitionBy("ride")
    timed = rows.filter("ts is not null")
    checked = timed.withColumn("bad", F.max((F.col("lon").isNull() | F.col("lat").isNull()).cast("int")).over(whole)).withColumn("n", F.count("*").over(whole))
    return checked.filter("bad = 0 and n >= 2").drop("bad", "n")


def gpx(spark: SparkSession, path: str) -> DataFrame:
    """ride (file name), lon, lat, ts of track points that have all three."""
    points = spark.read.format("xml").option("rowTag", "trkpt").schema("_lat double, _lon double, time string").load(path)
    return points.select(F.input_file_name().alias("ride"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), F.try_to_timestamp(F.col("time")).alias("ts")).dropna()


def trips(spark: SparkSession, path: str) -> DataFrame:
    """Dock trips, one row for each rideId: the first wins; gross and credit from the line items."""
    raw = spark.read.schema(TRIPS_JSON).option("multiLine", True).json(path).withColumn("pos", F.monotonically_increasing_id())
    amounts = F.transform("lineItems", lambda i: text.money(i["amount"]["formatted"]))
    signed = lambda keep: F.aggregate(F.filter(amounts, keep), F.lit(0).cast("decimal(12,2)"), lambda s, x: (s + x).cast("decimal(12,2)"))
    shaped = raw.select(
        F.col("rideId").alias("id"),
        "pos",
        F.col("startTimeMs").cast("bigint").alias("t"),
        F.col("duration").alias("dur"),
        text.plain_name("startAddress").alias("a"),
        text.plain_name("endAddress").alias("b"),
        text.vehicle_id("rideableName").alias("bike"),
        text.money(F.col("price.formatted")).alias("paid"),
        F.coalesce(signed(lambda x: x > 0), F.lit(0)).alias("gross"),
        F.coalesce(-signed(lambda x: x < 0), F.lit(0)).alias("credit"),
        F.exists(F.coalesce("lineItems", F.array()), lambda i: F.contains(F.regexp_replace(F.lower(i["title"]), "e-bike", "ebike"), F.lit("ebike"))).alias("ebike"),
    )
    first = shaped.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).filter("id is not null and k = 1")
    return first.drop("k", "pos")


def rings(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """area, ring, ax, ay, bx, by: the edges of (multi)polygons in a feature collection, for areas.inside."""
    found = spark.read.schema(FEATURES).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    shape = "array<array<array<array<double>>>>"
    parsed = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json(F.col("f.geometry.coordinates"), "array<array<array<double>>>"))).otherwise(F.from_json(F.col("f.geometry.coordinates"), shape))
    ring = found.select(F.element_at("f.properties", name).alias("area"), F.explode(F.flatten(parsed)).alias("points")).withColumn("ring", F.monotonically_increasing_id())
    edge = ring.select("area", "ring", F.explode(F.expr("zip_with(slice(points, 1, size(points) - 1), slice(points, 2, size(points) - 1), (p, q) -> struct(p[0] as ax, p[1] as ay, q[0] as bx, q[1] as by))")).alias("e"))
    return edge.select("area", "ring", "e.*")


def weather(spark: SparkSession, path: str) -> DataFrame:
    """day, tmax, precip: days without a temperature are dropped, missing rain is none."""
    days = spark.read.schema(WEATHER).option("multiLine", True).json(path).select(F.explode(F.arrays_zip("daily.time", "daily.tmax", "daily.precip")).alias("d"))
    return days.select(F.to_date(F.col("d.time")).alias("day"), F.col("d.tmax").alias("tmax"), F.coalesce("d.precip", F.lit(0.0)).alias("precip")).filter("tmax is not null")


def ride_name(ts: Column, zone: str = "America/New_York") -> Column:
    """The file name of a ride that starts at a UTC time: local clock and offset."""
    local = F.from_utc_timestamp(ts, zone)
    minutes = F.timestamp_diff("MINUTE", ts, local)
    sign = F.when(minutes < 0, "-").otherwise("+")
    size = F.abs(minutes)
    return F.concat(F.date_format(local, "yyyy-MM-dd_HH-mm-ss"), F.lit("_"), sign, F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lpad((size % 60).cast("string"), 2, "0"), F.lit(".csv"))


def ride_ends(fixes: DataFrame) -> DataFrame:
    """ride, lon0, lat0, lon1, lat1: first and last fix of rides with two fixes at least. fixes: ride, seq, lon, lat."""
    at = F.struct("lon", "lat")
    ends = fixes.groupBy("ride").agg(F.min_by(at, "seq").alias("a"), F.max_by(at, "seq").alias("b"), F.count("*").alias("n")).filter("n >= 2")
    return ends.select("ride", F.col("a.lon").alias("lon0"), F.col("a.lat").alias("lat0"), F.col("b.lon").alias("lon1"), F.col("b.lat").alias("lat1"))


#: Kinds of activities without a street.
INDOOR = ("indoor_cycling", "virtual_ride")


def outdoor(activities: DataFrame) -> DataFrame:
    """Activities with an id that aren't indoors; those of unknown kind stay."""
    return activities.filter(F.col("id").isNotNull() & ~F.coalesce(F.col("type").isin(*INDOOR), F.lit(False)))


def new_rides(listed: DataFrame, processed: DataFrame, skipped: DataFrame, sample: int | None = None) -> DataFrame:
    """Rides of a listing that were neither processed nor skipped; a sample is the first of them by name."""
    left = listed.join(processed.select("ride"), "ride", "left_anti").join(skipped.select("ride"), "ride", "left_anti")
    return left.orderBy("ride").limit(sample) if sample else left


def stations(spark: SparkSession, path: str) -> DataFrame:
    """name, lon, lat of a station feed; stations without a name or a place are left out."""
    shape = "data struct<stations: array<struct<name: string, lat: double, lon: double>>>"
    rows = spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("data.stations").alias("s")).select("s.name", "s.lon", "s.lat")
    return rows.filter("name is not null and name <> '' and lon is not null and lat is not null")


def lanes(spark: SparkSession, path: str) -> DataFrame:
    """The columns that lanes.normalised takes, of a feature collection of lines and multi-lines."""
    found = spark.read.schema(FEATURES).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    point = lambda line: F.transform(line, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    one = F.array(point(F.from_json("f.geometry.coordinates", "array<array<double>>")))
    many = F.transform(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"), point)
    parts = F.when(F.col("f.geometry.type") == "LineString", one).when(F.col("f.geometry.type") == "MultiLineString", many)
    names = ("bikeid", "prevbikeid", "facilitycl", "ft_facilit", "tf_facilit", "instdate", "ret_date", "street")
    return found.select(*[F.col("f.properties")[n].alias(n) for n in names], parts.alias("parts"))


def trip_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The cached trips; None where the file is of another format or holds none."""
    shape = "format int, trips array<struct<id: string, t: bigint, dur: bigint, a: string, b: string, bike: string, paid: double, gross: double, credit: double, ebike: boolean>>"
    rows = spark.read.schema(shape).option("multiLine", True).json(path).filter("format = 2").select(F.explode("trips").alias("t")).select("t.*")
    return None if rows.isEmpty() else rows


def export_rides(spark: SparkSession, path: str) -> DataFrame:
    """day, miles: of a map export, whose rides cite days by index; a ride without a distance counts none."""
    shape = "properties struct<dates: array<string>, rides: array<array<string>>>"
    head = spark.read.schema(shape).option("multiLine", True).json(path).select("properties.*")
    rides = head.select("dates", F.explode("rides").alias("r"))
    day = F.to_date(F.element_at("dates", F.element_at("r", 1).cast("int") + 1))
    return rides.groupBy(day.alias("day")).agg(F.sum(F.coalesce(F.element_at("r", 3).try_cast("double"), F.lit(0.0)) * 0.621371).alias("miles"))


def fitted_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(stops: line, place, station; stations: id, name, x, y, n) of a fitted network's file; compressed files are read as they are."""
    shape = "stations array<struct<near: string, at: array<double>, n: bigint>>, lines array<array<bigint>>"
    head = spark.read.schema(shape).option("multiLine", True).json(path)
    stops = head.select(F.posexplode("lines").alias("line", "s")).select("line", F.posexplode("s").alias("place", "station"))
    listed = head.select(F.posexplode("stations").alias("id", "s"))
    return stops, listed.select(F.col("id").cast("bigint").alias("id"), F.col("s.near").alias("name"), F.col("s.at")[0].alias("x"), F.col("s.at")[1].alias("y"), F.col("s.n").alias("n"))


def network(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of several networks (folders with nodes and edges tables) as one, without edges that others cover."""
    nodes = graph.compose(*[spark.read.parquet(f"{p}/nodes") for p in paths], keys=("id",))
    edges = graph.compose(*[spark.read.parquet(f"{p}/edges") for p in paths])
    return nodes, graph.without_subsumed(nodes, edges)


#: The banner of a cached answer, and the tag that only one network's answers hold.
BANNER = '"generator": "Overpass'
MARKERS = {"walk": "footway", "drive": "motorway", "bike": "cycleway"}
SLICE = 1 << 20


def responses(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, fingerprint: cached answers by the tag they hold most of, the newest of each fingerprint.

    Files without the banner or any of the tags are left out. The fingerprint is of the size and of a mebibyte from a
    third and from the middle on, so the time in an answer's head doesn't count.
    """
    files = spark.read.format("binaryFile").load(path)
    body = F.decode("content", "UTF-8")
    counted = F.array(*[F.struct(F.regexp_count(body, F.lit(f'"highway":\\s*"{tag}"')).alias("n"), F.lit(kind).alias("kind")) for kind, tag in MARKERS.items()])
    piece = lambda part: F.expr(f"if(length div {part} + {SLICE} <= length, substring(content, int(length div {part}) + 1, {SLICE}), binary(''))")
    print_ = F.sha2(F.concat(F.col("length").cast("string").cast("binary"), piece(3), piece(2)), 256).alias("fingerprint")
    marked = files.filter(F.contains(F.substring(body, 1, 200), F.lit(BANNER))).select("path", "modificationTime", F.array_max(counted).alias("most"), print_).filter("most.n > 0")
    newest = Window.partitionBy("fingerprint").orderBy(F.desc("modificationTime"), "path")
    return marked.withColumn("k", F.row_number().over(newest)).filter("k = 1").select("path", "most.kind", "fingerprint")
