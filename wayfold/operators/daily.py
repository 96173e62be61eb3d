"""Summaries by day, band and year: riding, weather, and what a reader of the map asks of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators import tables

#: Fahrenheit and inch borders of the weather bands, least ride days of a summary, and miles of a kilometre.
TEMPERATURE, RAIN, LEAST_DAYS, MILES = (-100, 32, 50, 65, 80, 200), (0, 0.04, 0.2, 100), 10, 0.621371


def riding(stats: DataFrame) -> DataFrame:
    """One row: rides, km, hours, kmh, longest, by_hour (24), by_weekday (7, Monday first), by_year (map of km).

    stats: start (timestamp in local time), duration (s, may be null or 0), dist (m). Rides without a start or distance
    are left out; the speed is all kilometres over all hours.
    """
    known = stats.filter("start is not null and dist is not null").withColumn("km", F.col("dist") / 1000)
    once = known.agg(
        F.count("*").alias("rides"), F.sum("km").alias("km"), F.sum("duration").alias("seconds"), F.max("km").alias("longest")
    )
    counts = lambda column, last, name: tables.dense(known.groupBy(column.alias("k")).agg(F.count("*").alias("n")), "k", 0, last, ["n"]).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda r: r["n"]).alias(name))
    years = known.groupBy(F.year("start").alias("y")).agg(F.round(F.sum("km"), 1).alias("km")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("y", "km")))).alias("by_year"))
    every = once.join(counts(F.hour("start"), 23, "by_hour")).join(counts(F.weekday("start"), 6, "by_weekday")).join(years)
    speed = F.round(F.try_divide("km", F.col("seconds") / 3600), 1)
    return every.filter("rides > 0").select("rides", F.round("km", 1).alias("km"), F.round(F.col("seconds") / 3600, 1).alias("hours"), speed.alias("kmh"), F.round("longest", 1).alias("longest"), "by_hour", "by_weekday", "by_year")


def weather_bands(weather: DataFrame, ridden: DataFrame, band, n_bands: int) -> DataFrame:
    """band, days, ride_days, miles of every band from 0 on, with its ride days' share of all and the share its days would give.

    weather: day and what band (a column expression) reads; ridden: day, miles, one row a day with rides.
    """
    days = weather.join(ridden, "day", "left").withColumn("band", band)
    sums = days.groupBy("band").agg(F.count("*").alias("days"), F.count("miles").alias("ride_days"), F.sum(F.coalesce("miles", F.lit(0.0))).alias("miles"))
    every = tables.dense(sums, "band", 0, n_bands - 1, ["days", "ride_days", "miles"])
    whole = Window.partitionBy()  # a row a band
    share = lambda c: F.try_divide(F.lit(100.0) * F.col(c), F.sum(c).over(whole))
    return every.select("*", share("ride_days").alias("share"), share("days").alias("expected"), F.coalesce(F.try_divide(F.lit(100.0) * F.col("ride_days"), "days"), F.lit(0.0)).alias("pct"), F.coalesce(F.try_divide("miles", "ride_days"), F.lit(0.0)).alias("avg_miles"))


def weather_summary(weather: DataFrame, ridden: DataFrame, band, n_bands: int, least: int = LEAST_DAYS) -> DataFrame:
    """weather_bands rounded to one place; empty where fewer than ``least`` days were ridden."""
    bands = weather_bands(weather, ridden, band, n_bands)
    enough = F.sum("ride_days").over(Window.partitionBy()) >= least
    rounded = [F.round(c, 1).alias(c) for c in ("miles", "share", "expected", "pct", "avg_miles")]
    return bands.withColumn("enough", enough).filter("enough").select("band", "days", "ride_days", *rounded)


def weather_note(bands: DataFrame, least: float | None = 0.05) -> DataFrame:
    """The band whose share of ride days is farthest from what its days would give, if it is more than ``least`` of that off; None asks for any."""
    off = bands.filter("expected > 0").withColumn("off", F.col("share") / F.col("expected") - 1)
    top = off.agg(F.max_by(F.struct("band", "off"), F.struct(F.abs("off"), -F.col("band"))).alias("top"))
    found = top.filter("top is not null").select("top.*")
    return found if least is None else found.filter(F.abs("off") > least)


def coverage(edges: DataFrame, rides: DataFrame) -> DataFrame:
    """One row: network, ridden (metres of covered edges), pct, by_year (metres new in each), excluded (ridden metres by tag).

    edges: edge, metres, tag, covered; rides: edge, first (day).
    """
    every = edges.join(rides, "edge", "left")
    seen = F.col("first").isNotNull()
    once = every.filter("covered").agg(F.sum("metres").alias("network"), F.sum(F.when(seen, F.col("metres")).otherwise(0)).alias("ridden"))
    years = every.filter(F.col("covered") & seen).groupBy(F.year("first").alias("y")).agg(F.sum("metres").alias("m")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("y", "m")))).alias("by_year"))
    tags = every.filter(~F.col("covered") & seen).groupBy("tag").agg(F.sum("metres").alias("m"))
    listed = tags.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("o"), "tag", "m"))), lambda r: F.struct(r["tag"], r["m"])).alias("excluded"))
    return once.join(years).join(listed).withColumn("pct", F.round(F.try_divide(F.lit(100.0) * F.col("ridden"), "network"), 1))


def time_lapse(passes: DataFrame) -> DataFrame:
    """feature, day, n (passes up to the day), shade (root of n over the full history's most): a frame for each day with a pass.

    passes: feature, day, n.
    """
    by_day = passes.groupBy("feature", "day").agg(F.sum("n").alias("n"))
    running = by_day.withColumn("n", F.sum("n").over(Window.partitionBy("feature").orderBy("day")))
    top = running.agg(F.max("n").alias("top"))  # one row
    return running.join(F.broadcast(top)).select("feature", "day", "n", F.sqrt(F.col("n") / F.col("top")).alias("shade"))


def year_recap(rides: DataFrame) -> DataFrame:
    """year, rides, km, change (per cent), longest, month, weekday, hour (each the busiest, ties to the earlier).

    rides: start (local timestamp), km.
    """
    rows = rides.withColumn("year", F.year("start"))
    busiest = lambda column, name: rows.groupBy("year", column.alias("k")).agg(F.count("*").alias("n")).groupBy("year").agg(F.max_by("k", F.struct("n", -F.col("k"))).alias(name))
    sums = rows.groupBy("year").agg(F.count("*").alias("rides"), F.sum("km").alias("km"), F.max("km").alias("longest"))
    before = F.lag("km").over(Window.orderBy("year"))  # a row a year
    sums = sums.withColumn("change", F.try_divide(F.lit(100.0) * (F.col("km") - before), before))
    return sums.join(busiest(F.month("start"), "month"), "year").join(busiest(F.weekday("start"), "weekday"), "year").join(busiest(F.hour("start"), "hour"), "year")


def month_calendar(rides: DataFrame) -> DataFrame:
    """year, month, rides, km, shade (root of rides over the most) of every month from January of the first year to the last's December."""
    months = rides.groupBy(F.year("start").alias("year"), F.month("start").alias("month")).agg(F.count("*").alias("rides"), F.sum("km").alias("km"))
    years = months.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("year"))
    every = years.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    filled = every.join(months, ["year", "month"], "left").fillna(0, ["rides", "km"])
    return filled.withColumn("shade", F.sqrt(F.col("rides") / F.max("rides").over(Window.partitionBy())))


def converted(rankings: DataFrame, miles: bool = True) -> DataFrame:
    """Rankings with kmh and m as mph and miles."""
    factor = MILES if miles else 1.0
    return rankings.select(*[F.round(F.col(c) * factor, 1).alias("mph") if c == "kmh" else F.round(F.col(c) / 1000 * factor, 2).alias("miles") if c == "m" else F.col(c) for c in rankings.columns])
