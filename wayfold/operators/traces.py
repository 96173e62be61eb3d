"""Ordered operators over the fixes of a ride: columns ride, seq, x, y (metres) and t (seconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(*keys: str, by: tuple[str, ...] = ("seq",)):
    return Window.partitionBy(*keys).orderBy(*by)


def with_steps(fixes: DataFrame, keys: tuple[str, ...] = ("ride",)) -> DataFrame:
    """Each fix with the distance and time from the one before it."""
    w = in_order(*keys)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return fixes.withColumn("step", step).withColumn("dt", F.col("t") - F.lag("t").over(w))


def islands(rows: DataFrame, keys: tuple[str, ...], starts: Column, name: str = "segment", by: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Number the runs that begin where ``starts`` holds."""
    w = in_order(*keys, by=by).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def split_at_gaps(fixes: DataFrame, most_m: float | None = 300, most_s: float | None = None) -> DataFrame:
    """Segments of a ride, cut where the step is longer than ``most_m`` or lasts longer than ``most_s``."""
    cut = F.lit(False)
    if most_m is not None:
        cut = cut | (F.col("step") > most_m)
    if most_s is not None:
        cut = cut | (F.col("dt") > most_s)
    return islands(with_steps(fixes), ("ride",), F.coalesce(cut, F.lit(False)))


def resample(fixes: DataFrame, spacing: float = 20, keys: tuple[str, ...] = ("ride",)) -> DataFrame:
    """Points every ``spacing`` metres along each trace, from its start, its end excluded.

    A trace shorter than the spacing keeps its first and last fix; one with a single fix keeps it.
    """
    w = in_order(*keys)
    whole = Window.partitionBy(*keys)
    run = with_steps(fixes, keys).withColumn("d0", F.sum(F.coalesce("step", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("d1", F.lead("d0").over(w)).withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("y").over(w))
    run = run.withColumn("total", F.max("d0").over(whole)).withColumn("first_seq", F.min("seq").over(whole))
    short = (F.col("total") < spacing) & ((F.col("seq") == F.col("first_seq")) | F.col("d1").isNull())
    ends = run.filter(short).select(*keys, F.when(F.col("seq") == F.col("first_seq"), 0).otherwise(1).cast("long").alias("k"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    lo, hi = F.ceil(F.col("d0") / spacing), F.ceil(F.col("d1") / spacing) - 1
    spans = run.filter((F.col("total") >= spacing) & (F.col("d1") > F.col("d0")) & (hi >= lo)).withColumn("k", F.explode(F.sequence(lo, hi)))
    part = (F.col("k") * spacing - F.col("d0")) / (F.col("d1") - F.col("d0"))
    between = spans.select(*keys, "k", (F.col("x") + part * (F.col("x1") - F.col("x"))).alias("x"), (F.col("y") + part * (F.col("y1") - F.col("y"))).alias("y"))
    return between.unionByName(ends)


def outside_runs(fixes: DataFrame, inside: Column) -> DataFrame:
    """Maximal runs of fixes outside a box, each with the fix before and after it."""
    marked = fixes.withColumn("inside", inside)
    w = in_order("ride")
    marked = marked.withColumn("was", F.lag("inside").over(w)).withColumn("will", F.lead("inside").over(w))
    runs = islands(marked, ("ride",), ~F.col("inside") & F.coalesce("was", F.lit(True)), "run")
    out = runs.filter(~F.col("inside")).groupBy("ride", "run").agg(F.count("*").alias("n_out"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.max(F.coalesce("was", F.lit(False)).cast("int")).alias("padded_before"), F.max(F.coalesce("will", F.lit(False)).cast("int")).alias("padded_after"))
    return out


def edge_runs(assigned: DataFrame, most_s: float = 30, most_m: float = 300) -> DataFrame:
    """Contiguous fixes on one edge (column slot, -1 for none): cut at a new edge and at bad steps; two fixes at least."""
    w = in_order("ride")
    cut = (F.lag("slot").over(w) != F.col("slot")) | F.lag("slot").over(w).isNull() | (F.col("dt") <= 0) | (F.col("dt") > most_s) | (F.col("step") > most_m)
    rows = with_steps(assigned).withColumn("cut", F.coalesce(cut, F.lit(False)))
    runs = islands(rows, ("ride",), F.col("cut"), "run").filter("slot <> -1")
    return runs.groupBy("ride", "run", "slot").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last")).filter("n >= 2")


def ride_stats(fixes: DataFrame) -> DataFrame:
    """Start, duration and distance of each ride with two fixes at least."""
    sums = with_steps(fixes).groupBy("ride").agg(F.count("*").alias("n"), F.min("t").alias("start"), (F.max_by("t", "seq") - F.min_by("t", "seq")).alias("duration"), F.sum("step").alias("distance"))
    return sums.filter("n >= 2")


def any_inside(fixes: DataFrame, inside: Column) -> DataFrame:
    """All fixes of rides of which any fix is inside."""
    return fixes.join(fixes.filter(inside).select("ride").distinct(), "ride", "left_semi")


def local_maxima(rows: DataFrame, key: str, value: str, reach: int = 3) -> DataFrame:
    w = in_order(key).rowsBetween(-reach, reach)
    return rows.withColumn("peak", F.max(value).over(w)).filter((F.col(value) > 0) & (F.col(value) >= F.col("peak"))).drop("peak")


def headings(fixes: DataFrame, reach: int = 3, least_m: float = 5) -> DataFrame:
    """Displacement over the neighbours ``reach`` before and after, clamped at the ends; moved says if it is long enough."""
    w = in_order("ride").rowsBetween(-reach, reach)
    dx, dy = F.last("x").over(w) - F.first("x").over(w), F.last("y").over(w) - F.first("y").over(w)
    return fixes.withColumn("dx", dx).withColumn("dy", dy).withColumn("moved", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") > least_m * least_m)
