"""Set operations, dedupe, ranking and summaries over plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.state import cut


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each non-null key, the first in order. Combined on the map side, so copies of a key don't meet."""
    rest = [c for c in rows.columns if c != key]
    picked = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("row"))
    return picked.select(key, *[F.col(f"row.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of both, new values before old ones, with what became of each."""
    o = old.select(key, *[F.col(c).alias(f"o_{c}") for c in columns], F.lit(True).alias("o_"))
    n = new.select(key, *[F.col(c).alias(f"n_{c}") for c in columns], F.lit(True).alias("n_"))
    state = F.when(F.col("o_").isNull(), "added").when(F.col("n_").isNull(), "kept").otherwise("replaced")
    return o.join(n, key, "full_outer").select(key, *[F.when(F.col("n_").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in columns], state.alias("state"))


def numbered(rows: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """Rows with their number (from 0) in order, over the whole table.

    Rows are dealt into ranges, numbered inside each, and moved on by the sizes of the ranges before: no task holds more
    than a range. Equal rows fall into one range.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    sizes = dealt.groupBy("range_").agg(F.count("*").alias("size_"))
    before = sizes.select("range_", F.coalesce(F.sum("size_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    inside = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    return dealt.withColumn("in_", inside).join(F.broadcast(before), "range_").withColumn(name, F.col("before_") + F.col("in_") - 1).drop("range_", "in_", "before_")


def striped(rows: DataFrame, n: int, size: str = "size", key: str = "ride") -> DataFrame:
    """Rows with stripe (0 to n - 1), dealt in turn from the largest on, so that stripes are alike."""
    ranked = numbered(rows.withColumn("neg_", -F.col(size)), "neg_", key, name="rank_")
    return ranked.withColumn("stripe", (F.col("rank_") % n).cast("int")).drop("neg_", "rank_")


def dictionary(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values and their index in sorted order, numbered by ranges."""
    return numbered(rows.select(column).distinct(), column).withColumn("index", F.col("index").cast("int"))


def quantiles(rows: DataFrame, key: str, value: str, fractions: list[float]) -> DataFrame:
    """key, fraction, quantile: interpolated as the values between the two nearest ranks. Nulls are left out.

    Values are numbered in order of key and value over the whole table, by ranges; the rows at the wanted places are
    then joined by number, so a key with most of the rows is as many tasks as its ranges.
    """
    placed = cut(numbered(rows.filter(F.col(value).isNotNull()).select(key, value), key, value, name="number"))
    groups = placed.groupBy(key).agg(F.min("number").alias("first"), F.count("*").alias("n"))
    at = groups.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions)))).withColumn("place", F.col("fraction") * (F.col("n") - 1))
    ends = at.select(key, "fraction", "place", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank"), "first").withColumn("number", F.col("first") + F.col("rank"))
    met = ends.join(placed.select("number", F.col(value).cast("double").alias("v")), "number")
    weight = F.when(F.floor("place") == F.ceil("place"), 1.0).otherwise(1 - F.abs(F.col("place") - F.col("rank")))
    return met.groupBy(key, "fraction").agg(F.sum(F.col("v") * weight).alias("quantile"))


def top_per_group(rows: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def dense(rows: DataFrame, key: str, low: int, high: int, counts: list[str]) -> DataFrame:
    """Rows for every key from low to high, missing counts as 0."""
    every = rows.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(key))
    return every.join(rows, key, "left").fillna(0, counts)


def order_statistic(rows: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """The value at a position (an expression of n, the group's size, from 1) of each group's sorted values."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy(value)))
    return ranked.filter(F.col("k") == F.expr(position)).select(*keys, value, "n")


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """node, component (least node reached) by pointer jumping over least neighbours; checkpoints each round."""
    both = cut(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c"))
    for _ in range(most):
        near = both.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("c").alias("m"))
        step = label.join(near, "u").select("u", F.least("c", "m").alias("c"))
        jump = step.alias("a").join(step.select(F.col("u").alias("c"), F.col("c").alias("cc")), "c").select("u", F.least("c", "cc").alias("c"))
        after = cut(jump)
        if after.join(label.withColumnRenamed("c", "old"), "u").filter("c <> old").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("c").alias("component"))
        label = after
    raise RuntimeError("components did not settle")
