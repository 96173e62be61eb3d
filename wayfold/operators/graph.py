"""Busiest stretches, walked street by street, and a permutation test."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import joins, tables
from wayfold.operators.state import cut


def permutation_test(events: DataFrame, pools: DataFrame, trials: int) -> DataFrame:
    """observed (median value of all events), p (share of trials with no larger median).

    events: id, value, pool; pools: pool, value, one row a member. A trial draws one member of each event's own pool, by a
    hash of trial and event. Members are numbered by value, so a number alone says whether a draw is above the observed
    median: trials are counted where they are drawn, and no draw is shuffled. Only where just half of the draws aren't
    above are the two in the middle needed; the draws of those trials meet their members. Nulls are drawn and left out
    of a median; events whose pool is empty are left out.
    """
    sizes = pools.groupBy("pool").agg(F.count("*").alias("size"))
    observed = events.join(sizes, "pool").agg(F.median("value").alias("observed"))  # one row
    known = pools.join(F.broadcast(observed))
    places = known.groupBy("pool").agg(F.count("*").alias("size"), F.count_if(F.col("value").isNull()).alias("nulls"), F.count_if(F.col("value") <= F.col("observed")).alias("low"))
    spread = events.sparkSession.sparkContext.defaultParallelism * 4
    fit = cut(events.select("id", "pool").join(places, "pool").repartition(spread, "id"))
    at = F.pmod(F.xxhash64("trial", "id"), F.col("size"))
    drawn = fit.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials)))).withColumn("at", at)
    above = F.col("at") >= F.col("nulls") + F.col("low")
    counts = cut(drawn.groupBy("trial").agg(F.count_if(F.col("at") >= F.col("nulls")).alias("n"), F.count_if(above).alias("above")).filter("n > 0"))
    # a median is below when its upper middle is; with just half of the draws above, both middles say
    half = counts.filter("2 * above = n").select("trial")
    members = pools.select("pool", (F.row_number().over(Window.partitionBy("pool").orderBy("value")) - 1).cast("bigint").alias("at"), F.col("value").alias("drawn"))
    again = fit.join(F.broadcast(half)).select("trial", "pool", at.alias("at"))  # a trial a row, few of them
    ties = again.join(members, ["pool", "at"]).groupBy("trial").agg(F.median("drawn").alias("m"))
    below = ties.join(F.broadcast(observed)).select((F.col("m") <= F.col("observed")).alias("below"))
    clear = counts.filter("2 * above <> n").select((2 * F.col("above") < F.col("n")).alias("below"))
    return observed.join(clear.union(below).agg(F.avg(F.col("below").cast("double")).alias("p")))


def busiest_stretches(features: DataFrame, keep: float = 0.8, least_m: float = 50.0, meet: int = 6, top: int = 8) -> DataFrame:
    """The streets ridden most along a stretch: name, n (passes of its least ridden feature), metres.

    features: fid, name, points, n. Ends within ``meet`` metres are one node. A stretch begins at a street's busiest
    feature and goes on at both ends to the busiest one that has ``keep`` of its passes; one of less than ``least_m``
    gives way to the next seed. One street is walked in one task.
    """
    named = features.filter("name is not null and name <> '' and n > 0")
    tip = lambda slot, at: named.select(F.col("fid"), F.lit(slot).alias("slot"), F.element_at("points", at)["x"].alias("x"), F.element_at("points", at)["y"].alias("y"))
    tips = tip(0, 1).union(tip(1, -1)).withColumn("tip", F.col("fid") * 2 + F.col("slot"))
    met = joins.within(tips, tips, meet, F.col("l.tip") < F.col("r.tip")).select(F.col("l.tip").alias("u"), F.col("r.tip").alias("v"))
    nodes = tables.components(met).select(F.col("node").alias("tip"), "component")
    placed = tips.join(nodes, "tip", "left").select("fid", "slot", F.coalesce("component", "tip").alias("node"))
    ends = placed.groupBy("fid").agg(F.min_by("node", "slot").alias("a"), F.max_by("node", "slot").alias("b"))
    rows = named.select("fid", "name", F.col("n").cast("long").alias("n"), geo.path_length("points").alias("metres")).join(ends, "fid")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        ranked = list(group.sort_values(["n", "fid"], ascending=[False, True]).itertuples())
        around: dict = {}
        for r in ranked:
            for node in {r.a, r.b}:
                around.setdefault(node, []).append(r)
        for seed in ranked:
            stretch = {seed.fid: seed}
            for here in (seed.b, seed.a):
                while here is not None:
                    step = next((r for r in around[here] if r.fid not in stretch and r.n >= keep * seed.n), None)
                    if step is not None:
                        stretch[step.fid] = step
                        here = step.b if step.a == here else step.a
                    else:
                        here = None
            metres = sum(r.metres for r in stretch.values())
            if metres >= least_m:
                return pd.DataFrame([(group.name.iloc[0], min(r.n for r in stretch.values()), round(metres))], columns=["name", "n", "metres"])
        return pd.DataFrame({"name": pd.Series(dtype=str), "n": pd.Series(dtype="int64"), "metres": pd.Series(dtype="int64")})

    return rows.groupBy("name").applyInPandas(walk, "name string, n long, metres long").orderBy(F.desc("n"), F.desc("metres"), "name").limit(top)
