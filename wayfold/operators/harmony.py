"""What makes merged corridors look like one network: chosen alternatives, centre lines, joined ends, no small rings.

All steps read the lines as they are and write new ones, so they don't depend on the order of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import corridors, joins
from wayfold.operators.passes import vertices
from wayfold.operators.state import cut

#: Fixed values in metres: reach of an end, ends that meet, ends that move; a ring's gap, lengths and reach; rounds.
SNAP_M, MEET_M, MOVE_M, RING_GAP, RING_LEAST, RING_MOST, RING_NEAR, ROUNDS = 40, 6.0, 15.0, 15.0, 30.0, 300.0, 40, 4


def _tips(lines: DataFrame, *keys: str, places: int = 6) -> DataFrame:
    """keys, at (1 first, -1 last), x, y of both ends."""
    tip = lambda at: lines.select(*keys, F.lit(at).alias("at"), F.round(F.element_at("points", at)["x"], places).alias("x"), F.round(F.element_at("points", at)["y"], places).alias("y"))
    return tip(1).unionByName(tip(-1))


def harmonize(lines: DataFrame, alternatives: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """fid, points: each line, or the one of its alternatives (fid, alt, points) whose ends meet more ends of other lines.

    All lines choose at once, round by round, until none changes or the rounds are up.
    """
    now = cut(lines.select("fid", "points"))
    for _ in range(rounds):
        ends = _tips(now, "fid")
        counts = ends.groupBy("x", "y").agg(F.count("*").alias("n"))
        own = ends.groupBy("fid", "x", "y").agg(F.count("*").alias("own"))
        options = now.withColumn("alt", F.lit(-1).cast("bigint")).unionByName(alternatives.select("fid", "points", F.col("alt").cast("bigint").alias("alt")))
        met = _tips(options, "fid", "alt").join(counts, ["x", "y"], "left").join(own, ["fid", "x", "y"], "left")
        score = met.groupBy("fid", "alt").agg(F.count_if(F.coalesce("n", F.lit(0)) > F.coalesce("own", F.lit(0))).alias("score"))
        best = score.groupBy("fid").agg(F.max_by("alt", F.struct("score", -F.col("alt"))).alias("alt"))
        after = cut(options.join(best, ["fid", "alt"]))
        changed = after.filter("alt >= 0").join(now.withColumnRenamed("points", "was"), "fid").filter("points <> was")
        if changed.isEmpty():
            return after.select("fid", "points")
        now = after.select("fid", "points")
    return now


def centre_lines(lines: DataFrame, members: DataFrame, reach: int = corridors.REACH, places: int = 6) -> DataFrame:
    """fid, points: each vertex moved to the middle of the parallel ways of its cluster.

    members: cluster, fid, points of all lines of a cluster; lines: cluster, fid, points of its drawn ones. A vertex takes
    the nearest point within reach of every other member that runs its way there.
    """
    in_line = Window.partitionBy("fid").orderBy("i")
    before, after = F.lag(F.struct("x", "y")).over(in_line), F.lead(F.struct("x", "y")).over(in_line)
    v = vertices(lines, "fid").withColumn("p", F.coalesce(before, F.struct("x", "y"))).withColumn("q", F.coalesce(after, F.struct("x", "y")))
    dx, dy = F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")
    length = F.greatest(F.hypot(dx, dy), F.lit(1e-9))
    at = v.select("fid", "i", "x", "y", (dx / length).alias("dx"), (dy / length).alias("dy")).join(lines.select("fid", "cluster"), "fid")
    ways = corridors.samples(members).join(members.select("fid", "cluster"), "fid")
    dot = F.col("l.dx") * F.col("r.dx") + F.col("l.dy") * F.col("r.dy")
    near = joins.within(at, ways, reach, (F.col("l.cluster") == F.col("r.cluster")) & (F.col("l.fid") != F.col("r.fid")) & (dot * dot >= corridors.SAME_WAY))
    nearest = near.groupBy(F.col("l.fid").alias("fid"), F.col("l.i").alias("i"), F.col("r.fid").alias("other")).agg(F.min(F.struct("d2", F.col("r.x").alias("x"), F.col("r.y").alias("y"))).alias("s"))
    sums = nearest.groupBy("fid", "i").agg(F.sum("s.x").alias("sx"), F.sum("s.y").alias("sy"), F.count("*").alias("k"))
    moved = at.join(sums, ["fid", "i"], "left")
    mean = lambda c: F.when(F.col("k").isNull(), F.col(c)).otherwise(F.round((F.col(c) + F.col(f"s{c}")) / (F.col("k") + 1), places))
    return _lines(moved.select("fid", "i", mean("x").alias("x"), mean("y").alias("y")))


def _lines(points: DataFrame) -> DataFrame:
    return points.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def join_ends(lines: DataFrame, places: int = 6) -> DataFrame:
    """fid, points: ends that touch no other line are led to the nearest point of one within reach.

    A short gap moves the end of a line that has more than two vertices; a longer one gets a piece of its own.
    """
    dense = corridors.samples(lines, 4).select("fid", "x", "y").unionByName(_tips(lines, "fid").select("fid", "x", "y"))
    near = joins.within(_tips(lines, "fid"), dense, SNAP_M, F.col("l.fid") != F.col("r.fid")).filter(F.col("d2") < SNAP_M * SNAP_M)
    best = near.groupBy(F.col("l.fid").alias("fid"), F.col("l.at").alias("at")).agg(F.min(F.struct("d2", F.round("r.x", places).alias("x"), F.round("r.y", places).alias("y"))).alias("to")).filter(F.col("to.d2") > MEET_M * MEET_M)
    sides = best.groupBy("fid").agg(*[F.max(F.when(F.col("at") == at, F.col("to"))).alias(name) for at, name in ((1, "head"), (-1, "tail"))])
    plain = F.transform("points", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    joined = lines.select("fid", plain.alias("points")).join(sides, "fid", "left")
    moves = lambda side: F.col(side).isNotNull() & (F.col(f"{side}.d2") <= MOVE_M * MOVE_M) & (F.size("points") > 2)
    point = lambda side: F.array(F.struct(F.col(f"{side}.x").alias("x"), F.col(f"{side}.y").alias("y")))
    none = F.expr("slice(points, 1, 0)")
    lead = F.when(F.col("head").isNotNull(), point("head")).otherwise(none)
    trail = F.when(F.col("tail").isNotNull(), point("tail")).otherwise(none)
    first, last = F.when(moves("head"), 2).otherwise(1), F.when(moves("tail"), 1).otherwise(0)
    body = F.slice("points", first, F.size("points") - first - last + 1)
    return joined.select("fid", F.concat(lead, body, trail).alias("points"))


def covers(fwd: str, rev: str, held_fwd: str, held_rev: str) -> Column:
    """Passes of one ride are held by another line's: in each direction, or in all where either side is unmeasured."""
    a, b, c, d = (F.coalesce(F.col(x), F.lit(0)) for x in (fwd, rev, held_fwd, held_rev))
    unmeasured = (a + b == 0) | (c + d == 0)
    total = F.greatest(F.lit(1), c + d) >= F.greatest(F.lit(1), a + b)
    return F.col(held_fwd).isNotNull() & F.when(unmeasured, total).otherwise((c >= a) & (d >= b))


def without_rings(lines: DataFrame, rides: DataFrame) -> DataFrame:
    """Lines without the small rings whose passes all stand, way by way, on lines near them. rides: fid, ride, fwd, rev."""
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    gap, length = F.hypot(last["x"] - first["x"], last["y"] - first["y"]), geo.path_length("points")
    rings = lines.filter((gap <= RING_GAP) & length.between(RING_LEAST, RING_MOST))
    others = lines.join(rings.select("fid"), "fid", "left_anti")
    dense = corridors.samples(others, 4).select("fid", "x", "y").unionByName(_tips(others, "fid").select("fid", "x", "y"))
    near = joins.within(corridors.samples(rings).select("fid", "x", "y"), dense, RING_NEAR).select(F.col("l.fid").alias("fid"), F.col("r.fid").alias("other")).distinct()
    cx, cy = corridors.chord("points")
    ways = lines.select("fid", cx.alias("cx"), cy.alias("cy"))
    turned = near.join(ways, "fid").join(ways.select(F.col("fid").alias("other"), F.col("cx").alias("ox"), F.col("cy").alias("oy")), "other").select("fid", "other", F.expr("cx * ox + cy * oy < 0").alias("flip"))
    held = rides.select(F.col("fid").alias("other"), "ride", "fwd", "rev").join(turned, "other")
    pooled = corridors.pooled(held, "fid").select("fid", "ride", F.col("fwd").alias("held_fwd"), F.col("rev").alias("held_rev"))
    own = rides.join(rings.select("fid"), "fid", "left_semi").join(pooled, ["fid", "ride"], "left")
    kept = own.groupBy("fid").agg(F.min(F.coalesce(covers("fwd", "rev", "held_fwd", "held_rev"), F.lit(False))).alias("covered")).filter("covered")
    return lines.join(kept.select("fid"), "fid", "left_anti")


def pool_by_rule(rows: DataFrame, key: str, rule: str = "dir") -> DataFrame:
    """key, n: passes of a corridor from those of its lines (key, ride, fwd, rev).

    dir: the most of each direction, added; max: the most of a line's passes; sum: all lines' passes. One a ride at least.
    """
    f, r = F.coalesce("fwd", F.lit(0)), F.coalesce("rev", F.lit(0))
    n = {"dir": F.max(f) + F.max(r), "max": F.max(f + r), "sum": F.sum(f + r)}[rule]
    return rows.groupBy(key, "ride").agg(F.greatest(F.lit(1), n).alias("n")).groupBy(key).agg(F.sum("n").alias("n"))


def compare_rules(rows: DataFrame, key: str) -> DataFrame:
    """key, n_dir, n_max, n_sum of the corridors whose passes depend on the rule."""
    each = [pool_by_rule(rows, key, rule).withColumnRenamed("n", f"n_{rule}") for rule in ("dir", "max", "sum")]
    return each[0].join(each[1], key).join(each[2], key).filter("n_dir <> n_max or n_dir <> n_sum")
