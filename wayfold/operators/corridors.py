"""Corridor merging: parallel lines of one corridor are drawn once and carry the passes of all of them.

Lines are sampled and the samples joined by grid cell. From shares of aligned samples follow classes of lines that
cover each other; a class keeps the lines that draw its extent, and lines that busier ones cover are absorbed. Only
sample indexes and one number of passes a line reach the grouped steps, which work on one class or one component of
touching lines at a time. Passes themselves are moved by joins and combined on the map side.

Lines of the same points are one shape: their samples touch the same lines, so one of them is sampled and compared for all,
with their number; of equal lines the one with most passes is drawn.

Absorption compares passes as they are after the classes are merged; what a line receives on the way doesn't count.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import joins, tables
from wayfold.operators.state import cut

STEP, REACH, SAME_WAY = 8, 20, 0.75  # metres, metres, square of the cosine of 30 degrees
MUTUAL, EXTENT, ABSORB, TRANSFER = 0.75, 0.97, 0.95, 0.80
SENT = 200_000  # rows of a table that goes to every task


def shapes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row a shape: fid of the line that stands for it, points, m lines, least fid; fid, shape of all lines).

    lines: fid, points and passes n; the line of most passes stands, of equal ones the least.
    """
    dealt = lines.select("fid", "points", "n")
    found = cut(dealt.groupBy("points").agg(F.min(F.struct((-F.col("n")).alias("o"), "fid"))["fid"].alias("fid"), F.count("*").alias("m"), F.min("fid").alias("least")))
    return found, cut(dealt.join(found.select("points", F.col("fid").alias("shape")), "points").select("fid", "shape"))


def samples(lines: DataFrame, step: float = STEP) -> DataFrame:
    """fid, k, x, y and the direction dx, dy of points every ``step`` along lines (fid, points of x, y), from their start."""
    segments = lines.select("fid", F.posexplode(F.expr("transform(sequence(1, size(points) - 1), i -> struct(points[i - 1] as a, points[i] as b))")).alias("i", "s"))
    flat = segments.select("fid", "i", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    flat = flat.withColumn("len", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).filter("len > 0")
    d1 = F.sum("len").over(Window.partitionBy("fid").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    spans = flat.withColumn("d1", d1).withColumn("d0", F.col("d1") - F.col("len"))
    spans = spans.withColumn("low", F.ceil(F.col("d0") / step)).withColumn("high", F.ceil(F.col("d1") / step) - 1).filter("high >= low")
    along = (F.col("k") * step - F.col("d0")) / F.col("len")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    dealt = spans.withColumn("k", F.explode(F.sequence("low", "high")))
    return dealt.select("fid", "k", (F.col("ax") + along * dx).alias("x"), (F.col("ay") + along * dy).alias("y"), (dx / F.col("len")).alias("dx"), (dy / F.col("len")).alias("dy"))


def touches(points: DataFrame, reach: int = REACH) -> DataFrame:
    """fid, k, other: each sample with the other lines that run its way within reach."""
    dot = F.col("l.dx") * F.col("r.dx") + F.col("l.dy") * F.col("r.dy")
    pairs = joins.within(points, points, reach, (F.col("l.fid") != F.col("r.fid")) & (dot * dot >= SAME_WAY))
    return pairs.select(F.col("l.fid").alias("fid"), F.col("l.k").alias("k"), F.col("r.fid").alias("other")).distinct()


def shares(points: DataFrame, near: DataFrame) -> DataFrame:
    """fid, other, share: the part of a line's samples that lie along the other."""
    n = points.groupBy("fid").agg(F.count("*").alias("n"))
    return near.groupBy("fid", "other").agg(F.count("*").alias("hit")).join(n, "fid").select("fid", "other", (F.col("hit") / F.col("n")).alias("share"))


def classes(lines: DataFrame, share: DataFrame) -> DataFrame:
    """fid, cluster (its least line): lines that cover each other, by connection."""
    back = share.select(F.col("fid").alias("other"), F.col("other").alias("fid"), F.col("share").alias("back"))
    links = share.join(back, ["fid", "other"]).filter((F.col("share") >= MUTUAL) & (F.col("back") >= MUTUAL) & (F.col("fid") < F.col("other")))
    found = tables.components(links.select(F.col("fid").alias("u"), F.col("other").alias("v"))).select(F.col("node").alias("fid"), F.col("component").alias("cluster"))
    return lines.select("fid").join(found, "fid", "left").select("fid", F.coalesce("cluster", "fid").alias("cluster"))


def chord(points: str) -> tuple[Column, Column]:
    ends = F.element_at(points, -1), F.element_at(points, 1)
    return ends[0]["x"] - ends[1]["x"], ends[0]["y"] - ends[1]["y"]


def _turned(rows: DataFrame) -> DataFrame:
    """Passes of rows (.., fwd, rev, flip) in the direction of the line that takes them; null counts as none."""
    f, r = F.coalesce("fwd", F.lit(0)), F.coalesce("rev", F.lit(0))
    return rows.withColumn("f", F.when(F.col("flip"), r).otherwise(f)).withColumn("r", F.when(F.col("flip"), f).otherwise(r))


def pooled(rows: DataFrame, key: str) -> DataFrame:
    """The most passes of a ride in each direction; two lines of a corridor see the same pass, not two."""
    return _turned(rows).groupBy(key, "ride").agg(F.max("f").alias("fwd"), F.max("r").alias("rev"))


def passes(rows: DataFrame, key: str) -> DataFrame:
    """Passes of each line: both directions of every ride, at least one a ride."""
    return rows.groupBy(key).agg(F.sum(F.greatest(F.lit(1), F.col("fwd") + F.col("rev"))).alias("n"))


def _draw(group: pd.DataFrame) -> pd.DataFrame:
    """The lines of a class that draw its extent: busiest first, without those that the drawn ones mostly cover."""
    rows = group.sort_values(["n", "chord", "fid"], ascending=[False, False, True])
    own = {r.fid: {(r.fid, k) for k in range(r.size)} for r in rows.itertuples()}
    m = dict(zip(rows.fid, rows.m, strict=True))  # lines of its shape
    near: dict = {fid: set() for fid in own}  # samples of any line within reach of this one
    aligned: dict = {fid: {} for fid in own}
    for r in rows.itertuples():
        for k, others in zip(r.ks, r.others, strict=True):
            aligned[r.fid][k] = set(others)
            for other in others:
                near[other].add((r.fid, k))
    extent = sum(len(o) * m[fid] for fid, o in own.items())
    drawn, seen, held = [], set(), 0
    for fid in own:
        if drawn and held >= EXTENT * extent:
            break
        again = sum(not other.isdisjoint(drawn) for other in aligned[fid].values()) >= MUTUAL * len(own[fid])
        gain = (own[fid] | near[fid]) - seen
        if not drawn or gain and not again:
            drawn.append(fid)
            seen |= gain
            held += sum(m[f] for f, _ in gain)
    return pd.DataFrame({"cluster": rows.cluster.iloc[0], "fid": drawn})


def _absorb(group: pd.DataFrame) -> pd.DataFrame:
    """Which drawn line takes the passes of which: a line goes if lines with half its passes or more cover it."""
    lines = {r.fid: r for r in group.sort_values(["n", "size", "fid"], ascending=[True, False, True]).itertuples()}
    along = {fid: [{o for o in others} for others in r.others] for fid, r in lines.items()}
    on = {fid: pd.Series([o for others in along[fid] for o in others], dtype="int64").value_counts().to_dict() for fid in lines}
    standing, into = set(lines), {}

    def covered(fid: int) -> bool:
        fit = {o for o in on[fid] if o in standing and 2 * lines[o].n >= lines[fid].n}
        return sum(not others.isdisjoint(fit) for others in along[fid]) >= ABSORB * lines[fid].size

    for fid in lines:
        takers = [o for o in on[fid] if o in standing and on[o].get(fid, 0) >= TRANSFER * lines[o].size]
        if takers and covered(fid):
            standing.discard(fid)
            into[fid] = takers
    while back := [fid for fid in lines if fid not in standing and not covered(fid)]:
        standing.add(back[0])
    out = []
    for fid in lines:  # passes travel on when a taker goes as well
        todo, met = [(fid, False)], {fid}
        while todo:
            at, flip = todo.pop()
            if at in standing:
                out.append((fid, at, flip))
            for o in into.get(at, ()):
                if o not in met:
                    met.add(o)
                    turned = lines[at].cx * lines[o].cx + lines[at].cy * lines[o].cy < 0
                    todo.append((o, flip != turned))
    return pd.DataFrame(out, columns=["fid", "target", "flip"])


def _grouped(lines: DataFrame, points: DataFrame, near: DataFrame, n: DataFrame) -> DataFrame:
    """A row a line: passes, number of samples, chord, and for touched samples the lines they touch."""
    hits = near.groupBy("fid", "k").agg(F.collect_set("other").alias("o")).groupBy("fid").agg(F.collect_list(F.struct("k", "o")).alias("h"))
    size = points.groupBy("fid").agg(F.count("*").alias("size"))
    cx, cy = chord("points")
    wide = lines.select("fid", cx.alias("cx"), cy.alias("cy")).join(size, "fid").join(n, "fid", "left").join(hits, "fid", "left")
    return wide.select("fid", "cx", "cy", F.hypot("cx", "cy").alias("chord"), "size", F.coalesce("n", F.lit(0)).alias("n"), F.expr("coalesce(h.k, array())").alias("ks"), F.expr("coalesce(h.o, array())").alias("others"))


def _sent(rows: DataFrame) -> DataFrame:
    """Rows to every task, up to SENT of them, so that passes stay dealt as they are."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def _alike(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fid, same of every target; same, cluster, flip), of target, cluster, flip: targets that take the same classes have one ``same``.

    What counts is how the classes lie to each other: all of them turned make the same number of passes.
    """
    sets = source.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("cluster", "flip"))).alias("s"))
    even = sets.select("target", F.expr("array_sort(transform(s, c -> struct(c.cluster as cluster, c.flip <> s[0].flip as flip)))").alias("s"))
    found = cut(even.groupBy("s").agg(F.min("target").alias("same"), F.collect_list("target").alias("fids")))
    return found.select(F.explode("fids").alias("fid"), "same"), cut(found.select("same", F.inline("s")))


def merge_corridors(lines: DataFrame, rides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drawn lines fid, points, n passes; their fid, ride, fwd, rev).

    lines: fid, points (array of x, y in metres, two or more); rides: fid, ride, fwd, rev in the line's own direction.
    Passes are counted by class, and by what classes a drawn line takes; they are carried to each line in the second
    table only. Rides that come dealt by ride stay so: what they passed is combined without another shuffle.
    """
    filled = rides.select("fid", "ride", F.coalesce("fwd", F.lit(0)).alias("fwd"), F.coalesce("rev", F.lit(0)).alias("rev"))
    n = cut(lines.select("fid").join(passes(filled, "fid"), "fid", "left").fillna(0, ["n"]))
    shape, of = shapes(lines.select("fid", "points").join(n, "fid"))
    points = cut(samples(shape))
    near = cut(touches(points))
    alike = classes(shape, shares(points, near)).join(shape.select("fid", "least"), "fid")
    least = alike.groupBy("cluster").agg(F.min("least").alias("least"))
    by_shape = cut(alike.drop("least").join(least, "cluster").select("fid", F.col("least").alias("cluster")))
    cluster = of.join(by_shape.withColumnRenamed("fid", "shape"), "shape").select("fid", "cluster")
    cx, cy = chord("points")
    ways = lines.select("fid", cx.alias("cx"), cy.alias("cy")).join(cluster, "fid")
    lead = ways.filter("fid = cluster").select("cluster", F.col("cx").alias("lx"), F.col("cy").alias("ly"))
    turned = cut(ways.join(lead, "cluster").select("fid", "cluster", F.expr("cx * lx + cy * ly < 0").alias("flip")))
    by_class = pooled(rides.join(_sent(turned), "fid"), "cluster")
    ridden = cut(passes(by_class, "cluster"))

    inside = near.join(by_shape, "fid").join(by_shape.select(F.col("fid").alias("other"), F.col("cluster").alias("c")), "other").filter("cluster = c").select("fid", "k", "other")
    members = _grouped(shape, points, inside, n).join(by_shape, "fid").join(shape.select("fid", "m"), "fid")
    drawn = cut(members.groupBy("cluster").applyInPandas(_draw, "cluster long, fid long"))
    # a line that is kept carries the passes of its class; their number is the same in both directions
    carried = drawn.join(ridden, "cluster").select("fid", "n")

    kept = lines.join(drawn.select("fid"), "fid", "left_semi")
    left = near.join(drawn.select("fid"), "fid", "left_semi").join(drawn.select(F.col("fid").alias("other")), "other", "left_semi").select("fid", "k", "other")
    group = tables.components(left.select(F.col("fid").alias("u"), F.col("other").alias("v"))).select(F.col("node").alias("fid"), "component")
    wide = _grouped(kept, points, left, carried).join(group, "fid", "left").withColumn("component", F.coalesce("component", "fid"))
    moves = cut(wide.groupBy("component").applyInPandas(_absorb, "fid long, target long, flip boolean"))
    source = moves.join(turned.select("fid", "cluster", F.coalesce("flip", F.lit(False)).alias("was")), "fid").select("target", "cluster", (F.col("was") != F.col("flip")).alias("flip")).distinct()
    drawn_alike, takes = _alike(source)
    count = cut(passes(pooled(by_class.join(_sent(takes), "cluster"), "same"), "same"))
    standing = drawn_alike.join(count, "same", "left").select("fid", "n")
    shown = lines.join(standing, "fid").select("fid", "points", F.coalesce("n", F.lit(0)).alias("n"))
    final = pooled(by_class.join(source, "cluster"), "target").withColumnRenamed("target", "fid")
    return shown, final


def audit(lines: DataFrame, snap: int = 40, meet: float = 6.0) -> DataFrame:
    """One row on drawn lines: features, duplicates (pairs that still cover each other), duplicate_km, ends, dangling, suspect.

    Pairs count from 30 m on. An end dangles if the nearest other line is less than ``snap`` but more than ``meet`` away.
    Suspect: duplicates above 0.3 % of the features, or dangling ends above 2 %. Without lines all counts are 0.
    """
    shape, _ = shapes(lines.withColumn("n", F.lit(0)))
    points = cut(samples(shape))
    share = shares(points, touches(points)).filter(F.col("share") >= MUTUAL)
    length = shape.select("fid", "m", geo.path_length("points").alias("metres")).filter("metres >= 30")
    mutual = share.select("fid", "other").intersect(share.select(F.col("other").alias("fid"), F.col("fid").alias("other"))).filter("fid < other")
    pairs = mutual.join(length, "fid").join(length.select(F.col("fid").alias("other"), F.col("m").alias("m2"), F.col("metres").alias("also")), "other").select((F.col("m") * F.col("m2")).alias("pairs"), F.least("metres", "also").alias("metres"))
    pairs = pairs.union(length.filter("m > 1").select((F.col("m") * (F.col("m") - 1) / 2).cast("bigint"), "metres"))
    doubled = pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("duplicates"), F.coalesce(F.sum(F.col("metres") * F.col("pairs")) / 1000, F.lit(0.0)).alias("duplicate_km"))

    # the ends of lines of one shape meet each other
    tip = lambda rows, at: rows.select("fid", F.lit(at).alias("at"), F.element_at("points", at)["x"].alias("x"), F.element_at("points", at)["y"].alias("y"))
    tips = tip(shape.filter("m = 1"), 1).union(tip(shape.filter("m = 1"), -1))
    along = samples(shape, 4).select("fid", "x", "y").union(tip(shape, 1).union(tip(shape, -1)).select("fid", "x", "y"))
    near = joins.within(tips, along, snap, F.col("l.fid") != F.col("r.fid")).groupBy("l.fid", "l.at").agg(F.min("d2").alias("d2"))
    loose = near.filter((F.col("d2") > meet * meet) & (F.col("d2") < snap * snap)).agg(F.count("*").alias("dangling"))
    both = lines.agg(F.count("*").alias("features")).join(doubled).join(loose).withColumn("ends", F.col("features") * 2)
    return both.select("features", "duplicates", "duplicate_km", "ends", "dangling", F.expr("duplicates > 0.003 * features or dangling > 0.02 * ends").alias("suspect"))
