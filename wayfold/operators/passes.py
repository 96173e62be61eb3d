"""Passes: how a ride went along each edge it was matched to, in which direction, and how fast.

A ride's fixes (ride, seq, x, y, t) are put on the sampled edges of that ride only, cut into runs and legs, and leave as
rows (ride, pass, crossing, edge, seq, t, along). Everything after that is aggregation: a pass is what speed measures
between two cuts, a crossing is a traversal whose fragments are joined again, and both are sums that combine in any
order. Putting fixes on edges and cutting legs follow the order of a ride's fixes, so they run ride by ride in
``applyInPandas``; a group holds one ride's fixes with at most four candidates each.

Directions: 1 along the stored order of an edge's points, 0 against it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo

#: Fixed values, metres and seconds unless said otherwise: sampling step, snap distance, factor of the nearest edge within
#: which the edge before is kept, candidates a fix, longest pause and jump in a run, turn-around, least pass, km/h of a
#: pass and of moving, slack of a resumed traversal and the share of an edge it must cover, chunk length and most chunks,
#: least metres of a speed.
SAMPLE_M, SNAP_M, KEEP_EDGE, CANDIDATES = 5.0, 25.0, 1.5, 4
PAUSE_S, JUMP_M, TURN_M = 30.0, 300.0, 15.0
LEAST_PASS_M, MOST_KMH, MOVING_KMH = 25.0, 60.0, 2.4
RESUME_M, COVER = 30.0, 0.5
CHUNK_M, MOST_CHUNKS, LEAST_M = 150.0, 24, 50.0


def vertices(edges: DataFrame, key: str = "edge") -> DataFrame:
    """key, i, x, y, along (metres from the start) of each vertex of lines (key, points)."""
    flat = edges.select(key, F.posexplode("points").alias("i", "p")).select(key, "i", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    w = Window.partitionBy(key).orderBy("i")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return flat.withColumn("step", step).withColumn("along", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def densify(edges: DataFrame, step: float = SAMPLE_M, key: str = "edge") -> DataFrame:
    """key, k, x, y, along, length: points every ``step`` along each line from its start, and its end; lines without length have none."""
    w = Window.partitionBy(key).orderBy("i")
    ends = [F.lead(c).over(w).alias(f"{c}1") for c in ("x", "y", "along")]
    spans = vertices(edges, key).select("*", *ends, F.max("along").over(Window.partitionBy(key)).alias("length")).filter("along1 > along")
    whole = F.expr(f"transform(sequence(cast(ceil(along / {step}) as bigint), cast(ceil(along1 / {step}) as bigint)), k -> k * {step}D)")
    at = F.filter(whole, lambda d: (d >= F.col("along")) & (d < F.col("along1")))
    last = F.when(F.col("along1") == F.col("length"), F.array(F.col("along1"))).otherwise(F.expr("cast(array() as array<double>)"))
    points = spans.withColumn("d", F.explode(F.concat(at, last)))
    part = (F.col("d") - F.col("along")) / (F.col("along1") - F.col("along"))
    xy = [(F.col(c) + part * (F.col(f"{c}1") - F.col(c))).alias(c) for c in ("x", "y")]
    placed = points.select(key, *xy, F.col("d").alias("along"), "length")
    return placed.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("along")) - 1)


def candidates(fixes: DataFrame, edges: DataFrame, edge_rides: DataFrame, snap: float = SNAP_M, keep: float = KEEP_EDGE) -> DataFrame:
    """ride, seq, x, y, t and near: up to four samples of the ride's own edges, nearest first (d, edge, along, length).

    A fix can stay on an edge that is ``keep`` times as far as the nearest, so samples count up to that reach. The join
    is by ride and grid cell; fixes without a sample in reach stay, with none.
    """
    reach = snap * keep
    sampled = densify(edges)
    w = Window.partitionBy("edge").orderBy("k")
    beside = F.coalesce(F.lead(F.struct("x", "y", "along")).over(w), F.lag(F.struct("x", "y", "along")).over(w))
    sampled = sampled.withColumn("b", beside)
    cell = lambda c: F.floor(F.col(c) / reach)
    owned = edge_rides.select("edge", "ride").distinct().join(sampled, "edge").withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    around = fixes.withColumn("cx", F.explode(F.sequence(cell("x") - 1, cell("x") + 1))).withColumn("cy", F.explode(F.sequence(cell("y") - 1, cell("y") + 1)))
    pairs = around.select("ride", "seq", "cx", "cy", F.col("x").alias("px"), F.col("y").alias("py")).join(owned, ["ride", "cx", "cy"])
    pairs = pairs.withColumn("d", F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))).filter(F.col("d") <= reach)
    # the position is refined on the chord to the neighbouring sample
    dx, dy = F.col("b.x") - F.col("x"), F.col("b.y") - F.col("y")
    square = dx * dx + dy * dy
    t = F.when(square > 0, ((F.col("px") - F.col("x")) * dx + (F.col("py") - F.col("y")) * dy) / square).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))
    exact = F.col("along") + t * (F.coalesce("b.along", "along") - F.col("along"))
    four = Window.partitionBy("ride", "seq").orderBy("d", "edge", "k")
    top = pairs.withColumn("rank", F.row_number().over(four)).filter(F.col("rank") <= CANDIDATES)
    listed = top.groupBy("ride", "seq").agg(F.array_sort(F.collect_list(F.struct("rank", "d", "edge", exact.alias("along"), "length"))).alias("near"))
    return fixes.select("ride", "seq", "x", "y", "t").join(listed, ["ride", "seq"], "left")


def legs(along: np.ndarray, turn: float = TURN_M) -> list[tuple[int, int]]:
    """(first, last) fixes of the legs of a run: it is cut at an extremum from which it goes back by ``turn`` or more.

    The extremum belongs to both legs; smaller reversals are noise.
    """
    out, begin, end = [], 0, len(along) - 1
    while begin < end:
        away = np.flatnonzero(np.abs(along[begin:] - along[begin]) >= turn)
        if not len(away):
            return [*out, (begin, end)]
        first = begin + int(away[0])
        forth = along if along[first] > along[begin] else -along
        back = np.flatnonzero(np.maximum.accumulate(forth[first:]) - forth[first:] >= turn)
        if not len(back):
            return [*out, (begin, end)]
        top = first + int(forth[first : first + int(back[0])].argmax())
        out.append((begin, top))
        begin = top
    return out


def hold_edges(near: list, snap: float = SNAP_M, keep: float = KEEP_EDGE) -> list:
    """The candidate (d, edge, along, length) of each fix: the nearest, or the edge before it where that is nearly as near."""
    out, before = [], None
    for found in near:
        found = [] if found is None else list(found)
        if not found or found[0]["d"] > snap:
            out.append(None)
            before = None
            continue
        same = (c for c in found if c["edge"] == before and c["d"] <= keep * found[0]["d"])
        chosen = next(same, found[0])
        out.append(chosen)
        before = chosen["edge"]
    return out


def _cut_ride(group: pd.DataFrame) -> pd.DataFrame:
    columns = ["ride", "pass", "crossing", "edge", "seq", "t", "along", "length"]
    group = group.sort_values("seq")
    held = hold_edges(group.near.tolist())
    at = [i for i, c in enumerate(held) if c is not None]
    if not at:
        return pd.DataFrame(columns=columns)
    x, y, t, seq = (group[c].to_numpy() for c in ("x", "y", "t", "seq"))
    edge = np.array([held[i]["edge"] for i in at])
    along = np.array([held[i]["along"] for i in at], float)
    length = np.array([held[i]["length"] for i in at], float)
    i = np.array(at)
    dt, jump = np.diff(t[i]), np.hypot(np.diff(x[i]), np.diff(y[i]))
    breaks = (np.diff(i) > 1) | (edge[1:] != edge[:-1]) | (dt <= 0) | (dt > PAUSE_S) | (jump > JUMP_M)
    bounds = np.concatenate([[0], np.flatnonzero(breaks) + 1, [len(i)]])
    rows, n_pass, crossing = [], 0, -1
    open_: tuple | None = None  # edge, where the crossing began and stopped
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        for first, last in legs(along[a:b]):
            first, last = a + first, a + last
            way = 1 if along[last] > along[first] else -1
            resumed = False
            if open_ is not None and open_[0] == edge[first]:
                going = 1 if open_[2] > open_[1] else -1
                resumed = way == going and going * (along[first] - open_[2]) >= -RESUME_M
            if not resumed:
                crossing += 1
                open_ = (edge[first], along[first], along[last])
            else:
                open_ = (open_[0], open_[1], along[last])
            span = slice(first, last + 1)
            rows.append(pd.DataFrame({"ride": group.ride.iloc[0], "pass": n_pass, "crossing": crossing, "edge": edge[span], "seq": seq[i[span]], "t": t[i[span]].astype(float), "along": along[span], "length": length[span]}))
            n_pass += 1
    return pd.concat(rows)[columns] if rows else pd.DataFrame(columns=columns)


def measure_rides(fixes: DataFrame, edges: DataFrame, edge_rides: DataFrame) -> DataFrame:
    """ride, pass, crossing, edge, seq, t, along, length: the fixes of every pass along the edges a ride was matched to."""
    kinds = {c: fixes.schema[c].dataType.simpleString() for c in ("ride", "seq")}
    edge = edges.schema["edge"].dataType.simpleString()
    schema = f"ride {kinds['ride']}, pass long, crossing long, edge {edge}, seq {kinds['seq']}, t double, along double, length double"
    placed = candidates(fixes, edges, edge_rides)
    return placed.groupBy("ride").applyInPandas(_cut_ride, schema)


def spans(points: DataFrame, by: str = "pass") -> DataFrame:
    """ride, pass (or crossing), edge, way, dist, dt, length of each: from its first to its last fix."""
    ends = points.groupBy("ride", by, "edge").agg(*[f(c, "seq").alias(f"{c}{n}") for c in ("along", "t") for f, n in ((F.min_by, 0), (F.max_by, 1))], F.max("length").alias("length"))
    return ends.select("ride", by, "edge", F.when(F.col("along1") > F.col("along0"), 1).otherwise(0).alias("way"), F.abs(F.col("along1") - F.col("along0")).alias("dist"), (F.col("t1") - F.col("t0")).alias("dt"), "length")


def admitted(passes: DataFrame) -> DataFrame:
    """Passes that are real: forward in time, plausibly fast, and of some metres or half the edge."""
    real = (F.col("dt") > 0) & (F.col("dist") > 0)
    return passes.filter(real & (3.6 * F.col("dist") <= MOST_KMH * F.col("dt")) & (F.col("dist") >= F.least(F.lit(LEAST_PASS_M), 0.5 * F.col("length"))))


def traversals(points: DataFrame) -> DataFrame:
    """edge, ride, fwd, rev: crossings that cover half the edge at least."""
    whole = admitted(spans(points, "crossing")).filter(F.col("dist") >= COVER * F.col("length"))
    return whole.groupBy("edge", "ride").agg(F.count_if(F.col("way") == 1).alias("fwd"), F.count_if(F.col("way") == 0).alias("rev"))


def chunks_of(length) -> Column:
    """How many chunks an edge of some length has."""
    return F.greatest(F.lit(1), F.least(F.lit(MOST_CHUNKS), F.bround(length / CHUNK_M, 0).cast("int")))


def pass_chunks(points: DataFrame) -> DataFrame:
    """ride, pass, edge, chunk, way, dist, time, moving of admitted passes: from fix to fix, each step by its middle."""
    w = Window.partitionBy("ride", "pass").orderBy("seq")
    steps = points.withColumn("a0", F.lag("along").over(w)).withColumn("t0", F.lag("t").over(w)).filter("t > t0")
    steps = steps.withColumn("step", F.abs(F.col("along") - F.col("a0"))).withColumn("dt", F.col("t") - F.col("t0")).filter(3.6 * F.col("step") <= MOST_KMH * F.col("dt"))
    n = chunks_of(F.col("length"))
    place = F.floor((F.col("along") + F.col("a0")) / 2 / F.col("length") * n).cast("int")
    moving = F.when(3.6 * F.col("step") >= MOVING_KMH * F.col("dt"), F.col("dt")).otherwise(0.0)
    placed = steps.select("ride", "pass", "edge", F.greatest(F.lit(0), F.least(n - 1, place)).alias("chunk"), "step", "dt", moving.alias("moving"))
    sums = placed.groupBy("ride", "pass", "edge", "chunk").agg(F.sum("step").alias("dist"), F.sum("dt").alias("time"), F.sum("moving").alias("moving"))
    return sums.join(admitted(spans(points)).select("ride", "pass", "way"), ["ride", "pass"])


def fold(chunks: DataFrame) -> DataFrame:
    """edge, chunk, way, dist, time, moving, n, s1, s2: sums over passes; s1 and s2 of a pass's km/h and its square."""
    kmh = 3.6 * F.col("dist") / F.col("time")
    return chunks.withColumn("kmh", kmh).groupBy("edge", "chunk", "way").agg(
        F.sum("dist").alias("dist"), F.sum("time").alias("time"), F.sum("moving").alias("moving"), F.count("*").alias("n"), F.sum("kmh").alias("s1"), F.sum(F.col("kmh") * F.col("kmh")).alias("s2")
    )


def add_folds(*folds: DataFrame) -> DataFrame:
    """Folds of several runs as one: all their columns add up."""
    every = folds[0]
    for other in folds[1:]:
        every = every.unionByName(other)
    return every.groupBy("edge", "chunk", "way").agg(*[F.sum(c).alias(c) for c in ("dist", "time", "moving", "n", "s1", "s2")])


def speed_kmh(dist: str = "dist", time: str = "time", n: str = "n") -> Column:
    """Speed of a chunk in one direction; null where too little was measured."""
    return F.when((F.col(n) >= 1) & (F.col(dist) >= LEAST_M) & (F.col(time) > 0), 3.6 * F.col(dist) / F.col(time))


def spread(n: str = "n", s1: str = "s1", s2: str = "s2") -> tuple[Column, Column]:
    """Mean and deviation of the passes' speeds."""
    mean = F.col(s1) / F.col(n)
    return mean, F.sqrt(F.greatest(F.col(s2) / F.col(n) - mean * mean, F.lit(0.0)))


def edge_measured(folded: DataFrame) -> DataFrame:
    """edge, metres, seconds: both directions and all chunks together."""
    return folded.groupBy("edge").agg(F.sum("dist").alias("metres"), F.sum("time").alias("seconds"))


def both_ways(folded: DataFrame) -> DataFrame:
    """edge, chunk and for each direction (f_, r_) dist, time, n, s1, s2: one row a chunk, missing ones 0."""
    pick = lambda way, c: F.sum(F.when(F.col("way") == way, F.col(c)).otherwise(0)).alias(f"{'f' if way else 'r'}_{c}")
    return folded.groupBy("edge", "chunk").agg(*[pick(way, c) for way in (1, 0) for c in ("dist", "time", "n", "s1", "s2")])


def measured_chunks(folded: DataFrame) -> DataFrame:
    """n: chunks with a speed in both directions."""
    both = both_ways(folded).filter(speed_kmh("f_dist", "f_time", "f_n").isNotNull() & speed_kmh("r_dist", "r_time", "r_n").isNotNull())
    return both.agg(F.count("*").alias("n"))


def oriented(folded: DataFrame, lines: DataFrame) -> DataFrame:
    """Folds (with b, the chord's bearing when they were measured) as the lines (edge, points) are drawn now.

    A line that points the other way by more than a right angle reverses the chunks and swaps the directions.
    """
    ends = lambda i, c: F.element_at("points", i)[c]
    now = lines.select("edge", geo.math_angle(ends(-1, "x") - ends(1, "x"), ends(-1, "y") - ends(1, "y")).alias("now"), chunks_of(geo.path_length("points")).alias("n_chunks"))
    turned = folded.join(now, "edge").withColumn("flip", geo.turn("b", "now") > 90)
    return turned.withColumn("chunk", F.when(F.col("flip"), F.col("n_chunks") - 1 - F.col("chunk")).otherwise(F.col("chunk"))).withColumn("way", F.when(F.col("flip"), 1 - F.col("way")).otherwise(F.col("way"))).drop("flip", "now", "n_chunks")


def slices(lines: DataFrame, n: Column | None = None, key: str = "edge", places: int = 6) -> DataFrame:
    """key, chunk, piece: lines cut into n pieces of equal length, whose ends meet in a point rounded to ``places``.

    A line without length, or with fewer than two points, stays whole as its one piece.
    """
    total = geo.path_length("points")
    counted = lines.select(key, "points", total.alias("total")).withColumn("n", F.when((F.col("total") > 0) & (F.size("points") > 1), n if n is not None else chunks_of(F.col("total"))).otherwise(1))
    whole = counted.filter("n <= 1").select(key, F.lit(0).alias("chunk"), F.expr("transform(points, p -> struct(double(p.x) as x, double(p.y) as y))").alias("piece"))
    w = Window.partitionBy(key).orderBy("i")
    v = vertices(counted.filter("n > 1"), key).select(key, "i", "x", "y", "along", *[F.lead(c).over(w).alias(f"{c}1") for c in ("x", "y", "along")])
    spans_ = v.join(counted.filter("n > 1").select(key, "total", "n"), key)
    size = F.col("total") / F.col("n")
    # a vertex belongs to the piece it lies in; a cut belongs to the pieces on both sides
    inside = spans_.select(key, F.least(F.col("n") - 1, F.floor(F.col("along") / size).cast("int")).alias("chunk"), F.col("along").alias("d"), "x", "y")
    cuts = spans_.filter("along1 > along").withColumn("cut", F.explode(F.expr("sequence(1, n - 1)"))).withColumn("d", F.col("cut") * size).filter("d > along and d <= along1")
    part = (F.col("d") - F.col("along")) / (F.col("along1") - F.col("along"))
    at = cuts.select(key, "cut", "d", *[F.round(F.col(c) + part * (F.col(f"{c}1") - F.col(c)), places).alias(c) for c in ("x", "y")])
    sides = at.withColumn("chunk", F.explode(F.array(F.col("cut") - 1, F.col("cut")))).select(key, "chunk", "d", "x", "y")
    pieces = inside.unionByName(sides).groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct("d", "x", "y"))).alias("ps"))
    apart = F.expr("filter(ps, (p, i) -> i = 0 or round(p.x, 6) <> round(ps[i - 1].x, 6) or round(p.y, 6) <> round(ps[i - 1].y, 6))")
    cut = pieces.select(key, "chunk", F.transform(apart, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("piece"))
    return whole.unionByName(cut)
