"""Map matching: the likeliest edges of a ride, by two methods behind one call.

``likeliest`` runs a Viterbi over candidate edges from a grid join and is the default; ``nearest`` snaps fixes to nodes
by distance, heading and tag, drops small loops, and routes between the nodes. Candidates, scores and the shape of the
result are joins and windows over all rides; what follows the order of one ride's fixes or the network around one pair
of nodes runs in ``applyInPandas``, with that ride or pair as its group.

Fixes: ride, seq, x, y. Edges: u, v, ax, ay, bx, by (ends in metres) and for ``nearest`` length and tag.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators.state import cut

#: Fixed values of the likeliest path: reach, noise of a fix, share of a fix's best score below which a state is dropped,
#: states kept a fix, and fixes skipped behind a dead end.
REACH_M, NOISE_M, LEAST_SHARE, BEAM, SKIP = 80.0, 15.0, 0.001, 24, 5
#: Fixed values of snapping: tolerance, nodes looked at, score that is good enough, metres a degree of heading, spacing of
#: points on long edges, nodes and metres of a loop that is dropped, longest route, longest detour, and nodes bridged.
SNAP_M, NODES, GOOD, DEGREE_M, LONG_M = 80.0, 5, 3.0, 0.15, 150.0
LOOP_NODES, LOOP_M, ROUTE_M, DETOUR, AHEAD = 6, 50.0, 2500.0, 3.0, 4
PENALTY = {"cycleway": -5, "path": -2, "track": -1, "footway": 25, "steps": 40, "pedestrian": 5, "service": 3, "motorway": 10, "motorway_link": 5, "trunk": 2, "trunk_link": 2}


def near_edges(fixes: DataFrame, edges: DataFrame, reach: float = REACH_M) -> DataFrame:
    """ride, seq, u, v, d and part (where on the edge, 0 to 1) of undirected edges within reach of each fix."""
    low, high = F.least("u", "v"), F.greatest("u", "v")
    flip = F.col("u") > F.col("v")
    ends = {c: (F.when(flip, F.col(f"b{c}")).otherwise(F.col(f"a{c}")), F.when(flip, F.col(f"a{c}")).otherwise(F.col(f"b{c}"))) for c in ("x", "y")}
    once = edges.select(low.alias("u"), high.alias("v"), ends["x"][0].alias("ax"), ends["y"][0].alias("ay"), ends["x"][1].alias("bx"), ends["y"][1].alias("by")).dropDuplicates(["u", "v"])
    cells = lambda c: F.explode(F.sequence(F.floor((F.least(f"a{c}", f"b{c}") - reach) / reach), F.floor((F.greatest(f"a{c}", f"b{c}") + reach) / reach)))
    dealt = once.withColumn("cx", cells("x")).withColumn("cy", cells("y"))
    placed = fixes.select("ride", "seq", "x", "y").withColumn("cx", F.floor(F.col("x") / reach)).withColumn("cy", F.floor(F.col("y") / reach))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.coalesce(F.try_divide((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy, dx * dx + dy * dy), F.lit(0.0))
    met = placed.join(dealt, ["cx", "cy"]).withColumn("d", geo.point_segment("x", "y", "ax", "ay", "bx", "by")).filter(F.col("d") <= reach)
    return met.select("ride", "seq", "u", "v", "d", F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)).alias("part"), F.hypot(dx, dy).alias("length"), "x", "y")


def likeliest(fixes: DataFrame, edges: DataFrame, reach: float = REACH_M, noise: float = NOISE_M, beam: int = BEAM) -> DataFrame:
    """ride, seq, u, v, stretch: the likeliest edge for each fix that has one (Viterbi).

    A state costs its squared distance in noise units; a move between states costs what its way along the network differs
    from the straight way between the fixes, in noise units. Ways lead along an edge, over a shared node, or over one
    edge in between. A ride whose states all come to a dead end goes on some fixes later, as a new stretch.
    """
    states = near_edges(fixes, edges, reach)
    best = F.min("d").over(Window.partitionBy("ride", "seq"))
    rank = F.row_number().over(Window.partitionBy("ride", "seq").orderBy("d", "u", "v"))
    pruned = states.withColumn("best", best).withColumn("rank", rank).filter((F.col("rank") <= beam) & ((F.col("d") * F.col("d") - F.col("best") * F.col("best")) / (2 * noise * noise) <= -float(np.log(LEAST_SHARE))))
    # what a node's other edges lead to, for moves over one edge in between: only between nodes of a ride's own states
    touched = pruned.select("ride", F.explode(F.array("u", "v")).alias("n")).distinct()
    low, high = F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q")
    spans = edges.select(low, high, F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("w")).groupBy("p", "q").agg(F.min("w").alias("w"))
    between = touched.withColumnRenamed("n", "p").join(spans, "p").join(touched.withColumnRenamed("n", "q"), ["ride", "q"]).select(F.col("ride").alias("of_ride"), "p", "q", "w")
    rows = pruned.select("ride", "seq", "u", "v", "d", "part", "length", "x", "y")
    kinds = {c: fixes.schema[c].dataType.simpleString() for c in ("ride", "seq")}
    node = edges.schema["u"].dataType.simpleString()

    def walk(group: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        columns = ["ride", "seq", "u", "v", "stretch"]
        if group.empty:
            return pd.DataFrame(columns=columns)
        hops: dict = {}
        for p, q, w in zip(links.p, links.q, links.w, strict=True):
            hops[p, q] = hops[q, p] = w
        group = group.sort_values(["seq", "u", "v"])
        steps = [s for _, s in group.groupby("seq", sort=True)]
        out, stretch, at = [], 0, 0
        while at < len(steps):
            lattice, last = [], None
            i = at
            while i < len(steps):
                s = steps[i]
                emit = (s.d.to_numpy() / noise) ** 2 / 2
                state = list(zip(s.u, s.v, s.part, s.length, strict=True))
                xy = (s.x.iloc[0], s.y.iloc[0])
                if last is None:
                    cost, back = emit, np.full(len(state), -1)
                else:
                    straight = float(np.hypot(xy[0] - last[2][0], xy[1] - last[2][1]))
                    move = np.array([[way(a, b, hops) for a in last[0]] for b in state])
                    total = last[1][None, :] + np.minimum(np.abs(move - straight) / noise, 1e6)
                    back, cost = total.argmin(axis=1), total.min(axis=1) + emit
                    cost[np.isinf(move.min(axis=1))] = np.inf
                    if np.isinf(cost).all():
                        break
                lattice.append((s.seq.iloc[0], state, back))
                last = (state, cost, xy)
                i += 1
            where, path = int(np.argmin(last[1])), []
            for seq, state, back in reversed(lattice):
                path.append((group.ride.iloc[0], seq, state[where][0], state[where][1], stretch))
                where = int(back[where])
            out += path[::-1]
            if i >= len(steps):
                break
            at, stretch = i + SKIP - 1 if i - at <= 1 else i, stretch + 1
        return pd.DataFrame(out, columns=columns)

    def way(a: tuple, b: tuple, hops: dict) -> float:
        """Metres along the network from state a to state b (u, v, part, length): infinite where none is short."""
        if a[:2] == b[:2]:
            return abs(b[2] - a[2]) * a[3]
        found = np.inf
        for n, left in ((a[0], a[2] * a[3]), (a[1], (1 - a[2]) * a[3])):
            for m, right in ((b[0], b[2] * b[3]), (b[1], (1 - b[2]) * b[3])):
                between_ = 0.0 if n == m else hops.get((n, m), np.inf)
                found = min(found, left + between_ + right)
        return found

    return rows.groupBy("ride").cogroup(between.groupBy("of_ride")).applyInPandas(walk, f"ride {kinds['ride']}, seq {kinds['seq']}, u {node}, v {node}, stretch long")


def edge_sequence(states: DataFrame) -> DataFrame:
    """ride, k, u, v: the edges a ride went along, in order, of states (ride, seq, u, v, stretch).

    A state that stands alone at either end of a stretch is an overshoot and goes; equal edges in a row are one.
    """
    w = Window.partitionBy("ride", "stretch").orderBy("seq")
    edge = F.struct("u", "v")
    marked = states.withColumn("before", F.lag(edge).over(w)).withColumn("after", F.lead(edge).over(w)).withColumn("n", F.count("*").over(Window.partitionBy("ride", "stretch")))
    alone = (F.col("n") > 1) & ((F.col("before").isNull() & (F.col("after") != edge)) | (F.col("after").isNull() & (F.col("before") != edge)))
    inner = marked.filter(~F.coalesce(alone, F.lit(False)) & (F.col("u") != F.col("v"))).drop("before", "after")
    whole = Window.partitionBy("ride").orderBy("seq")
    turns = inner.withColumn("before", F.lag(edge).over(whole)).filter(F.col("before").isNull() | (F.col("before") != edge))
    return turns.select("ride", (F.row_number().over(whole) - 1).alias("k"), "u", "v")


def skipped(fixes: DataFrame, states: DataFrame) -> DataFrame:
    """ride, skipped: the gaps of each ride: stretches of its states but one, and runs of fixes off the network behind them."""
    gaps = states.groupBy("ride").agg((F.count_distinct("stretch") - 1).alias("cuts"))
    on = fixes.select("ride", "seq").join(states.select("ride", "seq", F.lit(1).alias("on")), ["ride", "seq"], "left")
    w = Window.partitionBy("ride").orderBy("seq")
    falls = on.withColumn("fell", (F.col("on").isNull() & (F.lag("on").over(w) == 1)).cast("int")).groupBy("ride").agg(F.sum(F.coalesce("fell", F.lit(0))).alias("falls"))
    return falls.join(gaps, "ride", "left").select("ride", F.greatest(F.coalesce("cuts", F.lit(0)), "falls").alias("skipped"))


def _penalty(tag: str) -> Column:
    listed = F.create_map(*[F.lit(x) for item in PENALTY.items() for x in item])
    return F.coalesce(listed[F.col(tag)], F.lit(0)).cast("double")


def snapped_nodes(fixes: DataFrame, edges: DataFrame, tolerance: float = SNAP_M) -> DataFrame:
    """ride, seq, node, x, y: the node each fix snaps to, of its best edge among those at the nodes nearest to it.

    An edge scores its distance, the penalty of its tag, and the difference of headings. Nodes are looked at from the
    nearest on, until a score is good enough. Long edges have points in between, which lead to one of their nodes.
    """
    both = edges.select("u", "v", "ax", "ay", "bx", "by", "tag").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by"), "tag"))
    cheap = both.groupBy("u", "v").agg(F.min(_penalty("tag")).alias("penalty"), *[F.first(c).alias(c) for c in ("ax", "ay", "bx", "by")])
    nodes = cheap.groupBy(F.col("u").alias("node")).agg(F.first("ax").alias("x"), F.first("ay").alias("y"))
    once = cheap.filter("u < v").withColumn("n", F.floor(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / LONG_M).cast("int")).filter("n > 0")
    part = F.col("j") / (F.col("n") + 1)
    inner = once.withColumn("j", F.explode(F.expr("sequence(1, n)"))).select(F.col("u").alias("node"), (F.col("ax") + part * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + part * (F.col("by") - F.col("ay"))).alias("y"))
    points = nodes.unionByName(inner)
    wide = tolerance * 1.5
    cell = lambda c: F.floor(F.col(c) / wide)
    around = points.withColumn("cx", F.explode(F.sequence(cell("x") - 1, cell("x") + 1))).withColumn("cy", F.explode(F.sequence(cell("y") - 1, cell("y") + 1))).select("cx", "cy", "node", F.col("x").alias("nx"), F.col("y").alias("ny"))
    w = Window.partitionBy("ride").orderBy("seq").rowsBetween(-3, 3)
    hx, hy = F.last("x").over(w) - F.first("x").over(w), F.last("y").over(w) - F.first("y").over(w)
    headed = fixes.select("ride", "seq", "x", "y", hx.alias("hx"), hy.alias("hy")).withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    near = headed.join(around, ["cx", "cy"]).withColumn("near", F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))).filter(F.col("near") <= wide)
    rank = F.row_number().over(Window.partitionBy("ride", "seq").orderBy("near", "node"))
    five = near.withColumn("rank", rank).filter(F.col("rank") <= NODES).select("ride", "seq", "x", "y", "hx", "hy", "node", "rank")
    scored = five.join(cheap.withColumnRenamed("u", "node"), "node").withColumn("d", geo.point_segment("x", "y", "ax", "ay", "bx", "by")).filter(F.col("d") <= tolerance)
    turn = geo.turn(geo.compass("hx", "hy"), geo.compass(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")), 180.0)
    headed_too = (F.col("hx") * F.col("hx") + F.col("hy") * F.col("hy") > 25) & (F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) > 1)
    scored = scored.withColumn("score", F.col("d") + F.col("penalty") + F.when(headed_too, DEGREE_M * turn).otherwise(0.0)).filter(F.col("score") < tolerance)
    before = F.min("score").over(Window.partitionBy("ride", "seq").orderBy("rank").rangeBetween(Window.unboundedPreceding, -1))
    looked = scored.withColumn("so_far", before).filter(F.col("so_far").isNull() | (F.col("so_far") >= GOOD))
    close = F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay")) < F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))
    end = F.when(close, F.struct(F.col("node").alias("n"), F.col("ax").alias("x"), F.col("ay").alias("y"))).otherwise(F.struct(F.col("v").alias("n"), F.col("bx").alias("x"), F.col("by").alias("y")))
    best = looked.withColumn("end", end).groupBy("ride", "seq").agg(F.min_by("end", F.struct("score", "rank", "v")).alias("end"))
    return best.select("ride", "seq", F.col("end.n").alias("node"), F.col("end.x").alias("x"), F.col("end.y").alias("y"))


def node_paths(snapped: DataFrame) -> DataFrame:
    """ride, k, node, x, y: the nodes of each ride in order, without repeats in a row and without small loops.

    Coming back to one of the last nodes drops what lies between, unless some of it is far from that node.
    """
    node = snapped.schema["node"].dataType.simpleString()
    ride = snapped.schema["ride"].dataType.simpleString()

    def path(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for n, x, y in group.sort_values("seq")[["node", "x", "y"]].itertuples(index=False):
            recent = [m for m, _, _ in kept[-(LOOP_NODES - 1) :]][::-1]
            if n not in recent:
                kept.append((n, x, y))
                continue
            back = recent.index(n)
            loop = kept[len(kept) - back :]
            if all(np.hypot(p - x, q - y) <= LOOP_M for _, p, q in loop):
                del kept[len(kept) - back :]
        return pd.DataFrame([(group.ride.iloc[0], k, *row) for k, row in enumerate(kept)], columns=["ride", "k", "node", "x", "y"])

    return snapped.groupBy("ride").applyInPandas(path, f"ride {ride}, k long, node {node}, x double, y double")


def shortest(graph: dict, start, goal, most: float) -> list | None:
    """Nodes of the shortest way from start to goal of at most so many metres (graph: node -> [(node, metres)])."""
    best, came, heap = {start: 0.0}, {}, [(0.0, start)]
    while heap:
        far, n = heapq.heappop(heap)
        if n == goal:
            out = [n]
            while n in came:
                n = came[n]
                out.append(n)
            return out[::-1]
        if far > best[n]:
            continue
        for m, w in graph.get(n, ()):
            if far + w <= most and far + w < best.get(m, np.inf):
                best[m], came[m] = far + w, n
                heapq.heappush(heap, (far + w, m))
    return None


def nearest(fixes: DataFrame, edges: DataFrame, tolerance: float = SNAP_M) -> tuple[DataFrame, DataFrame]:
    """(ride, k, u, v: edges in order; ride, skipped: pairs of nodes without a way) by snapping and routing.

    Each ride is walked with the edges around its own nodes only, which a join by cell of the longest route gives. From
    the last node reached, the next ones are tried in turn; where none of some is reached, one is skipped.
    """
    paths = cut(node_paths(snapped_nodes(fixes, edges, tolerance)))
    size = ROUTE_M
    cell = lambda c: F.floor(F.col(c) / size)
    homes = paths.select("ride", cell("x").alias("hx"), cell("y").alias("hy")).distinct()
    spread = homes.withColumn("cx", F.explode(F.sequence(F.col("hx") - 1, F.col("hx") + 1))).withColumn("cy", F.explode(F.sequence(F.col("hy") - 1, F.col("hy") + 1))).select("ride", "cx", "cy").distinct()
    lengths = edges.select("u", "v", F.coalesce("length", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("w"), F.floor(F.col("ax") / size).alias("cx"), F.floor(F.col("ay") / size).alias("cy"))
    around = spread.join(lengths, ["cx", "cy"]).select(F.col("ride").alias("of_ride"), "u", "v", "w")
    ride, node = (paths.schema[c].dataType.simpleString() for c in ("ride", "node"))

    def walk(group: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        columns = ["ride", "k", "u", "v", "skipped"]
        if len(group) < 2:
            return pd.DataFrame(columns=columns)
        graph: dict = {}
        for u, v, w in zip(links.u, links.v, links.w, strict=True):
            graph.setdefault(u, []).append((v, w))
        nodes = list(group.sort_values("k")[["node", "x", "y"]].itertuples(index=False, name=None))
        known: dict = {}

        def way(a: tuple, b: tuple) -> list | None:
            key = (a[0], b[0])
            if key not in known:
                straight = float(np.hypot(a[1] - b[1], a[2] - b[2]))
                if any(m == b[0] for m, _ in graph.get(a[0], ())):
                    known[key] = [a[0], b[0]]
                else:
                    known[key] = None if straight > ROUTE_M else shortest(graph, *key, min(ROUTE_M, DETOUR * straight) if straight else ROUTE_M)
            return known[key]

        steps, missed, here, i = [], 0, nodes[0], 1
        while i < len(nodes):
            for j in range(i, min(i + AHEAD, len(nodes))):
                route = [here[0]] if nodes[j][0] == here[0] else way(here, nodes[j])
                if route is not None:
                    steps += list(zip(route, route[1:]))
                    here, i = nodes[j], j + 1
                    break
            else:
                missed, i = missed + 1, i + 1
        ride_ = group.ride.iloc[0]
        out = [(ride_, k, min(a, b), max(a, b), None) for k, (a, b) in enumerate(steps)]
        return pd.DataFrame([*out, (ride_, None, None, None, missed)], columns=columns)

    rows = cut(paths.groupBy("ride").cogroup(around.groupBy("of_ride")).applyInPandas(walk, f"ride {ride}, k long, u {node}, v {node}, skipped long"))
    return rows.filter("k is not null").drop("skipped"), rows.filter("skipped is not null").select("ride", "skipped")


def match(fixes: DataFrame, edges: DataFrame, method: str = "likeliest") -> tuple[DataFrame, DataFrame]:
    """(ride, k, u, v; ride, skipped) by either method."""
    if method == "nearest":
        return nearest(fixes, edges)
    if method != "likeliest":
        raise ValueError(f"no method {method!r}")
    states = cut(likeliest(fixes, edges))
    return edge_sequence(states), skipped(fixes, states)


def quality(fixes: DataFrame, matched: DataFrame, edges: DataFrame) -> DataFrame:
    """ride, matched_m, gps_m, ratio: how long the matched edges are against the trace."""
    w = Window.partitionBy("ride").orderBy("seq")
    steps = fixes.withColumn("step", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))).groupBy("ride").agg(F.sum("step").alias("gps_m"))
    low, high = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    lengths = edges.select(low, high, F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("m")).groupBy("u", "v").agg(F.min("m").alias("m"))
    sums = matched.join(lengths, ["u", "v"]).groupBy("ride").agg(F.sum("m").alias("matched_m"))
    return steps.join(sums, "ride", "left").select("ride", F.coalesce("matched_m", F.lit(0.0)).alias("matched_m"), "gps_m", F.try_divide(F.coalesce("matched_m", F.lit(0.0)), "gps_m").alias("ratio"))
