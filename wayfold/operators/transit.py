"""A transit network for trips: demand between stations, lines that serve it, stops along a corridor, and its score.

Stations and demand are summaries of the trips, some hundreds of rows whatever the trips are; laying a line is greedy, so
each number of lines is tried in a task of its own, with all stations and pairs as its group.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators import joins

#: Walk to a station, turn at a stop, detour, shared part of two lines, stops of a line, least rides a
#: kilometre that a stop adds, pairs tried as seeds, rides a new line must win, and points a further line must gain.
WALK_M, TURN, WANDER, OVERLAP, STOPS, DENSITY, SEEDS, LEAST_RIDES, KNEE = 800, 62.0, 1.38, 0.55, (5, 15), 3.5, 20, 5, 3.0

#: Stops of a line at a place that are compared together.
LISTED = 1000


def home_stations(clusters: DataFrame, stations: DataFrame, walk: int = WALK_M) -> DataFrame:
    """id, station: each cluster's nearest station within a walk; null for none."""
    near = joins.nearest_one(clusters.select("id", "x", "y"), stations.select("id", "x", "y"), walk, "id", "id", start=walk // 8)
    return clusters.select("id").join(near.select("id", F.col("near").alias("station")), "id", "left")


def demand(rides: DataFrame, homes: DataFrame) -> DataFrame:
    """a, b (a < b), n: rides between different stations. rides: ca, cb (clusters)."""
    ends = rides.join(homes.select(F.col("id").alias("ca"), F.col("station").alias("sa")), "ca").join(homes.select(F.col("id").alias("cb"), F.col("station").alias("sb")), "cb")
    return ends.filter("sa <> sb").groupBy(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b")).agg(F.count("*").alias("n"))


class Plan:
    """Lines laid one by one over stations, each where it wins most of the demand that no line serves yet."""

    def __init__(self, at: dict, demand_: dict):
        self.at, self.open = at, dict(demand_)
        self.lines: list[list] = []

    def km(self, path: list) -> float:
        return sum(float(np.hypot(self.at[a][0] - self.at[b][0], self.at[a][1] - self.at[b][1])) for a, b in pairwise(path)) / 1000

    def rides(self, stop, path: list) -> float:
        """Unserved rides between a stop and those of a path."""
        return sum(self.open.get((min(stop, o), max(stop, o)), 0) for o in path if o != stop)

    def smooth(self, path: list) -> bool:
        way = [np.arctan2(self.at[b][0] - self.at[a][0], self.at[b][1] - self.at[a][1]) for a, b in pairwise(path)]
        turns = [abs((np.degrees(b - a) + 180) % 360 - 180) for a, b in pairwise(way)]
        span = self.km([path[0], path[-1]])
        return max(turns, default=0) <= TURN and not (span > 0.2 and self.km(path) > WANDER * span)

    def longer(self, path: list) -> list | None:
        """The path with the stop, at the place, that wins most rides a kilometre."""
        base, best = self.km(path), (DENSITY, None)
        for stop in sorted(set(self.at) - set(path)):
            won = self.rides(stop, path)
            for i in range(len(path) + 1) if won > 0 else ():
                tried = [*path[:i], stop, *path[i:]]
                density = won / max(self.km(tried) - base, 0.2)
                if (density > best[0] or best[1] is None and density >= best[0]) and self.smooth(tried):
                    best = (density, tried)
        return best[1]

    def shorter(self, path: list) -> list:
        """The path without ends that win too few rides for the way to them."""
        while len(path) > STOPS[0]:
            for rest, end in ((path[1:], path[0]), (path[:-1], path[-1])):
                saved = self.km(path) - self.km(rest)
                if saved > 0.2 and self.rides(end, rest) < DENSITY * saved:
                    path = rest
                    break
            else:
                return path
        return path

    def served(self, path: list) -> float:
        stops = set(path)
        return sum(n for (a, b), n in self.open.items() if a in stops and b in stops)

    def add(self) -> bool:
        best: tuple = (0.0, None)
        for a, b in sorted(self.open, key=lambda k: (-self.open[k], k))[:SEEDS]:
            path = [a, b]
            while len(path) < STOPS[1] and (grown := self.longer(path)):
                path = grown
            path = self.shorter(path)
            apart = all(len(set(path) & set(line)) <= OVERLAP * len(path) for line in self.lines)
            if len(path) >= STOPS[0] and apart and self.served(path) > best[0]:
                best = (self.served(path), path)
        if best[1] is None or best[0] < LEAST_RIDES:
            return False
        self.lines.append(best[1])
        stops = set(best[1])
        self.open = {k: n for k, n in self.open.items() if not stops.issuperset(k)}
        return True


def lay_lines(stations: DataFrame, pairs: DataFrame, numbers: tuple[int, ...] = (4, 5, 6, 7, 8)) -> DataFrame:
    """tried, line, place, station: for each number of lines tried, the stops of its lines in order.

    stations: id, x, y; pairs: a, b, n.
    """
    tries = F.explode(F.array(*map(F.lit, numbers))).alias("tried")
    rows = stations.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), tries)
    asked = pairs.select("a", "b", F.col("n").cast("double").alias("n"), F.explode(F.array(*map(F.lit, numbers))).alias("of"))
    kind = stations.schema["id"].dataType.simpleString()

    def lay(group: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(group):
            tried = int(group.tried.iloc[0])
            plan = Plan({r.id: (r.x, r.y) for r in group.itertuples()}, {(r.a, r.b): r.n for r in links.itertuples()})
            while len(plan.lines) < tried and plan.add():
                pass
            out = [(tried, i, k, stop) for i, line in enumerate(plan.lines) for k, stop in enumerate(line)]
        return pd.DataFrame(out, columns=["tried", "line", "place", "station"])

    return rows.groupBy("tried").cogroup(asked.groupBy("of")).applyInPandas(lay, f"tried int, line long, place long, station {kind}")


def score(stops: DataFrame, pairs: DataFrame) -> DataFrame:
    """direct, one_change, stranded: rides by how a network serves them. stops: line, station; pairs: a, b, n."""
    on = stops.select("line", "station").distinct()
    met = on.alias("p").join(on.alias("q"), "station").select(F.col("p.line").alias("l"), F.col("q.line").alias("m")).distinct()
    at = pairs.join(on.select(F.col("station").alias("a"), F.col("line").alias("la")), "a", "left").join(on.select(F.col("station").alias("b"), F.col("line").alias("lb")), "b", "left")
    linked = at.join(met.select(F.col("l").alias("la"), F.col("m").alias("lb"), F.lit(True).alias("meets")), ["la", "lb"], "left")
    best = linked.groupBy("a", "b", "n").agg(F.max(F.coalesce(F.col("la") == F.col("lb"), F.lit(False))).alias("same"), F.max(F.coalesce("meets", F.lit(False))).alias("meets"))
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return best.agg(part(F.col("same")).alias("direct"), part(~F.col("same") & F.col("meets")).alias("one_change"), part(~F.col("same") & ~F.col("meets")).alias("stranded"))


def knee(scores: DataFrame, rides: int, least: float = KNEE) -> DataFrame:
    """tried of the last network that gains ``least`` points of rides within one change; else the smallest. A row a network.

    scores: tried, direct, one_change.
    """
    share = scores.withColumn("pct", 100.0 * (F.col("direct") + F.col("one_change")) / rides)
    order = Window.orderBy("tried")
    gained = share.withColumn("gain", F.col("pct") - F.coalesce(F.lag("pct").over(order), F.lit(0.0))).withColumn("first", F.row_number().over(order) == 1)
    return gained.filter((F.col("gain") >= least) | F.col("first")).agg(F.max("tried").alias("tried"))


def transfers(stops: DataFrame, reach: int = 360) -> DataFrame:
    """a, b: stops (id, line, x, y) of different lines within reach of each other.

    The stops of a line at a place are compared once, as lists of ``LISTED`` at most; pairs are made where two lists have
    met, and are not shuffled.
    """
    part = F.floor((F.row_number().over(Window.partitionBy("x", "y", "line").orderBy("id")) - 1) / LISTED)
    lists = stops.withColumn("part", part).groupBy("x", "y", "line", "part").agg(F.collect_list("id").alias("ids")).withColumn("list", F.struct("x", "y", "line", "part"))
    tasks = int(stops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = joins.pairs_within(lists, reach, "list", F.col("l.line") != F.col("r.line"), tasks)
    one = met.select(F.explode("l.ids").alias("i"), F.col("r.ids").alias("others"))
    both = one.select("i", F.explode("others").alias("j")).filter("i <> j")
    return both.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def block(stops: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines: line, stops renumbered; stations: index, name, x, y, ends, lines, transfer): only stations that a line uses.

    stops: line, place, station; stations: id, name, x, y, n. Stations number some hundreds.
    """
    used = stops.select(F.col("station").alias("id")).distinct().withColumn("index", F.row_number().over(Window.orderBy("id")) - 1)
    numbered = stops.join(used.withColumnRenamed("id", "station"), "station")
    listed = numbered.groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "index"))), lambda s: s["index"]).alias("stops"))
    serves = numbered.groupBy("index").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    shown = stations.join(used, "id").join(serves, "index").select("index", "name", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.col("n").alias("ends"), "lines", (F.size("lines") > 1).alias("transfer"))
    return listed, shown


def reachable(stops: DataFrame) -> DataFrame:
    """a, b: stations that share a line."""
    on = stops.select("line", "station").distinct()
    return on.select("line", F.col("station").alias("a")).join(on.select("line", F.col("station").alias("b")), "line").filter("a <> b").select("a", "b").distinct()


def place_stops(profile: DataFrame, anchors: DataFrame, gap: float = 550.0) -> DataFrame:
    """corridor, s, kind of stops along corridors (profile: corridor, s, x, y, v): anchors, then peaks of demand, then ends.

    anchors: corridor, s, n (the heaviest first; n below 0 is a forced stop). A stop keeps its distance from those before
    it: anchors half the gap, peaks the whole, ends six tenths. One corridor is one group.
    """
    rows = profile.select("corridor", "s", "v", F.lit(None).cast("long").alias("n")).unionByName(anchors.select("corridor", "s", F.lit(None).cast("double").alias("v"), F.col("n").cast("long").alias("n")))
    kind = profile.schema["corridor"].dataType.simpleString()

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        line = group[group.n.isna()].sort_values("s")
        peak = line[(line.v > 0) & (line.v >= line.v.rolling(7, center=True, min_periods=1).max())].sort_values(["v", "s"], ascending=[False, True])
        given = group[group.n.notna()]
        asked = [("forced", 0.0, s) for s in given[given.n < 0].s]
        asked += [("anchor", 0.5 * gap, s) for s in given[given.n >= 0].sort_values(["n", "s"], ascending=[False, True]).s]
        asked += [("peak", gap, s) for s in peak.s] + [("end", 0.6 * gap, s) for s in line.s.iloc[[0, -1]]]
        taken: list[tuple] = []
        for what, apart, s in asked:
            if what == "forced" or all(abs(s - t) >= apart for _, t in taken):
                taken.append((what, s))
        return pd.DataFrame([(group.corridor.iloc[0], s, what) for what, s in sorted(taken, key=lambda t: t[1])], columns=["corridor", "s", "kind"])

    return rows.groupBy("corridor").applyInPandas(choose, f"corridor {kind}, s double, kind string")
