"""The street network: networks put together, edges that others cover, sidewalks, and one line for each pair of nodes.

Nodes: id, x, y. Edges, one row a direction: u, v, k (number among parallel ones), pos (order of appearance), length,
highway and name (arrays), points (array of x, y; null for a straight line). An undirected pair is (least, greatest).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import tables

#: Tags of ways for bicycles, of what may be a sidewalk, of the roadways it may run beside, and of what
#: coverage leaves out; metres and degrees within which a footway runs beside a road.
BIKE_TAGS = ("cycleway", "path", "track")
SIDEWALK_TAGS = ("footway", "steps")
STREET_TAGS = ("residential", "secondary", "tertiary", "primary", "unclassified", "living_street", "primary_link", "secondary_link", "tertiary_link", "road", "busway")
NOT_COVERED = ("footway", "steps", "pedestrian", "corridor", "elevator", "escalator", "motorway", "motorway_link", "service", "construction", "proposed")
PARALLEL_M, PARALLEL_DEG = 12.0, 25.0


def primary_tag(highway: str) -> Column:
    """The first tag for bicycles of a list, else its first tag, else ''."""
    tags = F.col(highway)
    return F.coalesce(F.try_element_at(F.filter(tags, lambda t: t.isin(*BIKE_TAGS)), F.lit(1)), F.try_element_at(tags, F.lit(1)), F.lit(""))


def primary_name(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(name), F.lit(1)), F.lit(""))


def infra_class(tag) -> Column:
    return F.when((F.col(tag) if isinstance(tag, str) else tag).isin(*BIKE_TAGS), "bike").otherwise("road")


def rideable(tag: str) -> Column:
    return ~F.coalesce(F.col(tag), F.lit("")).isin(*NOT_COVERED)


def pair(u: str = "u", v: str = "v") -> tuple[Column, Column]:
    return F.least(u, v), F.greatest(u, v)


def compose(*networks: DataFrame, keys: tuple[str, ...] = ("u", "v", "k")) -> DataFrame:
    """Rows of all networks, one for each key: the last network's row stands."""
    every = reduce(DataFrame.unionByName, (n.withColumn("turn", F.lit(i)) for i, n in enumerate(networks)))
    rest = [c for c in networks[0].columns if c not in keys]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "turn").alias("row")).select(*keys, "row.*")


def subsumed(nodes: DataFrame, edges: DataFrame, places: int = 7) -> DataFrame:
    """u, v, k of edges whose line goes through other nodes, where each step from node to node is an edge as well."""
    at = lambda p: (F.round(p["x"], places).alias("px"), F.round(p["y"], places).alias("py"))
    inner = edges.filter("size(points) > 2").select("u", "v", "k", F.posexplode(F.expr("slice(points, 2, size(points) - 2)")).alias("i", "p")).select("u", "v", "k", "i", *at(F.col("p")))
    places_of = nodes.select("id", F.round("x", places).alias("px"), F.round("y", places).alias("py"))
    hits = inner.join(places_of, ["px", "py"]).filter("id <> u and id <> v").groupBy("u", "v", "k", "i").agg(F.min("id").alias("via"))
    listed = hits.groupBy("u", "v", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "via"))), lambda s: s["via"]).alias("vias"))
    chain = F.concat(F.array("u"), F.col("vias"), F.array("v"))
    steps = listed.withColumn("chain", chain).select("u", "v", "k", F.explode(F.expr("zip_with(slice(chain, 1, size(chain) - 1), slice(chain, 2, size(chain) - 1), (a, b) -> struct(a, b))")).alias("s"))
    known = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(True).alias("there")).distinct()
    there = steps.select("u", "v", "k", F.col("s.a").alias("a"), F.col("s.b").alias("b")).join(known, ["a", "b"], "left")
    return there.groupBy("u", "v", "k").agg(F.min(F.coalesce("there", F.lit(False))).alias("covered")).filter("covered").select("u", "v", "k")


def without_subsumed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(subsumed(nodes, edges), ["u", "v", "k"], "left_anti")


def _lined(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with points: a straight line from node to node where none is given."""
    ends = [nodes.select(F.col("id").alias(c), F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias(f"at_{c}")) for c in ("u", "v")]
    both = edges.join(ends[0], "u").join(ends[1], "v")
    given = F.transform("points", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return both.withColumn("points", F.coalesce(given, F.array("at_u", "at_v"))).drop("at_u", "at_v")


def edge_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """u, v (least first), tag, points: the first tag and the first line of each pair."""
    lined = _lined(nodes, edges).withColumn("tag", F.coalesce(F.try_element_at("highway", F.lit(1)), F.lit("")))
    low, high = pair()
    first = lined.groupBy(low.alias("a"), high.alias("b")).agg(F.min_by(F.struct("tag", "points"), "pos").alias("row"))
    return first.select(F.col("a").alias("u"), F.col("b").alias("v"), "row.*")


def segments(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, i, ax, ay, bx, by of lines (keys, points)."""
    flat = lines.select(*keys, F.posexplode(F.expr("transform(sequence(1, size(points) - 1), i -> struct(points[i - 1] as a, points[i] as b))")).alias("i", "s"))
    return flat.select(*keys, "i", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def sidewalks(lines: DataFrame, within: float = PARALLEL_M, heading: float = PARALLEL_DEG) -> DataFrame:
    """u, v of footways beside a roadway: more than half of their segments' middles have a parallel roadway near.

    lines: u, v, tag, points (metres). Roadway segments are dealt to the cells they come near, so this is an equi-join.
    """
    size = 2.0 * within
    roads = segments(lines.filter(F.col("tag").isin(*STREET_TAGS)), "u", "v").select("ax", "ay", "bx", "by", geo.compass(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("road_way"))
    cells = lambda c: F.explode(F.sequence(F.floor((F.least(f"a{c}", f"b{c}") - within) / size), F.floor((F.greatest(f"a{c}", f"b{c}") + within) / size)))
    dealt = roads.withColumn("cx", cells("x")).withColumn("cy", cells("y"))
    walks = segments(lines.filter(F.col("tag").isin(*SIDEWALK_TAGS)), "u", "v")
    mids = walks.select("u", "v", "i", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"), geo.compass(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("way"))
    mids = mids.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    near = mids.join(dealt, ["cx", "cy"]).filter((geo.turn("way", "road_way", 180.0) <= heading) & (geo.point_segment("x", "y", "ax", "ay", "bx", "by") <= within))
    beside = near.select("u", "v", "i").distinct().groupBy("u", "v").agg(F.count("*").alias("near"))
    return walks.groupBy("u", "v").agg(F.count("*").alias("n")).join(beside, ["u", "v"]).filter("near > n div 2").select("u", "v")


def match_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges a matcher may use: all but sidewalks."""
    low, high = pair()
    walks = sidewalks(edge_lines(nodes, edges)).select(F.col("u").alias("a"), F.col("v").alias("b"))
    return edges.withColumn("a", low).withColumn("b", high).join(walks, ["a", "b"], "left_anti").drop("a", "b")


def drawn_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """u, v, points, tag, name of each pair: the shortest line, the first tag for bicycles else the first, the first name."""
    low, high = pair()
    rows = _lined(nodes, edges).select(low.alias("a"), high.alias("b"), "pos", "points", F.coalesce("length", F.lit(float("inf"))).alias("length"), primary_tag("highway").alias("tag"), primary_name("name").alias("name"))
    bike = F.min_by("tag", F.when(infra_class("tag") == "bike", F.col("pos")))
    first = rows.groupBy("a", "b").agg(
        F.min_by("points", F.struct("length", "pos")).alias("points"), F.coalesce(bike, F.min_by("tag", "pos")).alias("tag"), F.min_by("name", F.when(F.col("name") != "", F.col("pos"))).alias("name")
    )
    return first.select(F.col("a").alias("u"), F.col("b").alias("v"), "points", "tag", "name")


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with most nodes (ties: the one of the least node)."""
    nodes = tables.components(edges.select("u", "v"))
    top = nodes.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    kept = nodes.join(F.broadcast(top), "component").select(F.col("node").alias("u"))
    return edges.join(kept, "u", "left_semi")


def contract(edges: DataFrame) -> DataFrame:
    """u, v, length of a two-way network without its nodes of degree two: chains between junctions become one edge.

    edges: u, v, length, one row a pair. Chains are components of edges that share such a node; a ring without a junction
    stays as it is.
    """
    ends = edges.select(F.col("u").alias("n")).union(edges.select(F.col("v").alias("n"))).groupBy("n").agg(F.count("*").alias("degree"))
    passing = ends.filter("degree = 2").select("n")
    numbered = edges.withColumn("e", F.concat_ws("-", "u", "v"))
    at = numbered.select("e", F.col("u").alias("n")).union(numbered.select("e", F.col("v").alias("n"))).join(passing, "n")
    links = at.groupBy("n").agg(F.min("e").alias("u"), F.max("e").alias("v")).filter("u <> v").select("u", "v")
    chains = tables.components(links).select(F.col("node").alias("e"), F.col("component").alias("chain"))
    chained = numbered.join(chains, "e", "left").withColumn("chain", F.coalesce("chain", "e"))
    tips = chained.select("chain", F.col("u").alias("n")).union(chained.select("chain", F.col("v").alias("n"))).groupBy("chain", "n").agg(F.count("*").alias("times")).filter("times = 1")
    whole = tips.groupBy("chain").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("tips")).filter("tips = 2")
    joined = chained.groupBy("chain").agg(F.sum("length").alias("length")).join(whole, "chain").select(F.col("a").alias("u"), F.col("b").alias("v"), "length")
    rings = chained.join(whole.select("chain"), "chain", "left_anti").select("u", "v", "length")
    return joined.unionByName(rings)
