"""Queries of the street network: parts and line items as edges between a few hundred nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import network
from wayfold.plans.catalog import query
from wayfold.plans.registry import REACHED
from wayfold.plans.roles import table

TAGS = "['residential', 'cycleway', 'footway', 'path', 'service']"
EDGES = f"""e AS (SELECT l_suppkey % 40 AS u, l_partkey % 40 + 40 AS v, (l_orderkey * 8 + l_linenumber) * 10000 + l_partkey % 10000 AS pos, l_quantity AS length, ({TAGS})[l_quantity::int % 5 + 1] AS t1, ({TAGS})[l_orderkey % 5 + 1] AS t2, CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE 'street ' || l_linenumber END AS name FROM lineitem),
tagged AS (SELECT *, CASE WHEN t1 IN ('cycleway', 'path', 'track') THEN t1 WHEN t2 IN ('cycleway', 'path', 'track') THEN t2 ELSE t1 END AS tag FROM e)"""


def _edges(spark, d) -> tuple[DataFrame, DataFrame]:
    tags = "array('residential', 'cycleway', 'footway', 'path', 'service')"
    rows = table(spark, d, "lineitem").selectExpr(
        "l_suppkey % 40 as u", "l_partkey % 40 + 40 as v", "l_orderkey * 8 + l_linenumber as k", "(l_orderkey * 8 + l_linenumber) * 10000 + l_partkey % 10000 as pos", "l_quantity as length", f"array({tags}[int(l_quantity) % 5], {tags}[int(l_orderkey % 5)]) as highway", "array(if(l_orderkey % 3 = 0, '', concat('street ', l_linenumber))) as name",
        "array(named_struct('x', l_quantity, 'y', 0D), named_struct('x', 0D, 'y', double((l_orderkey * 8 + l_linenumber) * 10000 + l_partkey % 10000))) as points",
    )
    nodes = spark.range(80).selectExpr("id", "double(id) as x", "double(id % 7) as y")
    return nodes, rows


@query(f"WITH {EDGES} SELECT tag, CASE WHEN tag IN ('cycleway', 'path', 'track') THEN 'bike' ELSE 'road' END AS class, count(*) AS n FROM tagged GROUP BY tag")
def q_primary_tags(spark, d):
    tag = network.primary_tag("highway").alias("tag")
    return _edges(spark, d)[1].groupBy(tag).agg(F.count("*").alias("n")).withColumn("class", network.infra_class("tag"))


@query(f"""WITH {EDGES} SELECT u, v, arg_min(pos, length * 1000000000000 + pos) AS line, coalesce(arg_min(tag, pos) FILTER (tag IN ('cycleway', 'path', 'track')), arg_min(tag, pos)) AS tag, arg_min(name, pos) FILTER (name <> '') AS name FROM tagged GROUP BY u, v""")
def q_drawn_lines(spark, d):
    drawn = network.drawn_lines(*_edges(spark, d))
    return drawn.select("u", "v", F.element_at("points", 2)["y"].cast("bigint").alias("line"), "tag", "name")


@query(f"WITH {EDGES} SELECT u, v, arg_min(t1, pos) AS tag, min(pos) AS line FROM e GROUP BY u, v")
def q_edge_lines(spark, d):
    first = network.edge_lines(*_edges(spark, d))
    return first.select("u", "v", "tag", F.element_at("points", 2)["y"].cast("bigint").alias("line"))


@query("SELECT key, coalesce(b, a) AS v FROM (SELECT c_custkey AS key, c_name AS a FROM customer) FULL JOIN (SELECT s_suppkey * 29 AS key, s_name AS b FROM supplier) USING (key)")
def q_compose(spark, d):
    one = table(spark, d, "customer").selectExpr("c_custkey as key", "c_name as v")
    return network.compose(one, table(spark, d, "supplier").selectExpr("s_suppkey * 29 as key", "s_name as v"), keys=("key",))


#: Nodes on a line; an edge goes from one to another up to four further on, through all between.
CHAIN = "c AS (SELECT p_partkey AS k, p_partkey * 13 % 600 AS u, p_partkey * 13 % 600 + 1 + p_size % 4 AS v FROM part)"


@query(f"WITH {CHAIN} SELECT u, v, k FROM c WHERE v - u > 1 AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(c.u, c.v)) AS j) WHERE j NOT IN (SELECT u FROM c WHERE v = u + 1))")
def q_subsumed_edges(spark, d):
    edges = table(spark, d, "part").selectExpr("p_partkey as k", "p_partkey * 13 % 600 as u", "p_partkey * 13 % 600 + 1 + p_size % 4 as v")
    lined = edges.withColumn("points", F.transform(F.sequence("u", "v"), lambda j: F.struct(j.cast("double").alias("x"), F.lit(0.0).alias("y"))))
    return network.subsumed(spark.range(610).selectExpr("id", "double(id) as x", "0D as y"), lined)


#: Roads run along every hundredth metre; ways of fifty metres lie above them, every third aslant.
WAYS = "w AS (SELECT p_partkey AS u, p_partkey + 1000000 AS v, CASE WHEN p_size % 2 = 0 THEN 'footway' WHEN p_size % 5 = 0 THEN 'steps' ELSE 'path' END AS tag, (p_partkey * 37) % 1900 AS x, 100 * (p_partkey % 10) + p_size % 30 AS y, CASE WHEN p_partkey % 3 = 0 THEN 60 ELSE 0 END AS rise FROM part)"


@query(f"WITH {WAYS} SELECT u, v FROM w WHERE tag IN ('footway', 'steps') AND rise = 0 AND y % 100 <= 12")
def q_sidewalks(spark, d):
    ways = table(spark, d, "part").selectExpr("p_partkey as u", "p_partkey + 1000000 as v", "case when p_size % 2 = 0 then 'footway' when p_size % 5 = 0 then 'steps' else 'path' end as tag", "double((p_partkey * 37) % 1900) as x", "double(100 * (p_partkey % 10) + p_size % 30) as y", "if(p_partkey % 3 = 0, 60D, 0D) as rise")
    lines = ways.selectExpr("u", "v", "tag", "array(struct(x, y), struct(x + 50 as x, y + rise as y)) as points")
    roads = spark.range(11).selectExpr("-id - 1 as u", "-id - 100 as v", "if(id = 10, 'service', 'secondary') as tag", "array(named_struct('x', -50D, 'y', id * 100D), named_struct('x', 2100D, 'y', id * 100D)) as points")
    return network.sidewalks(lines.unionByName(roads))


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT p_partkey % 150 AS a, p_size * 3 + 200 AS b FROM part), {REACHED}, top AS (SELECT component FROM cc GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT a AS u, b AS v FROM e WHERE a IN (SELECT node FROM cc WHERE component = (SELECT component FROM top))")
def q_largest_component(spark, d):
    return network.largest_component(table(spark, d, "part").selectExpr("p_partkey % 150 as u", "p_size * 3 + 200 as v").distinct())


@query()
def q_contracted(spark, d):
    return network.contract(table(spark, d, "part").selectExpr("least(p_partkey * 13 % 600, 599) as u", "p_partkey * 13 % 600 + 1 as v", "1D as length").distinct())
