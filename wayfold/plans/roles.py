"""The driver's tables in the engine's roles: fixes, trips, edge rides, edges, areas, validity rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixes(spark: SparkSession, d: str) -> DataFrame:
    """ride, seq, t, x, y, day, kind: one row a fix, in whole metres and seconds."""
    return table(spark, d, "events").selectExpr(
        "user_id as ride", "event_id as seq", f"{T} as t", "(event_id * 7919) % 2000 as x", "(event_id * 104729) % 2000 as y", "to_date(ts) as day", "event_type as kind", "cast(value * 100 as bigint) as cents"
    )


def trips(spark: SparkSession, d: str) -> DataFrame:
    """trip, bike, s, e (seconds), dock, pay."""
    return table(spark, d, "events").selectExpr("event_id as trip", "user_id as bike", f"{T} as s", f"{T} + (event_id % 30 + 1) * 60 as e", "event_type as dock", "cast(get_json_object(props, '$.k') as bigint) as pay")


def edge_rides(spark: SparkSession, d: str) -> DataFrame:
    """edge, ride, passes, dir (1 forward), day, cents, line."""
    return table(spark, d, "lineitem").selectExpr(
        "l_partkey as edge", "l_orderkey as ride", "cast(l_quantity as bigint) as passes", "if(l_linestatus = 'O', 1, 0) as dir", "to_date(l_shipdate) as day", "cast(round(l_extendedprice * 100) as bigint) as cents", "l_linenumber as line", "l_suppkey as supp"
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """edge, street, tag, chunk, metres."""
    return table(spark, d, "part").selectExpr("p_partkey as edge", "p_name as street", "p_type as tag", "p_size as chunk", "cast(round(p_retailprice) as bigint) as metres", "p_brand as brand")


#: The same roles for the SQL side, as common table expressions.
SQL = {
    "fixes": "fixes AS (SELECT user_id AS ride, event_id AS seq, epoch_us(ts) // 1000000 AS t, (event_id * 7919) % 2000 AS x, (event_id * 104729) % 2000 AS y, cast(ts AS date) AS day, event_type AS kind, cast(trunc(value * 100) AS bigint) AS cents FROM events)",
    "trips": "trips AS (SELECT event_id AS trip, user_id AS bike, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + (event_id % 30 + 1) * 60 AS e, event_type AS dock, cast(json_extract_string(props, '$.k') AS bigint) AS pay FROM events)",
    "er": "er AS (SELECT l_partkey AS edge, l_orderkey AS ride, cast(l_quantity AS bigint) AS passes, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS dir, cast(l_shipdate AS date) AS day, cast(round(l_extendedprice * 100) AS bigint) AS cents, l_linenumber AS line, l_suppkey AS supp FROM lineitem)",
    "edges": "edges AS (SELECT p_partkey AS edge, p_name AS street, p_type AS tag, p_size AS chunk, cast(round(p_retailprice) AS bigint) AS metres, p_brand AS brand FROM part)",
}


def sql(body: str, *roles: str, also: str = "") -> str:
    return "WITH " + ", ".join([SQL[r] for r in roles] + ([also] if also else [])) + " " + body
