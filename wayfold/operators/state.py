"""Checkpoints, versions and incremental state.

State is tables below one folder, one folder a run, with a manifest that names the run and what it was made with. A
manifest is written last, so a run that breaks off leaves the one before it in force.
"""

from __future__ import annotations

import hashlib
import json
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rides between two checkpoints of a run.
CHECKPOINT_RIDES = 100


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that spark.checkpoint.dir names.

    Without the setting a local master gets a folder of its own; a cluster is refused, as its executors share none.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not where and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="wayfold-"))
    return df.checkpoint()


def pending(landed: DataFrame, *done: DataFrame, key: str = "ride") -> DataFrame:
    """Landed rows whose key none of the done tables has."""
    for rows in done:
        landed = landed.join(rows.select(key), key, "left_anti")
    return landed


def config_hash(config: dict) -> str:
    """A hash of what results depend on, the same whatever the order of its keys."""
    return hashlib.sha1(json.dumps(config, sort_keys=True, default=sorted).encode()).hexdigest()


def write_run(tables: dict[str, DataFrame], path: str, run: str, config: dict, versions: dict[str, str] | None = None) -> None:
    """Tables of a run, then the manifest: run, config (hash), versions of what made it, and the tables' names."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{run}/{name}")
    spark = next(iter(tables.values())).sparkSession
    listed = F.array(*map(F.lit, sorted(tables)))
    made = F.lit(json.dumps(versions or {}, sort_keys=True))
    spark.range(1).select(F.lit(run).alias("run"), F.lit(config_hash(config)).alias("config"), made.alias("versions"), listed.alias("tables")).write.mode("overwrite").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest's row; None where there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not where.getFileSystem(conf).exists(where):
        return None
    return spark.read.parquet(f"{path}/manifest").first().asDict()


def read_state(spark: SparkSession, path: str, config: dict, versions: dict[str, str] | None = None, derived: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The tables in force. With another configuration there are none; with other versions all but the derived ones."""
    found = manifest(spark, path)
    if found is None or found["config"] != config_hash(config):
        return {}
    names = found["tables"]
    if json.loads(found["versions"]) != (versions or {}):
        names = [n for n in names if n not in derived]
    return {n: spark.read.parquet(f"{path}/{found['run']}/{n}") for n in names}


def well_formed(table: DataFrame, schema: str) -> bool:
    """The table has the columns of a schema, with their types; a table of another form is not read on."""
    want = table.sparkSession.createDataFrame([], schema).schema
    have = {f.name: f.dataType for f in table.schema.fields}
    return all(have.get(f.name) == f.dataType for f in want.fields)


def ready(results: DataFrame, expected: DataFrame, key: str = "ride") -> DataFrame:
    """Results of keys all of whose parts have landed; results: key, part; expected: key, parts."""
    landed = results.groupBy(key).agg(F.count_distinct("part").alias("landed"))
    whole = landed.join(expected, key).filter("landed >= parts").select(key)
    return results.join(whole, key, "left_semi")


def batches(rides: DataFrame, size: int = CHECKPOINT_RIDES, key: str = "ride") -> Column:
    """A batch number of about ``size`` rides each, by a hash of the key; a run commits batch after batch."""
    n = max(1, -(-rides.count() // size))
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def grown(region: DataFrame, seen: DataFrame, keys: tuple[str, ...] = ("cx", "cy")) -> DataFrame:
    """A region's cells and those seen now: it grows and never shrinks."""
    return region.select(*keys).union(seen.select(*keys)).distinct()


def region_cells(points: DataFrame, size: float, reach: float) -> DataFrame:
    """cx, cy: cells of a grid within reach of points (x, y)."""
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size)))
    return points.select(near("x").alias("cx"), "y").select("cx", near("y").alias("cy")).distinct()


def region_area(cells: DataFrame, size: float) -> DataFrame:
    """km2 of a region's cells."""
    return cells.agg((F.count("*") * size * size / 1e6).alias("km2"))
