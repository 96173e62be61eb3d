"""What the operators of this subpackage share: table reads, the shared folder, and word rules."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import threading
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.errors import SparkNoSuchElementException
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share.

    The setting is read from the session. Without it, a local master gets a folder of its own; a cluster is refused, as
    its executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jsc.get() if jsc.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="wayfold-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/wayfold-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The pyarrow file system of a path below shared_dir, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if uri.startswith("file:") else uri)


_written = threading.local()


def written() -> list[str]:
    """The folders that this thread's ``saved`` calls have written and ``forget`` has not deleted."""
    if not hasattr(_written, "paths"):
        _written.paths = []
    return _written.paths


def saved(df: DataFrame, where: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    where = where or shared_dir(spark)
    df.write.mode("overwrite").parquet(where)
    written().append(where)
    return spark.read.schema(df.schema).parquet(where)


def forget(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Delete what this thread has saved from number ``since`` on, except the last ``but`` folders.

    For callers that have written their result: frames that still read a deleted folder are lost.
    """
    paths = written()
    end = len(paths) - but
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for where in paths[since:end]:
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(conf).delete(path, True)
    del paths[since:end]


#: Bytes of input that a part of an output holds, about.
PART_BYTES = 128 << 20


def parts_for(df: DataFrame) -> int:
    """Parts to write a frame in: the session's shuffle partitions, or more where the files it reads are large.

    Sources of unknown size (local rows, checkpoints) count nothing, so the session's number holds for them.
    """
    unknown = int(df.sparkSession.conf.get("spark.sql.defaultSizeInBytes", str((1 << 63) - 1)))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(s for s in sizes if s < unknown) // PART_BYTES)


#: Rows and bytes of an Arrow batch: texts can be long, and a batch is held whole by the executor and by its Python worker.
BATCH_ROWS, BATCH_BYTES = 400, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The frame, with its session's Arrow batches bounded to BATCH_ROWS rows and, where Spark can, BATCH_BYTES."""
    conf = df.sparkSession.conf
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    try:
        conf.get(size)
    except SparkNoSuchElementException:  # an older Spark
        return df
    conf.set(size, f"{BATCH_BYTES}b")
    return df


#: What the operators keep in a Python worker between tasks.
KEPT: list[dict] = []


def drop_kept(*but: dict) -> None:
    """Forget what other operators keep in this Python worker: workers outlive a query's stages."""
    others = [kept for kept in KEPT if kept and not any(kept is b for b in but)]
    for kept in others:
        kept.clear()
    if others:
        gc.collect()
        release_memory()


def release_memory() -> None:
    """Give a Python worker's freed memory back, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
