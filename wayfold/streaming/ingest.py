"""Incremental ingest and windowed counts with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def fixes(spark: SparkSession, path: str, schema, files: int = 64) -> DataFrame:
    """New Parquet files of a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed_counts(stream: DataFrame, ts: str = "ts", key: str = "event_type", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"))


def ingest(stream: DataFrame, target: str, checkpoint: str, keys: list[str], by: str | None = None) -> StreamingQuery:
    """Append each batch's new rows, one for each key, to a table; rows of keys that are there already are left out.

    ``by`` names a column whose values a key never leaves (its day, say): the table is partitioned by it, and a batch reads
    the keys of its own partitions only.
    """

    def land(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            known = spark.read.schema(batch.schema).parquet(target)
            if by:
                known = known.join(F.broadcast(batch.select(by).distinct()), by, "left_semi")  # prunes partitions
            fresh = fresh.join(known.select(*keys), keys, "left_anti")
        writer = fresh.write.mode("append")
        (writer.partitionBy(by) if by else writer).parquet(target)

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
