"""A corpus pipeline: toxicity, near duplicates, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads. All but the last return the columns of
documents: the first three drop rows, mixing puts the kept rows in mixed order (part files by slot, rows by slot inside
them), and the last writes one shard of token ids for each part file, which keeps the mixed order of its documents beside
their keys, and returns a row for each document read back.

Edge cases, at every stage: null and empty texts are neither toxic nor near duplicates nor contaminated and stay, as
documents of the end id alone; texts of any length are read whole; of documents linked as near duplicates (ties
included) the one of least id stays, and of rows that repeat an id one; rows without an id are never near duplicates and
stay; a null source is the source ''; documents may have further columns of any name, which pass through to mixing; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import decontamination, jaccard_join, mixing, sstable, toxicity
from wayfold.llm.common import forget, saved, table, written
from wayfold.llm.queries import END_ID, HELD_OUT, tokenizer_file


def carried(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents' own columns, out of the struct in which operators carry them."""
    return found.select(*[F.col(f"carried.`{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(f"not ({HELD_OUT})")
    return carried(toxicity.score_documents(docs, labels, carry=tuple(docs.columns)).filter("predicted = 0"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), carry=tuple(docs.columns))
    return carried(found.filter("not contaminated"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def write_token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of part file i go to shard i, keyed by id; their order in the file is kept as the shard's order."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).try_cast("int")
    placed = docs.select("doc_id", "text", F.coalesce(part, F.lit(0)).alias("shard"), F.col("_metadata.row_index").alias("row"))
    return sstable.read_shards(sstable.write_shards(placed, tokenizer_file(), END_ID, shard_col="shard", order_col="row", remembered=REMEMBERED, together=TOGETHER))


#: Pieces that a worker remembers and code points that it encodes together: other stages have used its executor's memory.
REMEMBERED, TOGETHER = 150_000, 1 << 19

STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_shards", write_token_shards),
]

#: Training a classifier, hashing and encoding have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage saved on its way is deleted once its result is written."""
    docs, since = table(spark, sf_dir, "documents"), len(written())
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        forget(spark, since, but=1)  # the stage before this one's as well
    return STAGES[-1][1](spark, docs, sf_dir)
