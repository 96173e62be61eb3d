"""Connected components by alternating large and small stars, in DataFrame operations; of few edges, in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import release_memory, saved

#: Edges up to which one task finds the components: rounds of joins over few edges take an executor more memory than they hold.
IN_ONE_TASK = 1_000_000


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) to (u, v): each node that isn't the least of its component, with the least one."""
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if held:
        nodes, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        a, b = ends.reshape(2, -1)
        least = np.arange(len(nodes))
        while (least[a] != least[b]).any():
            low = np.minimum(least[a], least[b])
            np.minimum.at(least, least[a].copy(), low)  # roots are hooked to lesser ones, and nodes follow them
            np.minimum.at(least, least[b].copy(), low)
            while (least[least] != least).any():
                least = least[least]
        others = np.flatnonzero(least != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[others]), pa.array(nodes[least[others]])], names=["u", "v"])
    release_memory()


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = near.join(least, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """node, component (the least node it reaches) of all nodes of edges (u, v); isolated nodes aren't listed."""
    stars = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    if dict(stars.dtypes)["u"] == "bigint" and stars.count() <= IN_ONE_TASK:
        found = saved(stars.filter("u is not null and v is not null").repartition(1).mapInArrow(_walked, "u long, v long"))
        return found.select(F.col("u").alias("node"), F.col("v").alias("component"))
    sign = stars.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38, 0))"))).first()
    for _ in range(most):
        stars = saved(_starred(_starred(stars, True), False))
        now = stars.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38, 0))"))).first()
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
