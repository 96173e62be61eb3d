"""Mixing sources to target weights by Pfair scheduling, in DataFrame expressions only.

Sources are cut into blocks of documents. With whole weights a_i that sum to Q, one cycle has Q slots; block d (0-based)
of a source with share a_i / Q is released at floor(d Q / a_i) and due at ceil((d + 1) Q / a_i). In every slot the
released block with the earliest deadline runs (ties: the larger share, then the source), so after any number of slots
each source is less than one block away from its share. A source that runs out steps aside: from its last cycle on the
shares are those of the sources that still have blocks. Cycles of equal shares have one schedule ("shape").

Sources of one weight have the same windows and take turns by name, so the earliest deadline is sought among distinct
weights only: a fold over a cycle's slots whose state is one counter a weight. Which source, block and slot a pick
stands for follows from its number, by joins. So any number of sources is scheduled, each for itself, and shapes are
worked on in parallel; there are at most two for each distinct number of a source's blocks, so some 2 sqrt(2 B) for B
blocks. The plan has a row for each slot of each shape (never more than B); it is broadcast up to ``BROADCAST_ROWS``
rows and joined by shuffle beyond, where AQE splits skewed sources.

Fractional weights are scaled to whole ones exactly (as their decimal notation says); weights that aren't positive, or a
cycle of more than ``MAX_CYCLE`` slots, are refused with a ValueError.

Documents of a source are taken in the order of a hash of their id. Numbering is two-level: rows are dealt by source
and hash range into groups of about ``GROUP`` rows, so a source with a third of all rows is split like the others; rows
without an id are dealt by a hash of what they carry.

Edge cases: a null source is the source ''; null ids are mixed like others; rows of one id are ordered by a hash of the
carried columns, and equal rows all stay; texts of any length pass untouched; carried columns come in a struct
``carried``, so names may clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import parts_for, saved

BLOCK_DOCS, GROUP, MAX_CYCLE, BROADCAST_ROWS = 16, 4096, 1 << 22, 200_000
#: Target weights by source in production; a source without one has OTHER_WEIGHT.
WEIGHTS, OTHER_WEIGHT = {"src0": 6, "src1": 3, "src2": 2}, 1
#: Slots that are folded into one piece of a schedule.
PIECE = 64

#: One slot: the released class of earliest deadline. u.done: picks so far by class; x: a class of g sources, m blocks each.
PICK = """
element_at(transform(
  array(array_min(filter(
    transform(classes, (x, j) -> if(
      element_at(u.done, j + 1) < x.m * x.g and (element_at(u.done, j + 1) div x.g) * q div x.m <= t,
      named_struct('due', ((element_at(u.done, j + 1) div x.g + 1) * q + x.m - 1) div x.m, 'less', -x.m, 'j', j),
      null)),
    x -> x is not null))),
  run -> named_struct('done', transform(u.done, (d, j) -> if(j = run.j, d + 1, d)), 'out', concat(u.out, array(run.j)))
), 1)
"""
#: A cycle: the class that runs in each slot. Pieces keep the copying of the growing result short.
EDF = f"""
if(size(classes) = 1, array_repeat(0, int(q)), aggregate(
  sequence(0L, q - 1, {PIECE}L),
  named_struct('done', transform(classes, x -> 0L), 'out', cast(array() as array<array<int>>)),
  (s, from) -> element_at(transform(
    array(aggregate(
      sequence(from, least(from + {PIECE}, q) - 1),
      named_struct('done', s.done, 'out', cast(array() as array<int>)),
      (u, t) -> {PICK})),
    piece -> named_struct('done', piece.done, 'out', concat(s.out, array(piece.out)))), 1),
  s -> flatten(s.out)))
"""


def whole_weights(weights: dict, other) -> tuple[dict[str, int], int]:
    """The weights as whole numbers of the same proportions."""
    exact = [Fraction(str(w)) for w in (*weights.values(), other)]
    if any(w <= 0 for w in exact):
        raise ValueError("weights must be positive")
    scale = math.lcm(*(w.denominator for w in exact))
    whole = [int(w * scale) for w in exact]
    least = math.gcd(*whole)
    *named, rest = (w // least for w in whole)
    return dict(zip(weights, named, strict=True)), rest


def attach(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Join with a saved table: broadcast when it is small, else by shuffle (AQE splits what is skewed)."""
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small.hint("merge"), keys)


def schedule(sized: DataFrame, shapes: list[int]) -> DataFrame:
    """name, shape, rank, in_cycle, first_slot, q of each slot of each shape; sized: name, a (weight), k (blocks)."""
    starts = "array(" + ", ".join(f"{s}L" for s in shapes) + ")"
    active = sized.select("name", "a", "k", F.expr(f"explode(filter({starts}, s -> s * a < k))").alias("shape"))
    active = active.withColumn("m", F.expr("least(a, k - shape * a)"))
    classes = active.groupBy("shape", "m").agg(F.count("*").alias("g"))
    cycles = classes.groupBy("shape").agg(F.sum(F.col("m") * F.col("g")).alias("q"), F.expr("sort_array(collect_list(struct(m, g)), false)").alias("classes"))
    in_order = Window.orderBy("shape")  # some 2 sqrt(2 blocks) rows
    blocks = F.col("q") * (F.lead("shape").over(in_order) - F.col("shape"))
    cycles = cycles.withColumn("before", blocks).withColumn("first_slot", F.coalesce(F.sum("before").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cycles = saved(cycles.drop("before"))
    picks = cycles.repartition("shape").select("shape", "first_slot", "q", "classes", F.posexplode(F.expr(EDF)).alias("in_cycle", "j"))
    picks = picks.select("shape", "first_slot", "q", "in_cycle", F.expr("element_at(classes, j + 1).m").alias("m"))
    picks = picks.withColumn("pick", F.row_number().over(Window.partitionBy("shape", "m").orderBy("in_cycle")) - 1)
    members = active.withColumn("p", F.row_number().over(Window.partitionBy("shape", "m").orderBy("name")) - 1).join(classes, ["shape", "m"])
    turns = members.select("name", "shape", "m", "p", "g", F.explode(F.expr("sequence(0L, m - 1)")).alias("rank")).withColumn("pick", F.expr("int(rank * g + p)"))
    return turns.join(picks, ["shape", "m", "pick"]).select("name", "shape", "rank", "in_cycle", "first_slot", "q")


def latest(shapes: list[int], cycle: str) -> Column:
    """The last of the sorted shapes that a cycle reaches, sought in two steps."""
    width = max(1, math.isqrt(len(shapes)))
    parts = [shapes[i : i + width] for i in range(0, len(shapes), width)]
    array = lambda xs: "array(" + ", ".join(f"{x}L" for x in xs) + ")"
    firsts, pieces = array(p[0] for p in parts), "array(" + ", ".join(map(array, parts)) + ")"
    return F.expr(f"array_max(filter(element_at({pieces}, size(filter({firsts}, x -> x <= {cycle}))), x -> x <= {cycle}))")


def _placed(documents: DataFrame, weights: dict | None, other_weight, block_docs: int, id_col: str, source_col: str, carry: tuple[str, ...]) -> DataFrame:
    """m_id, m_source, (m_row,) m_block, m_slot and m_place of each row."""
    named, other = whole_weights(WEIGHTS if weights is None else weights, other_weight)
    row = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("m_row")] if carry else []
    rows = documents.select(F.col(f"`{id_col}`").alias("m_id"), F.col(f"`{source_col}`").alias("m_source"), *row)
    rows = rows.withColumn("name", F.coalesce("m_source", F.lit("")).cast("string"))
    own = F.create_map(*[x for k, w in named.items() for x in (F.lit(k), F.lit(w).cast("long"))])[F.col("name")] if named else F.lit(None)
    counts = rows.groupBy("name").agg(F.count("*").alias("n"))
    sized = saved(counts.select("name", "n", F.coalesce(own, F.lit(other)).cast("long").alias("a"), F.ceil(F.col("n") / block_docs).alias("k")))
    total = sized.agg(F.sum("a")).first()[0] or 0
    if total > MAX_CYCLE:
        raise ValueError(f"the sources' whole weights sum to {total}: more than {MAX_CYCLE} slots a cycle; use rounder weights")
    # where a source's last whole cycle ends, and its last cycle
    turning = sized.select(F.explode(F.expr("if(k % a = 0, array(0L, k div a), array(0L, k div a, k div a + 1))")).alias("s")).distinct()
    shapes = sorted(r.s for r in turning.collect()) or [0]
    plan = saved(schedule(sized, shapes))

    tie = F.xxhash64("m_row") if carry else F.lit(0)
    dealt = F.when(F.col("m_id").isNull(), tie).otherwise(F.xxhash64("m_id"))
    known = sized.select("name", "a", F.expr(f"greatest(1, n div {GROUP})").alias("n_groups"))
    classed = attach(rows, known, ["name"]).withColumn("u", F.shiftrightunsigned(dealt, 1))
    classed = classed.withColumn("group", F.expr("shiftright(shiftright(u, 32) * n_groups, 31)"))
    sums = classed.groupBy("name", "group").agg(F.count("*").alias("in_group"))
    before = sums.select("name", "group", (F.sum("in_group").over(Window.partitionBy("name").orderBy("group").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_group")).alias("before"))
    numbered = classed.withColumn("rn", F.row_number().over(Window.partitionBy("name", "group").orderBy("u", "m_id", tie)))
    placed = numbered.join(before, ["name", "group"]).withColumn("number", F.expr("before + rn - 1"))
    placed = placed.withColumn("m_block", F.expr(f"number div {block_docs}")).withColumn("cycle", F.expr("m_block div a"))
    placed = placed.withColumn("rank", F.expr("m_block % a")).withColumn("shape", latest(shapes, "cycle"))
    timed = attach(placed, plan, ["name", "shape", "rank"])
    return timed.select(
        "m_id",
        "m_source",
        *(["m_row"] if carry else []),
        "m_block",
        F.expr("first_slot + (cycle - shape) * q + in_cycle").alias("m_slot"),
        F.expr(f"int(number % {block_docs})").alias("m_place"),
    )


def mix(
    documents: DataFrame,
    weights: dict | None = None,
    other_weight=OTHER_WEIGHT,
    block_docs: int = BLOCK_DOCS,
    id_col: str = "doc_id",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """id, source, source_block, slot (counts blocks from 0) and place in the block; with ``carry`` a struct ``carried``."""
    made = _placed(documents, weights, other_weight, block_docs, id_col, source_col, carry)
    carried = [F.col("m_row").alias("carried")] if carry else []
    return made.select(F.col("m_id").alias(id_col), F.col("m_source").alias(source_col), F.col("m_block").alias("source_block"), F.col("m_slot").alias("slot"), F.col("m_place").alias("place"), *carried)


def mixed_rows(documents: DataFrame, weights: dict | None = None, other_weight=OTHER_WEIGHT, block_docs: int = BLOCK_DOCS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The documents' columns in mixed order: partitions by slot, rows sorted by slot and place."""
    columns = tuple(documents.columns)
    made = _placed(documents, weights, other_weight, block_docs, id_col, source_col, columns)
    n = parts_for(documents)
    total = max(1, documents.count() // block_docs)
    at = F.least(F.lit(n - 1), (F.col("m_slot") * n / total).cast("int"))
    return made.repartitionById(n, at).sortWithinPartitions("m_slot", "m_place").select(*[F.col(f"m_row.`{c}`").alias(c) for c in columns])
