"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

Texts are normalised to lower-case words (digits, a-z and everything beyond ASCII) joined by one space. A window is 13
consecutive words of a benchmark item, or the whole item if it has fewer words. All windows go into one automaton with
a space on either side, and each document is scanned once; a match's end gives its words, and the words give offsets
(code points) in the original text.

The benchmark is dealt into blocks of about ``block_chars`` characters, so the automaton that a Python worker holds is
bounded however large the benchmark is; each block is one more narrow pass over the rows, without a shuffle. Blocks are
files in the shared folder, which the workers read; the driver knows their number only.

Edge cases: null or empty texts have no words and are never contaminated; a text of any length is scanned whole; items
without words have no window; items with equal ids count once, a null id as 'null'; repeated documents are judged each
for itself; an empty benchmark hits nothing; an empty table gives an empty result. Columns that aren't carried are not
read and may have any name; carried columns come in a struct ``carried``, so no name clashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import KEPT, drop_kept, file_system, release_memory, shared_dir, small_batches, written

#: Word characters: 0-9, a-z and all beyond ASCII, after lower-casing A-Z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows_of(words: list[bytes], size: int) -> list[list[bytes]]:
    if not words:
        return []
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))]


_built: dict = {}
KEPT.append(_built)


def read_block(uri: str) -> list[tuple[str, str]]:
    """The items (id, text) of a block's Parquet files."""
    fs, path = file_system(uri)
    found = fs.get_file_info(pa.fs.FileSelector(path, recursive=True, allow_not_found=True))
    files = sorted(f.path for f in found if f.path.endswith(".parquet"))
    tables = [pq.read_table(f, filesystem=fs, columns=["item", "text"], partitioning=None) for f in files]
    return [(i, t) for table in tables for i, t in zip(table["item"].to_pylist(), table["text"].to_pylist(), strict=True)]


def build(block: list[tuple[str, str]], size: int):
    """The automaton of a block's windows, or None where there is none."""
    owners: dict[bytes, tuple[int, set]] = {}
    for item, text in block:
        for window in windows_of(words_of(text), size):
            owners.setdefault(b" " + b" ".join(window) + b" ", (len(window), set()))[1].add(item)
    if not owners:
        return None
    a = ahocorasick.Automaton()
    for pattern, (n, items) in owners.items():
        a.add_word(pattern.decode("latin-1"), (n, tuple(sorted(items))))
    a.make_automaton()
    return a


def automaton_of(uri: str, size: int):
    """The automaton of a block's files; kept by the worker for later tasks."""
    if (uri, size) not in _built:
        made = build(read_block(uri), size)
        _built.clear()
        _built[uri, size] = made
    return _built[uri, size]


def scan(text: str | None, automaton) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, merged runs [first, last) of hit words, and the items that occur."""
    words = words_of(text)
    if automaton is None or not words:
        return len(words), [], set()
    line = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(line.decode("latin-1")))
    if not found:
        return len(words), [], set()
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    ends = np.searchsorted(spaces, [e for e, _ in found])
    items: set = set()
    runs: list[tuple[int, int]] = []
    for last, (n, owners) in sorted(zip(ends.tolist(), (v for _, v in found), strict=True), key=lambda x: x[0] - x[1][0]):
        items.update(owners)
        first = last - n
        if runs and first <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(last, runs[-1][1]))
        else:
            runs.append((first, last))
    return len(words), runs, items


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def offsets(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Code point spans in the original text of runs of words."""
    if not runs:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]


def write_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> list[str]:
    """The folders of the benchmark's blocks, dealt by a hash of the item."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    where = shared_dir(benchmark.sparkSession)
    dealt = items.withColumn("block", F.expr(f"cast(pmod(xxhash64(item, text), {n}) as int)"))
    dealt.repartition("block").write.partitionBy("block").parquet(where)
    written().append(where)
    return [f"{where}/block={b}" for b in range(n)]


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    block_chars: int = 4_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: id, n_words, n_hit, items (sorted), spans in the original, contaminated; with ``carry`` also a struct
    ``carried`` of the named columns.

    Contaminated: some word is hit and hit words are at least a twentieth of all.
    """
    blocks = write_blocks(benchmark, item_col, item_text_col, block_chars)
    extra = [c for c in dict.fromkeys(carry) if c not in (id_col, text_col)]
    state = small_batches(documents).select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in extra]).alias("rest")] if extra else []),
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<first: bigint, last: bigint>>)").alias("runs"),
        F.expr("cast(array() as array<string>)").alias("items"),
        F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"),
    )
    run_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kept = 3 if extra else 2
    names = state.columns
    for number, uri in enumerate(blocks):
        final = number == len(blocks) - 1

        def step(batches: Iterator[pa.RecordBatch], uri=uri, final=final) -> Iterator[pa.RecordBatch]:
            drop_kept(_built)
            a = automaton_of(uri, window)
            for batch in batches:
                n_words, all_runs, all_items, spans = [], [], [], []
                before, known = batch.column("runs").to_pylist(), batch.column("items").to_pylist()
                for text, old, owners in zip(batch.column("text"), before, known, strict=True):
                    text = text.as_py()
                    n, runs, items = scan(text, a)
                    if old:
                        runs = merge_runs(runs + [(r["first"], r["last"]) for r in old])
                    n_words.append(n)
                    all_runs.append([{"first": x, "last": y} for x, y in runs])
                    all_items.append(sorted(items.union(owners)) if owners else sorted(items))
                    spans.append(offsets(text, runs) if final else [])
                made = [pa.array(n_words, pa.int64()), pa.array(all_runs, run_type), pa.array(all_items, pa.list_(pa.string())), pa.array(spans, span_type)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *made], names=names)
            release_memory()

        state = state.mapInArrow(step, state.schema)
    n_hit = F.expr("aggregate(runs, 0L, (s, r) -> s + r.last - r.first)")
    carried = {id_col: F.col("id"), text_col: F.col("text")} | {c: F.col(f"rest.`{c}`") for c in extra}
    flagged = state.select("*", n_hit.alias("n_hit"))
    return flagged.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        "items",
        "spans",
        F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated"),
        *([F.struct(*[carried[c].alias(c) for c in carry]).alias("carried")] if carry else []),
    )
