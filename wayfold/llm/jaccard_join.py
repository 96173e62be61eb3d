"""N-gram Jaccard join and near-duplicate classes: a size-aware heavy-light join.

A document's set holds the 64-bit hashes of its distinct shingles (five words). Texts with equal sets form a class, and
the join runs over distinct sets. All sets are ordered alike: by how common a shingle is (from corpus counts), then by
hash, so rare shingles come first. Two sets of sizes m <= n with Jaccard >= t share at least ceil(t n) elements, hence
at least k of the first size - ceil(t size) + k elements of either. From that follow the two kinds of candidate keys:

* light (small) sets post all fixed-size subsets (pairs) of their first size - ceil(t size) + 2 elements;
* heavy (large) sets, and those a heavy set can still reach, post each of their first size - ceil(t size) + 1 elements
  to inverted lists, which are scanned.

The boundary is the size at which the sum of both costs, over the histogram of set sizes, is least.

Candidates of a list are compared with one hub of the list first, the member with the commonest shingles, and links
found so far are contracted; after ``ROUNDS`` such rounds, lists whose members are still in different components are
compared pair by pair, across components. So a group of copies costs its members, not its pairs, yet every link between
components is found: the components are exact. Before whole texts are compared, bitmaps of parities bound the sets'
difference from below, which ends most pairs that share a passage only.

Links are counted afterwards, without contraction: linked sets stand in one component, so the sets of a component are
dealt into blocks and each two blocks compare all their sets. That costs the pairs of a component, as its links may be
as many; ``keep_one`` needs components only and leaves it out.

Common shingles (count over ``HOT``) post rows of their own instead of meeting in one reducer's list; they are only
aggregated and joined by Spark, which combines on the map side and splits skewed partitions.

Counts of common shingles only order the sets; whichever shingles they miss, the result is the same. So keeping the
``COMMON`` most frequent bounds the broadcast (3 MB) without a bound on what is compared.

Edge cases: null, empty and blank texts have an empty set and are linked with nothing; a text of fewer than five words
has its whole sequence as one shingle; sets of up to three elements can only equal others; repeated rows are rows of
one class; a row without an id is counted but linked with nothing; texts of
any length are hashed whole, segment by segment; an empty table gives an empty result; only the named columns are read,
so others may have any name. Hashes of 64 bits stand for shingles and sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import drop_kept, release_memory, saved, small_batches
from wayfold.llm.components import components

WORDS, PERCENT = 5, 80
COMMON, HOT, LEAST_COUNT = 1 << 18, 2000, 6
#: Shingles that a worker counts together, and postings that it holds: some 35 and 25 MB at their peak.
CHUNK, POSTED = 1 << 20, 1 << 18
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SIGN = np.uint64(1 << 63)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * P2
    x = (x ^ (x >> np.uint64(27))) * P3
    return x ^ (x >> np.uint64(31))


#: A random odd value for each byte, the same for A-Z and a-z, and white space as bytes.
VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * P1) | np.uint64(1)
VALUES[65:91] = VALUES[97:123]
SPACE = np.zeros(256, np.bool_)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are hashed at once.
SEGMENT = 1 << 18
BASE = int(P1)
UNBASE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1, modulo 2^64."""
    while len(_powers[0]) < n:
        for i, base in enumerate((BASE, UNBASE)):
            known = _powers[i]
            _powers[i] = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def hash_words(data: np.ndarray, starts_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and start offsets of the words in bytes; no word crosses an offset of starts_text."""
    blank = SPACE[data]
    border = blank.copy()
    first = ~blank
    first[1:] &= border[:-1] | starts_text[1:]
    last = ~blank
    last[:-1] &= border[1:] | starts_text[1:]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUES[data] * up[: len(data)], dtype=np.uint64)])
    return mixed((sums[ends] - sums[begins]) * down[begins]), begins


def shingle_sets(column: pa.Array, size: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; words split at ASCII white space, A-Z lower-cased."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SEGMENT, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[end])
        words, ranges = [], np.zeros(end - row + 1, np.int64)
        at = lo
        while at < hi:  # one step, but for texts beyond a segment
            to = min(hi, at + 2 * SEGMENT)
            while to < hi and not SPACE[data[to]]:
                to += 1
            piece = data[at:to]
            marks = np.zeros(len(piece), np.bool_)
            inner = offsets[row:end]
            marks[(inner[(inner >= at) & (inner < to)] - at)] = True
            hashes, begins = hash_words(piece, marks)
            words.append(hashes)
            ranges += np.searchsorted(begins, offsets[row : end + 1] - at)
            at = to
        h = np.concatenate(words) if words else np.zeros(0, np.uint64)
        n = min(size, len(h))
        acc = h[: len(h) - n + 1].copy() if n else h
        for i in range(1, n):
            acc = acc * P1 + h[i : len(h) - n + 1 + i]
        acc = mixed(acc + np.uint64(n))
        for i, j in zip(ranges[:-1].tolist(), ranges[1:].tolist(), strict=True):
            if j - i >= size:
                yield np.unique(acc[i : j - size + 1])
            elif j > i:
                short = h[i : i + 1]
                for x in h[i + 1 : j]:
                    short = short * P1 + x
                yield mixed(short + np.uint64(j - i))
            else:
                yield np.zeros(0, np.uint64)
        row = end


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), size))


def parities(tokens: np.ndarray) -> np.ndarray:
    """Bit i says whether an odd number of elements have the hash i modulo the number of bits (two to four an element).

    Sets whose bitmaps differ in d bits differ in d elements at least.
    """
    k = max(6, (2 * max(1, len(tokens)) - 1).bit_length())
    bits = np.bincount((tokens & np.uint64((1 << k) - 1)).astype(np.int64), minlength=1 << k) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """No two sets with these parities differ in fewer elements."""
    if len(a) < len(b):
        a, b = b, a
    folded = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count((folded ^ b).view(np.uint64)).sum())


def set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def least_overlap(n, percent: int):
    """ceil(t n): the elements that a set of n shares at least with any set it is linked with."""
    return -(-n * percent // 100)


def linked(inter: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def count_common(texts: DataFrame, size: int) -> DataFrame:
    """kind, key, n: counts of shingles that repeat within a chunk (kind 0), sets by size (1), all shingles (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        seen: set[int] = set()
        held, n_held, sizes, total = [], 0, {}, 0

        def repeated():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(keep.sum(), np.int8)), pa.array(tokens[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], names=["kind", "key", "n"])

        for batch in batches:
            for tokens in shingle_sets(batch.column(0), size):
                key = set_id(tokens)
                if not len(tokens) or key in seen:
                    continue
                seen.add(key)
                held.append(tokens)
                n_held += len(tokens)
                total += len(tokens)
                sizes[min(len(tokens), 4096)] = sizes.get(min(len(tokens), 4096), 0) + 1
                if n_held >= CHUNK:
                    yield repeated()
                    held, n_held = [], 0
                    seen.clear()
        if held:
            yield repeated()
        held.clear()
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array([1] * len(sizes) + [2], pa.int8()), pa.array([*sizes, 0], pa.int64()), pa.array([*sizes.values(), total], pa.int64())], names=["kind", "key", "n"])

    return texts.mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


#: What a false candidate costs, in postings.
CANDIDATE = 40


def choose_boundary(sizes: dict[int, int], repeated: float, percent: int, most: int = 64) -> int:
    """The size up to which sets are light: at it, postings and false candidates of light and heavy sets cost least.

    ``repeated`` is the share of shingles that stand in other sets as well: a posted shingle meets a false candidate
    about as often, a posted pair of shingles with its square.
    """
    best, at = None, 0
    for x in range(0, most + 1):
        cost = 0.0
        for n, sets in sizes.items():
            first = n - least_overlap(n, percent)
            if 4 <= n <= x:
                cost += sets * (first + 2) * (first + 1) / 2 * (1 + CANDIDATE * repeated**2)
            if n >= 4 and 100 * n > percent * x:
                cost += sets * (first + 1) * (1 + CANDIDATE * repeated)
        if best is None or cost < best:
            best, at = cost, x
    return at


def smallest_linkable(percent: int) -> int:
    """The least size of a set that can be linked with another set than its equal."""
    n = 1
    while not linked(n, n, n + 1, percent):
        n += 1
    return n


#: Members of a part of a list, about, and of a block of an open list whose pairs are compared.
PART, OPEN_BLOCK = 256, 256


def post(rows: DataFrame, common: tuple[bytes, bytes, bytes, bytes], boundary: int, parts: int, percent: int, size: int) -> DataFrame:
    """kind 0: a document (id, n, set_id, share of common shingles, parities); 1: postings of a part; 2: a hot posting, whose
    n says into how many parts its list is split."""
    least = smallest_linkable(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, levels, hot = np.frombuffer(common[0], np.uint64), np.frombuffer(common[1], np.uint8), np.frombuffer(common[2], np.bool_)
        parts_of = np.frombuffer(common[3], np.int64)
        seen: set[int] = set()
        sigs, refs, held = [], [], 0

        def out(kind, m, **given):
            types = {"kind": pa.int8(), "id": id_type, "n": pa.int64(), "set_id": pa.int64(), "common": pa.float64(), "parities": pa.list_(pa.int64()), "sig": pa.int64(), "part": pa.int32(), "blob": pa.binary()}
            given["kind"] = [kind] * m
            return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(m, t) for c, t in types.items()], names=list(types))

        def blobs():
            sig, ref = np.concatenate(sigs), np.concatenate(refs)
            part = (sig >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            sig, ref, part = sig[order], ref[order], part[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(part)]])
            low = (sig & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            return out(1, len(starts), part=part[starts].astype(np.int32), blob=[low[s:e].tobytes() + ref[s:e].tobytes() for s, e in zip(starts, ends, strict=True)])

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            ns, sets, maps, commons, hot_sigs, hot_refs, hot_parts = [], [], [], [], [], [], []
            valid = batch.column(0).is_valid().to_pylist()
            for has_id, tokens in zip(valid, shingle_sets(batch.column(1), size), strict=True):
                n = len(tokens)
                ref = set_id(tokens) if n and has_id else None
                ns.append(n)
                sets.append(ref)
                maps.append(parities(tokens))
                commons.append(0.0)
                if n < least or ref in seen:
                    continue
                seen.add(ref)
                first = n - least_overlap(n, percent)
                is_hot = None
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, tokens), len(keys) - 1)
                    known = keys[at] == tokens
                    if known.any():
                        level = np.where(known, levels[at], 0)
                        commons[-1] = float(known.mean())
                        order = np.argsort(level, kind="stable")[: first + 2]
                        is_hot, n_parts = (known & hot[at])[order], parts_of[at][order]
                        tokens = tokens[order]
                if n <= boundary:
                    head = tokens[: first + 2]
                    i, j = np.triu_indices(len(head), 1)
                    sig = mixed(head[i] * P1 + head[j])
                    sigs.append(sig)
                    refs.append(np.full(len(sig), ref, np.int64))
                    held += len(sig)
                if 100 * n > percent * boundary:
                    head = tokens[: first + 1]
                    if is_hot is not None and is_hot[: first + 1].any():
                        flag = is_hot[: first + 1]
                        hot_sigs.append(head[flag].view(np.int64))
                        hot_refs.append(np.full(int(flag.sum()), ref, np.int64))
                        hot_parts.append(n_parts[: first + 1][flag])
                        head = head[~flag]
                    sigs.append(head)
                    refs.append(np.full(len(head), ref, np.int64))
                    held += len(head)
            yield out(0, len(ns), id=batch.column(0).to_pylist(), n=ns, set_id=sets, common=commons, parities=maps)
            if hot_sigs:
                yield out(2, sum(map(len, hot_sigs)), n=np.concatenate(hot_parts), set_id=np.concatenate(hot_refs), sig=np.concatenate(hot_sigs))
            if held >= POSTED:
                yield blobs()
                sigs, refs, held = [], [], 0
                if len(seen) > 2_000_000:
                    seen.clear()
        if held:
            yield blobs()
        sigs, refs = [], []
        release_memory()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"kind byte, id {kind}, n long, set_id long, common double, parities array<bigint>, sig long, part int, blob binary")


def scan_lists(postings: DataFrame) -> DataFrame:
    """list_id, ref, parts: members of each distinct inverted list that holds two sets at least, and its number of parts."""

    def lists(blobs: list[bytes], part: int) -> pa.RecordBatch | None:
        sig = np.concatenate([np.frombuffer(b, np.uint32, len(b) // 12) for b in blobs])
        ref = np.concatenate([np.frombuffer(b, np.int64, len(b) // 12, 4 * (len(b) // 12)) for b in blobs])
        order = np.lexsort((ref, sig))
        sig, ref = sig[order], ref[order]
        new_sig = np.concatenate([[True], sig[1:] != sig[:-1]])
        keep = new_sig | np.concatenate([[True], ref[1:] != ref[:-1]])
        sig, ref = sig[keep], ref[keep]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(sig)]]))
        many = lengths > 1
        if not many.any():
            return None
        ids = mixed(np.add.reduceat(mixed(ref.view(np.uint64)), starts)[many] + lengths[many].astype(np.uint64))
        starts, lengths = starts[many], lengths[many]
        ids, once = np.unique(ids, return_index=True)
        starts, lengths = starts[once], lengths[once]
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        parts = np.repeat((lengths + PART - 1) // PART, lengths).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids.view(np.int64), lengths)), pa.array(ref[at]), pa.array(parts)], names=["list_id", "ref", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(part, []).append(blob)
        for part in list(held):
            found = lists(held.pop(part), part)
            if found is not None:
                yield found
        release_memory()

    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.repartition(n, "part").mapInArrow(run, "list_id long, ref long, parts int")


#: Bits of the map of ids that is broadcast (as 64-bit words, 262,144 rows at most).
MAP_BITS = 24


def by_map(rows: DataFrame, ids: DataFrame, id_col: str, hit: bool) -> DataFrame:
    """The rows whose id may be among ids (hit), or is surely not: by a bitmap of bounded size that is broadcast."""
    place = lambda c: F.expr(f"pmod(xxhash64(`{c}`), {1 << MAP_BITS})")
    bits = ids.select(place("id").alias("p")).select(F.shiftright("p", 6).alias("wayfold_map_word"), F.expr("shiftleft(1L, int(p & 63))").alias("bit")).groupBy("wayfold_map_word").agg(F.bit_or("bit").alias("wayfold_map_bits"))
    placed = rows.withColumn("wayfold_map_place", place(id_col)).withColumn("wayfold_map_word", F.shiftright("wayfold_map_place", 6)).join(F.broadcast(bits), "wayfold_map_word", "inner" if hit else "left")
    found = F.expr("coalesce((shiftright(wayfold_map_bits, int(wayfold_map_place & 63)) & 1) = 1, false)")
    return placed.filter(found if hit else ~found).select(*rows.columns)


def needed_texts(rows: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """ref, text of the sets in pairs; most other texts stay out of the shuffle."""
    refs = pairs.select(F.explode(F.array("a", "b")).alias("ref")).distinct()
    ids = saved(classes.join(refs, "ref").select("ref", "id"))
    return by_map(rows, ids, "id", True).join(ids, "id").select("ref", "text")


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sets' sizes and parities leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            maps = zip(*(([x.values.to_numpy() for x in batch.column(i)]) for i in (4, 5)), strict=True)
            kept = [linked((n + m - least_difference(x, y)) // 2, n, m, percent) for (n, m), (x, y) in zip(sizes, maps, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))
        release_memory()

    sized = pairs.join(classes.select(F.col("ref").alias("b"), F.col("n").alias("n_b"), F.col("parities").alias("p_b")), "b")
    both = sized.join(classes.select(F.col("ref").alias("a"), F.col("n").alias("n_a"), F.col("parities").alias("p_a")), "a")
    near = both.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return saved(near.select("a", "b", "n_a", "n_b", "p_a", "p_b").mapInArrow(run, "a long, b long"))


def verify(rows: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int, size: int) -> DataFrame:
    """a, b, distance, linked of pairs, by their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kept, distance, link = [], [], []
            for i, right in enumerate(shingle_sets(batch.column(3), size)):
                if a[i] != last:
                    last, left = a[i], next(shingle_sets(batch.column(2).slice(i, 1), size))
                if set_id(left) != a[i] or set_id(right) != b[i]:  # another row of the same id
                    last = None
                    continue
                kept.append(i)
                small, large = (left, right) if len(left) <= len(right) else (right, left)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                inter = int((large[at] == small).sum())
                distance.append(1 - inter / (len(left) + len(right) - inter))
                link.append(linked(inter, len(left), len(right), percent))
            some = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(distance, pa.float64()), pa.array(link, pa.bool_())], names=["a", "b", "distance", "linked"])
        release_memory()

    texts = needed_texts(rows, classes, pairs)
    with_b = pairs.join(texts.select(F.col("ref").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("ref").alias("a"), F.col("text").alias("text_a")), "a")
    return saved(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, distance double, linked boolean").dropDuplicates(["a", "b"]))


def still_open(lists: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists' rows with their components so far, and the hubs of lists that hold more than one component.

    Both have list_id and part; a hub has a row for each part of its list, so that a long list is joined in many tasks.
    """
    labelled = lists.join(found.withColumnRenamed("node", "ref"), "ref", "left").select("list_id", "part", "parts", "ref", "common", "n", F.coalesce("component", "ref").alias("component"))
    hub = F.max(F.struct("common", "ref", "component")).alias("hub")
    heads = labelled.groupBy("list_id", "part").agg(hub, F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("parts").alias("parts"), F.count("*").alias("size"))
    heads = heads.groupBy("list_id").agg(F.max("hub").alias("hub"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("parts").alias("parts"), F.sum("size").alias("size")).filter("lo <> hi")
    each = heads.select("list_id", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.col("hub.ref").alias("a"), F.col("hub.component").alias("hub_component"), "size")
    return labelled, each


#: Sets and elements of a block, about, and elements that are compared at once.
BLOCK_SETS, BLOCK_TOKENS, COLUMNS = 64, 1 << 18, 4096


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set on the left shares with each on the right."""
    out = np.zeros((len(left), len(right)), np.int64)
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    if left is right:
        both, counts = np.unique(sides[0][0], return_counts=True)
        both = both[counts > 1]
    else:
        both = np.intersect1d(sides[0][0], sides[1][0])
    if not len(both):
        return out
    placed = []
    for tokens, rows in sides:
        at = np.minimum(np.searchsorted(both, tokens), len(both) - 1)
        known = both[at] == tokens
        at, rows = at[known], rows[known]
        order = np.argsort(at, kind="stable")
        placed.append((at[order], rows[order]))
    for lo in range(0, len(both), COLUMNS):
        width = min(COLUMNS, len(both) - lo)
        maps = []
        for (at, rows), n in zip(placed, out.shape, strict=True):
            i, j = np.searchsorted(at, [lo, lo + width])
            marks = np.zeros((n, width), np.float32)
            marks[rows[i:j], at[i:j] - lo] = 1
            maps.append(marks)
        out += (maps[0] @ maps[1].T).astype(np.int64)
    return out


def complete_links(rows: DataFrame, classes: DataFrame, found: DataFrame, percent: int, size: int, pairs: bool = False) -> DataFrame:
    """Of all linked pairs of distinct sets: a, b (a < b) of each; or per set ref, n: the ids in the sets linked with it.

    classes: ref, id, n, copies (ids of the set); found: components, whose roots needn't be listed.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs, blobs = [], []
            for ref, tokens in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size), strict=True):
                if set_id(tokens) == ref:  # else another row of the same id
                    refs.append(ref)
                    blobs.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array(blobs, pa.binary())], names=["ref", "tokens"])
        release_memory()

    def compare(held: list[tuple], lo: int, hi: int) -> pa.RecordBatch:
        left = [x for x in held if x[0] == lo]
        right = left if lo == hi else [x for x in held if x[0] == hi]
        if not left or not right:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=names)
        tokens = [np.frombuffer(x[3], np.uint64) for x in left]
        inter = overlaps(tokens, tokens if lo == hi else [np.frombuffer(x[3], np.uint64) for x in right])
        n, m = (np.array([len(x[3]) // 8 for x in side]) for side in (left, right))
        link = linked(inter, n[:, None], m[None, :], percent)
        refs, refs2 = (np.array([x[1] for x in side], np.int64) for side in (left, right))
        if lo == hi:
            link &= refs[:, None] != refs2[None, :]
        if pairs:
            i, j = np.nonzero(link & (refs[:, None] < refs2[None, :]) if lo == hi else link)
            first, second = np.minimum(refs[i], refs2[j]), np.maximum(refs[i], refs2[j])
        else:
            copies, copies2 = (np.array([x[2] for x in side], np.int64) for side in (left, right))
            first, second = refs, link @ copies2
            if lo != hi:
                first, second = np.concatenate([first, refs2]), np.concatenate([second, link.T @ copies])
        return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for key, *row in zip(keys, *(batch.column(i).to_pylist() for i in range(3, 7)), strict=True):
                if key != unit:
                    if held:
                        yield compare(held, *unit[1:])
                    unit, held = key, []
                held.append(tuple(row))
        if held:
            yield compare(held, *unit[1:])
        held.clear()
        release_memory()

    names = ["a", "b"] if pairs else ["ref", "n"]
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    inside = saved(found.select("node", "component").union(roots).withColumnRenamed("node", "ref").distinct().join(classes.select("ref", "id", "n", "copies"), "ref"))
    needed = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_TOKENS)).cast("int")
    dealt = inside.join(inside.groupBy("component").agg(needed.alias("blocks")), "component").withColumn("block", F.expr("int(pmod(xxhash64(ref), blocks))"))
    ids = inside.select("ref", "id")
    texts = by_map(rows, ids, "id", True).join(ids, "id").select("ref", "text")
    tokens = texts.mapInArrow(sets, "ref long, tokens binary").dropDuplicates(["ref"])
    each = dealt.join(tokens, "ref").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    units = each.select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "ref", "copies", "tokens")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(n, "component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").mapInArrow(run, ", ".join(f"{c} long" for c in names))


#: Rounds, at most, in which open lists are compared with one hub each, before all pairs that are still open.
ROUNDS = 3


def find_components(documents: DataFrame, id_col: str, text_col: str, percent: int, size: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (id, text), members (id, n, ref), classes (a row a distinct set) and found (node, component)."""
    spark = documents.sparkSession
    rows = small_batches(documents).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = saved(count_common(rows.select("text"), size))
    top = counted.filter(f"kind = 0 and n >= {LEAST_COUNT}").orderBy(F.desc("n"), "key").limit(COMMON).select("key", "n").toArrow()
    keys, counts = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    n_parts = np.maximum(1, -(-counts // PART)).astype(np.int64)
    common = (keys.tobytes(), (1 + np.log2(np.maximum(counts, 1))).astype(np.uint8).tobytes(), (counts >= HOT).tobytes(), n_parts.tobytes())
    sizes = {r.key: r.n for r in counted.filter("kind = 1").collect()}
    total = sum(r.n for r in counted.filter("kind = 2").collect())
    repeats = counted.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
    boundary = choose_boundary(sizes, repeats / max(1, total), percent)
    parts = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    posted = saved(post(rows, common, boundary, parts, percent, size))
    members = posted.filter("kind = 0").select("id", "n", F.col("set_id").alias("ref"))
    classes = posted.filter("kind = 0 and set_id is not null").groupBy(F.col("set_id").alias("ref")).agg(F.min("id").alias("id"), F.first("n").alias("n"), F.max("common").alias("common"), F.first("parities").alias("parities"))
    classes = saved(classes)
    cold = scan_lists(posted.filter("kind = 1").select("part", "blob"))
    hot = posted.filter("kind = 2").select(F.col("sig").alias("list_id"), F.col("set_id").alias("ref"), F.col("n").cast("int").alias("parts"))
    members_of = cold.union(hot).distinct().withColumn("part", F.expr("int(pmod(xxhash64(ref), parts))"))
    lists = saved(members_of.join(classes.select("ref", "common", "n"), "ref"))
    classes_all, classes = classes, saved(classes.join(lists.select("ref").distinct(), "ref", "left_semi"))

    # a list's hub is its member with the commonest shingles: copies of one text differ least from it
    checked = spark.createDataFrame([], "a long, b long, distance double, linked boolean")
    found = spark.createDataFrame([], "node long, component long")
    for _ in range(ROUNDS):
        labelled, heads = still_open(lists, found)
        stars = labelled.join(heads, ["list_id", "part"]).filter("component <> hub_component").select("a", F.col("ref").alias("b")).distinct()
        known = checked.select("a", "b").union(checked.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = possible(stars.join(known, ["a", "b"], "left_anti"), classes, percent)
        # the hub has met all others of its list; what is left is between the others
        left = labelled.join(heads.select("list_id", "part", F.col("a").alias("hub")), ["list_id", "part"]).filter("ref <> hub")
        lists = saved(left.select("list_id", "part", "parts", "ref", "common", "n"))
        n_near = near.count()
        if n_near:
            checked = saved(checked.union(verify(rows, classes, near, percent, size)))
            found = components(checked.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
        if 10 * n_near < lists.count():
            break

    # whatever stands in one list and still in two components: all pairs that sizes and parities leave open
    labelled, heads = still_open(lists, found)
    blocks = F.ceil(F.col("size") / OPEN_BLOCK).cast("int").alias("blocks")
    open_rows = labelled.join(heads.select("list_id", "part", blocks), ["list_id", "part"]).withColumn("block", F.expr("int(pmod(xxhash64(ref, 7), blocks))"))
    open_rows = open_rows.join(classes.select("ref", "parities"), "ref").select("list_id", "block", "blocks", "ref", "n", F.col("component").alias("c"), "parities")
    open_rows = saved(open_rows)
    # each two blocks of a list are one unit of work, so a long list's pairs are dealt over the cluster
    left = open_rows.withColumn("lo", F.col("block")).withColumn("hi", F.explode(F.expr("sequence(block, blocks - 1)"))).drop("block", "blocks")
    right = open_rows.withColumn("hi", F.col("block")).withColumn("lo", F.explode(F.expr("sequence(0, block)"))).drop("block", "blocks")
    right = right.select("list_id", "lo", "hi", *[F.col(c).alias(f"{c}2") for c in ("ref", "n", "c", "parities")])
    differ = F.expr("if(size(parities) = size(parities2), aggregate(zip_with(parities, parities2, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x), 0)")
    sized = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    near = sized & (100 * (F.col("n") + F.col("n2") - differ) >= percent * (F.col("n") + F.col("n2") + differ))
    once = (F.col("lo") < F.col("hi")) | (F.col("ref") < F.col("ref2"))
    across = left.join(right, ["list_id", "lo", "hi"]).filter(once & (F.col("c") != F.col("c2")) & near).select(F.least("ref", "ref2").alias("ref"), F.greatest("ref", "ref2").alias("ref2"))
    known = checked.select("a", "b").union(checked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = across.select(F.col("ref").alias("a"), F.col("ref2").alias("b")).distinct().join(known, ["a", "b"], "left_anti")
    rest = possible(rest, classes, percent)
    links = checked.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not rest.isEmpty():
        links = links.union(verify(rows, classes, rest, percent, size).filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
        found = components(links)
    return rows, members, classes_all, found


def with_copies(classes: DataFrame, members: DataFrame) -> DataFrame:
    """The classes with copies: how many ids hold the set."""
    return classes.select("ref", "id", "n").join(members.filter("ref is not null").groupBy("ref").agg(F.count_distinct("id").alias("copies")), "ref")


def cluster(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = WORDS, count_links: bool = True) -> DataFrame:
    """Per document: id, n_shingles, component_id (least id that links reach, its own included), n_links.

    n_links: the other ids whose sets are equal or linked, all of them; null without ``count_links``.
    """
    rows, members, classes, found = find_components(documents, id_col, text_col, percent, size)
    by_set = classes.select("ref", "id").join(found.withColumnRenamed("node", "ref"), "ref", "left").select("ref", "id", F.coalesce("component", "ref").alias("c"))
    by_set = saved(by_set)
    named = by_set.join(by_set.groupBy("c").agg(F.min("id").alias("component_id")), "c").select("ref", "component_id")
    if count_links:
        counted = saved(with_copies(classes, members))
        degree = saved(complete_links(rows, counted, found, percent, size).groupBy("ref").agg(F.sum("n").alias("n_linked")))
        sums = counted.join(degree, "ref", "left").select("ref", (F.col("copies") - 1 + F.coalesce("n_linked", F.lit(0))).alias("n_links"))
        named = saved(named.join(sums, "ref"))
    out = members.join(named, "ref", "left")
    n_links = F.coalesce("n_links", F.lit(0)) if count_links else F.lit(None)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), n_links.cast("long").alias("n_links"))


def linked_pairs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """id_a, id_b of all linked pairs of distinct sets, each set by the least of its ids."""
    rows, members, classes, found = find_components(documents, id_col, text_col, percent, size)
    pairs = complete_links(rows, with_copies(classes, members), found, percent, size, pairs=True)
    names = classes.select("ref", "id")
    named = pairs.join(names.select(F.col("ref").alias("a"), F.col("id").alias("id_a")), "a").join(names.select(F.col("ref").alias("b"), F.col("id").alias("id_b")), "b")
    return named.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """The documents' rows with one of each class: the one of least id; of rows that repeat an id, one stays.

    Rows without an id have no class and stay.
    """
    marked = cluster(documents.filter(F.col(id_col).isNotNull()), id_col, text_col, percent, size, count_links=False)
    dropped = saved(marked.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("id")).distinct())
    repeated = saved(documents.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).count().filter("count > 1").select("id"))
    suspects = dropped.union(repeated)
    kept = by_map(documents, suspects, id_col, False)
    left = by_map(documents, suspects, id_col, True).join(dropped, F.col(id_col) == dropped.id, "left_anti")
    if not repeated.isEmpty():
        null_ids = left.filter(F.col(id_col).isNull())
        left = left.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(null_ids)
    return kept.unionByName(left)
