"""Sorted-string-table shards of token ids.

A shard holds documents in ascending order of their key (the identifier's order-preserving bytes):

    block*      entries with prefix-compressed keys: varint shared, varint unshared, varint size, key rest, value
    filter      Bloom filter over all keys
    index       for each block: its first key, offset, size, crc32 and number of entries
    order       where rows came in an order of their own: the entries' numbers in that order, 32 bits each
    footer      offsets and sizes of filter, index and order, number of entries and ids, version, magic

A value is the document's ids as little-endian unsigned 16-bit integers (32-bit where an id needs it; a leading byte
tells which). ``Shard.get`` searches the Bloom filter, then the index by bisection, then one block; ``Shard.in_order``
reads documents in the order they came in (a mix, say), through the order section.

Writing: rows are range-partitioned by identifier and sorted; each task writes one shard under a name of its own and
returns a manifest row. Spark commits the manifest, so shards of lost or repeated attempts are never read. Shards are
written where spark.checkpoint.dir points, through pyarrow's file systems.

Edge cases: a null text is empty and has the end id only; null identifiers sort first under an own key; equal
identifiers are kept as entries of their own, ordered by a hash of the text and the text; texts of any length are encoded
whole; an empty table gives an empty manifest; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import KEPT, drop_kept, file_system, parts_for, release_memory, saved, shared_dir, small_batches

MAGIC, VERSION, BLOCK, BITS_PER_KEY, PROBES = b"WFSST\x00\x00\x01", 2, 64 << 10, 10, 7
FOOTER = struct.Struct("<QQQQQQQQI8s")


def key_bytes(identifier) -> bytes:
    """Order-preserving bytes: null first, then integers by value, then strings by code point."""
    if identifier is None:
        return b"\x00"
    if isinstance(identifier, int):
        return b"\x01" + struct.pack(">Q", (identifier + (1 << 63)) & ((1 << 64) - 1))
    return b"\x02" + str(identifier).encode()


def identifier_of(key: bytes):
    if key == b"\x00":
        return None
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] == 1 else key[1:].decode()


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(buf, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def pack_ids(ids: np.ndarray) -> bytes:
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or int(ids.max()) < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def unpack_ids(value) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1)


def probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Writes one shard; entries come in ascending order of key."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0
        self.block, self.first, self.last = bytearray(), b"", b""
        self.keys: list[bytes] = []
        self.index = bytearray()
        self.blocks = self.entries = self.ids = self.in_block = 0
        self.places = array("q")

    def add(self, key: bytes, value: bytes, n_ids: int, place: int | None = None) -> None:
        shared = 0
        if self.block:
            top = min(len(key), len(self.last))
            while shared < top and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:]
        self.block += value
        if not self.entries or key != self.last:
            self.keys.append(xxhash.xxh3_128_digest(key))
        self.last = key
        self.entries += 1
        self.in_block += 1
        if place is not None:
            self.places.append(place)
        self.ids += n_ids
        if len(self.block) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.block:
            self.sink.write(bytes(self.block))
            self.index += varint(len(self.first)) + self.first + varint(self.at) + varint(len(self.block)) + varint(zlib.crc32(self.block)) + varint(self.in_block)
            self.at += len(self.block)
            self.blocks += 1
            self.block, self.in_block = bytearray(), 0

    def close(self) -> None:
        self.flush()
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for digest in self.keys:
            h = int.from_bytes(digest, "big")
            a, b = h & ((1 << 64) - 1), h >> 64 | 1
            for i in range(PROBES):
                p = (a + i * b) % bits
                bloom[p >> 3] |= 1 << (p & 7)
        body = varint(bits) + bloom.tobytes()
        index = varint(self.blocks) + bytes(self.index) + varint(len(self.last)) + self.last
        order = np.argsort(np.frombuffer(self.places, np.int64), kind="stable").astype("<u4").tobytes() if len(self.places) else b""
        ends = self.at + len(body) + len(index)
        self.sink.write(body + index + order + FOOTER.pack(self.at, len(body), self.at + len(body), len(index), ends, len(order), self.entries, self.ids, VERSION, MAGIC))


class Shard:
    """Reads one shard from a random-access file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        raw = self._read(size - FOOTER.size, FOOTER.size)
        f_at, f_size, i_at, i_size, self.order_at, self.order_size, self.entries, self.ids, version, magic = FOOTER.unpack(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of this format")
        body, index = self._read(f_at, f_size), self._read(i_at, i_size)
        self.bits, at = read_varint(body, 0)
        self.bloom = np.frombuffer(body, np.uint8, offset=at)
        n, at = read_varint(index, 0)
        self.first, self.blocks, self.counts = [], [], []
        for _ in range(n):
            k, at = read_varint(index, at)
            self.first.append(bytes(index[at : at + k]))
            offset, at = read_varint(index, at + k)
            length, at = read_varint(index, at)
            crc, at = read_varint(index, at)
            count, at = read_varint(index, at)
            self.blocks.append((offset, length, crc))
            self.counts.append(count)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> Iterator[tuple[bytes, memoryview]]:
        offset, length, crc = self.blocks[i]
        raw = self._read(offset, length)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"block {i} is damaged")
        at, key, view = 0, b"", memoryview(raw)
        while at < len(raw):
            shared, at = read_varint(raw, at)
            rest, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, view[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, memoryview]]:
        for i in range(len(self.blocks)):
            yield from self._block(i)

    def order(self) -> np.ndarray:
        """Numbers of the entries (by key) in the order their rows came in."""
        return np.frombuffer(self._read(self.order_at, self.order_size), "<u4") if self.order_size else np.arange(self.entries, dtype="<u4")

    def in_order(self, held: int = 64) -> Iterator[tuple[bytes, np.ndarray]]:
        """(key, ids) in the order the rows came in; the last ``held`` blocks stay decoded."""
        starts = np.concatenate([[0], np.cumsum(self.counts)])
        decoded: dict[int, list] = {}
        for number in self.order().tolist():
            i = int(np.searchsorted(starts, number, "right")) - 1
            block = decoded.pop(i, None) or list(self._block(i))
            decoded[i] = block
            if len(decoded) > held:
                del decoded[next(iter(decoded))]
            key, value = block[number - int(starts[i])]
            yield key, unpack_ids(value)

    def get(self, identifier) -> list[np.ndarray]:
        """Ids of all entries of an identifier."""
        key = key_bytes(identifier)
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, self.bits)):
            return []
        i = max(0, bisect_right(self.first, key) - 1)
        while i and self.first[i] == key:
            i -= 1
        out = []
        while i < len(self.blocks) and self.first[i] <= key:
            out += [unpack_ids(v) for k, v in self._block(i) if k == key]
            i += 1
        return out


def open_shard(uri: str) -> Shard:
    fs, path = file_system(uri)
    return Shard(fs.open_input_file(path))


#: Pieces of text whose ids a worker remembers (some 200 bytes each), and code points that are encoded at once.
REMEMBERED, TOGETHER = 800_000, 1 << 21
#: Pieces that are encoded as one string; marks, and some letters that the tokenizer's rule parts from them.
CHUNK, MARKS, LETTERS = 64, ".,;:!?", "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0400-\u0481"
#: White space but spaces and new lines. BORDER drops the space before a piece.
OTHER_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
BORDER = re.compile(r"(?<=\S)\x20(?=\S)")


class Encoder:
    """Encodes whole texts with the tokenizers library, each distinct piece of some texts once.

    A byte-level BPE tokenizer never joins a word with the space that follows it, so a text may be cut before a single
    space between two non-spaces without changing its ids; nor a letter with the mark behind it, nor anything with a
    new line between two non-spaces. Unknown parts are encoded some at a time as one text and cut again before the ids that
    start with a space or a new line; if that does not give one part a piece, they are encoded one by one. Texts that hold
    a special token's string are encoded whole.
    """

    def __init__(self, tokenizer_file: str, remembered: int | None = None, together: int | None = None):
        self.remembered, self.together = remembered or REMEMBERED, together or TOGETHER
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        top = max(vocabulary.values(), default=0)
        self.dtype, self.mark = ("<u4", b"\x04") if top > 65535 else ("<u2", b"\x02")
        self.leads = np.zeros(top + 1, np.bool_)
        self.leads[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # how byte-level BPE writes a space
        self.lines = np.zeros(top + 1, np.bool_)
        self.lines[[i for t, i in vocabulary.items() if t.startswith("\u010a")]] = True  # a new line
        whole = json.loads(self.tokenizer.to_str())
        pre = whole.get("pre_tokenizer") or {}
        self.cut = not whole.get("normalizer") and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space")
        self.memory: dict[str, bytes] = {}
        self.missed = 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined_ids(self, strings: list[str], leads: np.ndarray) -> list[bytes]:
        """Ids of strings that begin with a mark of which each id that ``leads`` names begins one; encoded together."""
        if not strings:
            return []
        chunks = ["".join(strings[i : i + CHUNK]) for i in range(0, len(strings), CHUNK)]
        made = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in made), self.dtype)
        starts = np.flatnonzero(leads[ids])
        if len(starts) != len(strings) or starts[0] != 0:
            return self._encode(strings)
        raw, width = ids.tobytes(), ids.itemsize
        at = (starts * width).tolist()
        return [raw[i:j] for i, j in zip(at, [*at[1:], len(raw)], strict=True)]

    def _odd(self, text: str) -> bool:
        """It holds white space beside a space, or other than spaces and new lines: only plain spaces are cut at."""
        return "  " in text or " \n" in text or "\n " in text or any(c in text for c in OTHER_SPACES)

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; new ones are encoded and remembered.

        A piece stands for itself with a space before it, unless it begins with a new line, or with a \\0 for nothing.
        """
        found = list(map(self.memory.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        if not new:
            return found
        words, lines, bare = [], [], []
        for i in new:
            x = pieces[i]
            # white space at a piece's end would change the cut of its neighbour
            (bare if not x or x[0] == "\0" or x[-1].isspace() or x[0].isspace() and x[0] != "\n" else lines if x[0] == "\n" else words).append(i)
        for group, ids in (
            (words, self._joined_ids([" " + pieces[i] for i in words], self.leads)),
            (lines, self._joined_ids([pieces[i] for i in lines], self.lines)),
            (bare, self._encode([x[1:] if (x := pieces[i])[:1] == "\0" else x if x[:1] == "\n" else " " + x for i in bare])),
        ):
            for i, made in zip(group, ids, strict=True):
                found[i] = made
        if len(self.memory) < self.remembered:
            self.memory.update((pieces[i], found[i]) for i in new)
        else:
            self.missed += len(new)
            if self.missed > 20 * self.remembered:  # the texts have changed: learn anew
                self.memory, self.missed = {}, 0
        return found

    def _joined(self, lists: pa.Array) -> list[bytes]:
        """Ids of texts that are lists of pieces: each distinct piece is looked up once, the rest is gathering."""
        cuts = lists.offsets.to_numpy()
        pieces = lists.values.slice(cuts[0], cuts[-1] - cuts[0])
        cuts = cuts - cuts[0]
        coded = pieces.dictionary_encode()
        first = pieces.take(pa.array(cuts[:-1])).dictionary_encode()  # no space stands before them
        ids = self._known(coded.dictionary.to_pylist()) + self._encode(first.dictionary.to_pylist())
        at = coded.indices.to_numpy().astype(np.int64)
        at[cuts[:-1]] = first.indices.to_numpy().astype(np.int64) + len(coded.dictionary)
        gathered = pa.array(ids, pa.large_binary()).take(pa.array(at))
        _, offsets, data = gathered.buffers()
        ends = np.frombuffer(offsets, np.int64, len(gathered) + 1)[cuts].tolist()
        raw = memoryview(data) if data is not None else memoryview(b"")
        return [bytes(raw[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]

    def _some(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        whole, plain, odd = [], [], []
        for i, t in enumerate(texts):
            (whole if not self.cut or "\0" in t or any(s in t for s in self.special) else odd if self._odd(t) else plain).append(i)
        done = [(whole, self._encode([texts[i] for i in whole]))] if whole else []
        if plain:
            column = pa.array([texts[i] for i in plain], pa.large_string())
            column = pc.replace_substring_regex(column, f"([{LETTERS}])([{MARKS}])", "\\1 \0\\2")
            for _ in range(2):  # a character between two new lines is seen by one of the turns
                column = pc.replace_substring_regex(column, r"([^\s\x00])\n(\S)", "\\1 \n\\2")
            done.append((plain, self._joined(pc.split_pattern(column, " "))))
        if odd:
            done.append((odd, self._joined(pa.array([BORDER.split(texts[i]) for i in odd], pa.large_list(pa.large_string())))))
        for places, ids in done:
            for i, made in zip(places, ids, strict=True):
                out[i] = made
        return out

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian integers of ``dtype``."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= self.together:
                yield from self._some(some)
                some, size = [], 0
        yield from self._some(some)


_encoders: dict[tuple, Encoder] = {}
KEPT.append(_encoders)


def encoder(*made_with) -> Encoder:
    """The worker's encoder of a tokenizer's file, pieces remembered and code points together."""
    if made_with not in _encoders:
        _encoders.clear()
        _encoders[made_with] = Encoder(*made_with)
    return _encoders[made_with]


def write_shards(
    documents: DataFrame,
    tokenizer_file: str,
    end_id: int,
    where: str | None = None,
    shards: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_col: str | None = None,
    order_col: str | None = None,
    remembered: int = REMEMBERED,
    together: int = TOGETHER,
) -> DataFrame:
    """Write all documents as shards; the manifest: shard, uri, entries, ids, first and last key, bytes.

    Shards hold ranges of identifiers, one for each ``PART_BYTES`` of input but as many as shuffle partitions at least;
    where ``shard_col`` names a column of shard numbers, they hold what it says. ``order_col`` (long) names the rows'
    order inside a shard, which the shard then keeps beside its keys. Workers remember the ids of so many pieces and encode
    so many code points together: fewer take less memory and more time.
    """
    spark = small_batches(documents).sparkSession
    folder = (where or shared_dir(spark)).rstrip("/")
    place = (F.col(order_col) if order_col else F.lit(None)).cast("bigint").alias("place")
    slim = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), place, *([F.col(shard_col).cast("int").alias("shard")] if shard_col else []))
    by = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    if shard_col:
        shards = 1 + (slim.agg(F.max("shard")).first()[0] or 0)
        dealt = slim.repartitionById(shards, F.col("shard")).drop("shard")
    else:
        # identifier first; the text's hash splits an identifier that many rows share
        dealt = slim.repartitionByRange(shards or parts_for(documents), *by)
    ranged = dealt.sortWithinPartitions(*by, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        drop_kept(_encoders)
        encode = encoder(tokenizer_file, remembered, together)
        end = np.array([end_id], encode.dtype).tobytes()
        width = len(end)
        writer = sink = first = None
        name = f"{folder}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.sst"
        for batch in batches:
            texts = (t.as_py() for t in batch.column(1))
            for i, ids, place in zip(batch.column(0), encode(texts), batch.column(2).to_pylist(), strict=True):
                if writer is None:
                    fs, path = file_system(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(path)
                    writer = Writer(sink)
                    first = key_bytes(i.as_py())
                ids += end
                writer.add(key_bytes(i.as_py()), encode.mark + ids, len(ids) // width, place)
        if writer is not None:
            writer.close()
            size = sink.tell()
            sink.close()
            release_memory()
            yield pa.RecordBatch.from_pylist([dict(shard=TaskContext.get().partitionId(), uri=name, entries=writer.entries, ids=writer.ids, first_key=first, last_key=writer.last, bytes=size)])

    return saved(ranged.mapInArrow(run, "shard long, uri string, entries long, ids long, first_key binary, last_key binary, bytes long"), f"{folder}/manifest")


def read_shards(manifest: DataFrame, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """Per document, from the files: id, shard, start (ids before it), n_tokens, ids_crc32, position (in the order of the
    shards and of their rows as they came in).
    """
    by_shard = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)  # a manifest row a shard
    before = lambda c: (F.sum(c).over(by_shard) - F.col(c)).alias(f"{c}_before")
    starts = manifest.select("shard", "uri", "ids", "entries").select("shard", "uri", before("ids"), before("entries"))
    n = max(1, manifest.count())
    key_type = pa.string() if id_type == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, uri, start, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, begins, sizes, crcs = [], [], [], []
                shard = open_shard(uri)
                for key, value in shard:
                    tokens = unpack_ids(value)
                    ids.append(identifier_of(key))
                    begins.append(start)
                    sizes.append(len(tokens))
                    crcs.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                    start += len(tokens)
                places = np.empty(len(ids), np.int64)
                places[shard.order()] = np.arange(first, first + len(ids))
                columns = [pa.array(ids, key_type), pa.array([number] * len(ids), pa.int64()), *(pa.array(c, pa.int64()) for c in (begins, sizes, crcs, places))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "shard", "start", "n_tokens", "ids_crc32", "position"])

    return starts.repartitionByRange(n, "shard").mapInArrow(run, f"`{id_col}` {id_type}, shard long, start long, n_tokens long, ids_crc32 long, position long")


def lookup(manifest: DataFrame, identifiers: list) -> dict:
    """Token ids of a few identifiers, by bisection in the shards whose key range holds them."""
    out: dict = {}
    for i in identifiers:
        key = bytearray(key_bytes(i))
        held = manifest.filter((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key))).select("uri").collect()
        out[i] = [ids for r in held for ids in open_shard(r.uri).get(i)]
    return out
