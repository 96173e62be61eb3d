"""Personal data: pattern seeds and bootstrapped contextual extraction.

Seeds are the spans of four fixed patterns (email, ip, card, phone) and of assigned credentials (secret). Every token
with three digits or an @, every run of up to ``RUN`` such tokens and every spelled-out address ("a at b dot c") that no
base span covers is a candidate. Seeds and candidates alike have lexical patterns: the two words before, the words on
both sides, the word before with the shape, the shape with its first character, and the shape.

Spark scores the bipartite graph of patterns and instances in rounds, up to the fixed point. For a pattern and a kind,
``pos`` instances are known to be of the kind, ``neg`` of another one or refuted (they look like a kind but fail its
check), and the rest are unknown. A pattern is accepted when pos >= SUPPORT, pos / (pos + neg + 1) >= CONFIDENCE,
pos / all >= SHARE, and the log-likelihood of that share against the kind's share among all instances (one half at
most) is at least MARGIN + ln(number of patterns with support), so that chance contexts of a large corpus don't pass.
Unknown instances of an accepted pattern become known and support further patterns. Refuted ones are taken from contexts
(words), never from shapes alone. What is accepted stays accepted, so rounds end.

Edge cases: null and empty texts have no spans; a text of any length is scanned whole, in time in proportion to its
length; overlapping base spans of different kinds are all kept; an added span overlaps no base span and no other added
one (of two, the one of higher confidence stays, then the longer, then the earlier); a candidate in patterns of several
kinds takes the one of highest confidence, then of greatest name; words beyond ``LONG`` characters stand for themselves
by a hash; repeated rows each get their own spans; null ids are kept; an empty table gives an empty result; only the
named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import saved, small_batches

KINDS = ("email", "ip", "card", "phone")
#: What the method finds beside the base kinds.
ALL_KINDS = (*KINDS, "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9.]*\.[0-9.]*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Credentials that a program's text assigns.
SECRET = re.compile(r"\b(?:api_?key|access_?key|secret|token|passwd|password)\s*[=:]\s*([\"'])([A-Za-z0-9+/_-]{20,})\1")
PIECE = re.compile(r"[^\s\"'<>|,;!?*#$%&=\[\]{}]+")
NUMBER = re.compile(r"[+(]?[0-9][0-9().-]*")
AT = re.compile(r"\x20?(?:\(at\)|\[at\])\x20?|\x20at\x20", re.I)
SPELLED = re.compile(r"[A-Za-z0-9-]+(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20|\.)[A-Za-z0-9-]+)+", re.I)

#: Least known instances, confidence, share and margin of a pattern; most tokens of a run; longest word kept as it is.
SUPPORT, CONFIDENCE, SHARE, MARGIN, RUN, LONG = 5, 0.8, 0.5, 3.0, 4, 48
#: So many accepted patterns are broadcast at most (some 100 bytes each); beyond, they are joined by shuffle.
BROADCAST_PATTERNS = 100_000


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    out = []
    for m in DOTTED.finditer(text):
        at, groups = m.start(), []
        for g in m[0].split("."):
            groups.append((at, g))
            at += len(g) + 1
        i = 0
        while i + 4 <= len(groups):
            four = groups[i : i + 4]
            if all(g for _, g in four):
                if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for _, g in four):
                    out.append((four[0][0], four[3][0] + len(four[3][1])))
                i += 4
            else:
                i += 1
    return out


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by kind as listed, then by start."""
    text = text or ""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *s) for s in addresses(text)] + [("card", *s) for s in cards(text)]
        out += [("phone", *s) for s in phones(text)] if "+" in text else []
    return out


def secrets(text: str) -> list[tuple[int, int]]:
    return [m.span(2) for m in SECRET.finditer(text)]


def _short(word: str) -> str:
    return word if len(word) <= LONG else "~" + xxhash.xxh3_64_hexdigest(word.encode("utf-8", "surrogatepass"))


def _word(piece: str) -> str:
    return _short(re.sub(r"[0-9]+", "0", piece.lower().strip(".,;:!?()[]{}\"'<>|*#$%&")))


def words_before(text: str, at: int, n: int) -> list[str]:
    """The n words that end before a position, nearest last; pieces of marks only don't count."""
    out: list[str] = []
    while at > 0 and len(out) < n:
        while at > 0 and text[at - 1].isspace():
            at -= 1
        end = at
        while at > 0 and not text[at - 1].isspace():
            at -= 1
        word = _word(text[at:end])
        if word:
            out.append(word)
    return out[::-1]


def word_after(text: str, at: int) -> str:
    """The first word that begins after a position."""
    n = len(text)
    while at < n:
        while at < n and text[at].isspace():
            at += 1
        begin = at
        while at < n and not text[at].isspace():
            at += 1
        word = _word(text[begin:at])
        if word:
            return word
    return ""


def shape(instance: str) -> str:
    """Digits as d and letters as a, runs beyond four by their length; hexadecimal words as one run."""
    if len(instance) >= 16 and re.fullmatch(r"[0-9a-fA-F]+", instance) and not instance.isdigit():
        return f"x{len(instance)}"
    if "@" in instance:
        return "a@a"

    def run(m: re.Match) -> str:
        c, n = "d" if m[0][0].isdigit() else "a", len(m[0])
        return c * n if n <= 4 and c == "d" else c if c == "a" else f"d{n}"

    return _short(re.sub(r"[0-9]+|[^\W\d_]+", run, instance))


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a span; those of shape alone begin with #, which no word does."""
    form = shape(text[start:end])
    before, after = words_before(text, start, 2), word_after(text, end)
    out = [f"#{form}", f"#{text[start]}#{form}"]
    if before:
        out.append(f"{before[-1]} _{form}")
        if after:
            out.append(f"{before[-1]} _ {after}")
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    return out


def refuted(instance: str) -> bool:
    """It looks like a card, an address or a phone number but fails the check."""
    digits = [c for c in instance if "0" <= c <= "9"]
    if len(digits) == len(instance.replace(" ", "").replace("-", "")):
        return 13 <= len(digits) <= 19 and not luhn("".join(digits))
    if re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", instance):
        return any(len(g.lstrip("0")) > 3 or int(g.lstrip("0") or 0) > 255 for g in instance.split("."))
    return instance[:1] == "+" and not 9 <= len(digits) <= 15


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of candidates, none of which overlaps a taken span (sorted by start)."""
    found: set[tuple[int, int]] = set()
    tokens: list[tuple[int, int]] = []
    if DIGIT.search(text) or "@" in text:
        for m in PIECE.finditer(text):
            piece = m[0]
            if not DIGIT.search(piece) and "@" not in piece:
                continue
            start, end = m.start(), m.end()
            while start < end and text[start] in ".:-_/)":
                start += 1
            while start < end and text[end - 1] in ".:-_/(":
                end -= 1
            if start < end:
                tokens.append((start, end))
    for i, (start, _) in enumerate(tokens):
        for j in range(i, min(i + RUN, len(tokens))):
            end = tokens[j][1]
            if j > i and (text[tokens[j - 1][1] : tokens[j][0]] != " " or not NUMBER.fullmatch(text, *tokens[j]) or not NUMBER.fullmatch(text, *tokens[i])):
                break
            piece = text[start:end]
            at = piece.find("@")
            if 0 < at < len(piece) - 1 or sum("0" <= c <= "9" for c in piece) >= 3:
                found.add((start, end))
    for m in AT.finditer(text):
        start, tail = m.start(), SPELLED.match(text, m.end())
        while tail and start > 0 and text[start - 1] in LOCAL:
            start -= 1
        if tail and start < m.start():
            found.add((start, tail.end()))
    out, at = [], 0
    for start, end in sorted(found):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at == len(taken) or taken[at][0] >= end:
            out.append((start, end))
    return out


def occurrences(text: str | None, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds and candidates with their patterns; kind is null for candidates and 'no' for refuted ones."""
    text = text or ""
    known = [(k, s, e) for k, s, e in spans]
    known += [("secret", s, e) for s, e in secrets(text) if not any(s < e2 and s2 < e for _, s2, e2 in spans)]
    taken = sorted((s, e) for k, s, e in known if k != "secret")
    merged: list[tuple[int, int]] = []
    for s, e in taken:  # spans of different kinds may overlap
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    own = {(s, e) for k, s, e in known}
    rest = [x for x in candidates(text, merged) if x not in own]
    out = known + [("no" if refuted(text[s:e]) else None, s, e) for s, e in rest]
    return [{"kind": k, "pattern": p, "instance": _short(text[s:e].lower()), "start": s, "end": e} for k, s, e in out for p in patterns(text, s, e)]


def accepted_now(linked: DataFrame, shares: dict[str, float], support: int = SUPPORT) -> DataFrame:
    """pattern, kind, confidence of the patterns that pass; linked: pattern, instance, known (a kind, 'no' or null)."""
    counts = [F.count_if(F.col("known") == k).alias(k) for k in (*ALL_KINDS, "no")]
    by_kind = linked.groupBy("pattern").agg(F.count("*").alias("n"), *counts)
    top = F.greatest(*[F.struct(F.col(k).alias("pos"), F.lit(k).alias("kind")) for k in ALL_KINDS])
    judged = sum((F.col(k) for k in (*ALL_KINDS, "no")), F.lit(0))
    scored = by_kind.select("pattern", "n", judged.alias("judged"), top.alias("top")).select("pattern", "n", "judged", "top.*").filter(F.col("pos") >= support)
    scored = scored.withColumn("confidence", F.col("pos") / (F.col("judged") + 1)).withColumn("share", F.col("pos") / F.col("n"))
    null_share = F.element_at(F.create_map(*[F.lit(x) for k in ALL_KINDS for x in (k, shares[k])]), F.col("kind"))
    rest = F.when(F.col("share") < 1, (F.col("n") - F.col("pos")) * F.log((1 - F.col("share")) / (1 - null_share))).otherwise(0.0)
    scored = scored.withColumn("gain", F.when(F.col("share") > null_share, F.col("pos") * F.log(F.col("share") / null_share) + rest).otherwise(0.0))
    return scored.filter((F.col("confidence") >= CONFIDENCE) & (F.col("share") >= SHARE)).select("pattern", "kind", "confidence", "gain")


def bounded(small: DataFrame) -> DataFrame:
    """A saved frame of patterns, broadcast when it is small; else joins shuffle, and AQE splits hot patterns."""
    return F.broadcast(small) if small.count() <= BROADCAST_PATTERNS else small.hint("shuffle_merge")


def accept_patterns(edges: DataFrame) -> DataFrame:
    """pattern, kind, confidence of all accepted patterns; edges: pattern, instance, kind (null unknown, 'no' refuted)."""
    spark = edges.sparkSession
    one_kind = F.coalesce(F.max(F.when(F.col("kind") != "no", F.col("kind"))), F.max("kind"))
    edges = saved(edges.groupBy("pattern", "instance").agg(one_kind.alias("kind")))
    first = saved(edges.groupBy("instance").agg(F.coalesce(F.max(F.when(F.col("kind") != "no", F.col("kind"))), F.max("kind")).alias("known")))
    totals = {r.known: r.n for r in first.groupBy("known").agg(F.count("*").alias("n")).collect()}  # a row a kind
    every = max(1, sum(totals.values()))
    shares = {k: min(0.5, max(1, totals.get(k, 0)) / every) for k in ALL_KINDS}
    seeds = first.filter("known <> 'no'")
    refused = first.filter("known = 'no'")
    supported = edges.filter("kind is not null and kind <> 'no'").groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT).count()
    bar = MARGIN + math.log(max(1, supported))
    accepted = spark.createDataFrame([], "pattern string, kind string, confidence double")
    found = spark.createDataFrame([], "instance string, known string")
    n_accepted = -1
    while True:
        known = seeds.unionByName(found).unionByName(refused.join(found, "instance", "left_anti"))
        linked = edges.select("pattern", "instance").join(known, "instance", "left")
        now = accepted_now(linked, shares).filter(F.col("gain") >= bar).drop("gain")
        # what was accepted before stays so, with its first confidence
        accepted = saved(accepted.unionByName(now.join(accepted.select("pattern"), "pattern", "left_anti")))
        n = accepted.count()
        if n == n_accepted:
            return accepted
        n_accepted = n
        open_edges = edges.filter("kind is null or kind = 'no' and not startswith(pattern, '#')").select("pattern", "instance")
        new = open_edges.join(bounded(accepted), "pattern").join(seeds.select("instance"), "instance", "left_anti")
        found = saved(new.groupBy("instance").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("known")))


def disjoint(spans: list[tuple[float, int, int, str]]) -> list[tuple[str, int, int]]:
    """Of (confidence, start, end, kind), those that overlap none before them: by confidence, then length, then start."""
    from bisect import bisect_left

    starts: list[int] = []
    kept: list[tuple[int, int, str]] = []
    for _, start, end, kind in sorted(spans, key=lambda x: (-x[0], x[1] - x[2], x[1], x[3])):
        i = bisect_left(starts, start)
        if (i and kept[i - 1][1] > start) or (i < len(kept) and kept[i][0] < end):
            continue
        starts.insert(i, start)
        kept.insert(i, (start, end, kind))
    return [(k, s, e) for s, e, k in kept]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SEEN = pa.list_(pa.struct([("kind", pa.string()), ("pattern", pa.string()), ("instance", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SHAPE = "struct<kind: string, start: bigint, end: bigint>"


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, id, base spans and seen occurrences (kind, pattern, instance, start, end) of each document."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, seen = [], []
            for t in batch.column(1):
                text = t.as_py()
                spans = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                seen.append(occurrences(text, spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, SPANS), pa.array(seen, SEEN)], names=["id", "base", "seen"])

    schema = f"id {kind}, base array<{SHAPE}>, seen array<struct<kind: string, pattern: string, instance: string, start: bigint, end: bigint>>"
    slim = small_batches(documents).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id())


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base and extra spans (kind, start, end in code points, end exclusive)."""
    kind = documents.schema[id_col].dataType.simpleString()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = []
            for spans in batch.column(2).to_pylist():
                chosen = disjoint([(x["confidence"], x["start"], x["end"], x["kind"]) for x in spans or ()])
                extra.append([{"kind": k, "start": s, "end": e} for k, s, e in chosen])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(extra, SPANS)], names=["id", "base", "extra"])

    scanned = saved(scan(documents, id_col, text_col))
    edges = scanned.select("uid", F.explode("seen").alias("o")).select("uid", "o.*")
    accepted = accept_patterns(edges.select("pattern", "instance", "kind"))
    open_edges = edges.filter("kind is null or kind = 'no' and not startswith(pattern, '#')").select("uid", "start", "end", "pattern")
    hits = open_edges.join(bounded(accepted), "pattern")
    spans = hits.groupBy("uid", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("top"))
    given = edges.filter("kind = 'secret'").select("uid", "start", "end", F.struct(F.lit(2.0).alias("confidence"), "kind").alias("top")).distinct()
    listed = spans.unionByName(given).groupBy("uid").agg(F.collect_list(F.struct("top.confidence", "start", "end", "top.kind")).alias("found"))
    joined = scanned.select("uid", "id", "base").join(listed, "uid", "left").select("id", "base", "found")
    return joined.mapInArrow(resolve, f"id {kind}, base array<{SHAPE}>, extra array<{SHAPE}>").select(F.col("id").alias(id_col), "base", "extra")


def spans_text(column: str):
    """kind:start:end of all spans, by kind as listed, then by start, joined by commas."""
    rank = "case x.kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(ALL_KINDS)) + " end"
    return F.expr(f"array_join(transform(array_sort(transform({column}, x -> struct({rank} as r, x.start as s, x.end as e, x.kind as kind))), x -> concat(x.kind, ':', x.s, ':', x.e)), ',')")
