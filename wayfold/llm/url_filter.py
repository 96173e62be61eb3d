"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

Glob rules are packed into multiword Shift-And masks. A pattern of m literal tokens takes m + 1 bits, one per
state; a star is a self-loop on the state it follows. One step over a character moves all states of all patterns:

    D = ((D << 1) & B[c]) | (D & S[c])

B[c] holds the states a literal c leads to and S[c] the states that stay on c. The simulation runs over a batch of
URLs at once with numpy words, so its cost is URL bytes x words and does not depend on the number of matches.

Glob syntax: ``*`` any run without ``/``; ``**`` any run; ``?`` one character other than ``/``; ``\\x`` the character x.

Canonical URL: ``.`` + host + path, host lower-cased (A-Z) and without scheme, query and fragment. The leading dot lets
``**.example.com/`` mean the host and its subdomains.

Edge cases: a null URL or one without ``://`` has an empty host and path and is matched as ``.``; a URL of any length is
matched whole; of rules of equal length that fit, the first listed decides; repeated rows are judged each for itself; an
empty table gives an empty result; columns besides the id and the URL are not read and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ANY, NOT_SLASH = object(), object()

#: Rules (verdict, host, path): the longest that fits decides.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Globs that block a URL which no rule fits; all other URLs are allowed.
BLOCK_GLOBS = (
    "**cheap-pills.**",
    "**casino-**",
    "**free-bets.**",
    "**spam-farm.**",
    "**ads-track.**",
    "**/ads/**",
    "**/login*",
    "**.exe",
)


def parse_glob(glob: str) -> list:
    """Literal bytes (int), NOT_SLASH for '?', and ('loop', kind) for stars."""
    out: list = []
    raw, i = glob.encode(), 0
    while i < len(raw):
        c = raw[i : i + 1]
        if c == b"*":
            wide = raw[i + 1 : i + 2] == b"*"
            out.append(("loop", ANY if wide else NOT_SLASH))
            i += 2 if wide else 1
            continue
        if c == b"?":
            out.append(NOT_SLASH)
        elif c == b"\\" and i + 1 < len(raw):
            i += 1
            out.append(raw[i])
        else:
            out.append(raw[i])
        i += 1
    return out


def escape_glob(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


@dataclass
class ShiftAnd:
    """Masks of all patterns; ends[p] is the bit of pattern p's last state."""

    start: np.ndarray
    follow: np.ndarray
    stay: np.ndarray
    ends: list[int]

    @classmethod
    def of(cls, globs: list[str]) -> ShiftAnd:
        parsed = [parse_glob(g) for g in globs]
        states = sum(1 + sum(not isinstance(t, tuple) for t in p) for p in parsed)
        words = max(1, -(-states // 64))
        start = np.zeros(words, np.uint64)
        follow, stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        ends, bit = [], 0

        def put(mask: np.ndarray, at: int) -> None:
            mask[at // 64] |= np.uint64(1 << (at % 64))

        for p in parsed:
            put(start, bit)
            for t in p:
                if isinstance(t, tuple):
                    for c in range(256):
                        if t[1] is ANY or c != 0x2F:
                            put(stay[c], bit)
                    continue
                bit += 1
                for c in [t] if isinstance(t, int) else [c for c in range(256) if c != 0x2F]:
                    put(follow[c], bit)
            ends.append(bit)
            bit += 1
        return cls(start, follow, stay, ends)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Boolean [text, pattern]: does the pattern match the whole text?"""
        n, words = len(texts), len(self.start)
        lengths = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if n else np.zeros(0, np.int64)
        flat = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
        starts, sorted_lengths = starts[order], lengths[order]
        state = np.repeat(self.start[None, :], n, axis=0)
        one, top = np.uint64(1), np.uint64(63)
        alive = n
        for j in range(int(sorted_lengths[0]) if n else 0):
            while alive and sorted_lengths[alive - 1] <= j:
                alive -= 1
            c, d = flat[starts[:alive] + j], state[:alive]
            moved = d << one
            if words > 1:
                moved[:, 1:] |= d[:, :-1] >> top
            state[:alive] = (moved & self.follow[c]) | (d & self.stay[c])
        hit = np.empty((n, len(self.ends)), bool)
        for p, bit in enumerate(self.ends):
            hit[order, p] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one == one
        return hit


UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without '://'."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    host, slash, path = rest.partition("/")
    return host.translate(UPPER_TO_LOWER), slash + path


#: So many rules and globs a filter takes at most: each worker holds masks of 512 bytes for every state of theirs.
MOST_RULES = 20_000


def rules_of(table: DataFrame) -> list[tuple[str, str, str]]:
    """The rules of a table (verdict, host, path), whose number is checked; they are part of every task."""
    rows = table.select("verdict", "host", "path").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: split them into several filters")
    return [tuple(r) for r in rows]


def filter_urls(
    pages: DataFrame,
    rules=RULES,
    block_globs=BLOCK_GLOBS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: id, host, path, the longest fitting rule (or null), the verdict, and the globs that hit."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    globs = [f"**.{escape_glob(h)}{escape_glob(p)}**" for _, h, p in ranked]
    # A rule's host part must not reach into the path, so its leading star excludes '/'.
    globs = ["*" + g[2:] for g in globs] + list(block_globs)
    id_field = pages.schema[id_col]
    slim = pages.select(id_col, url_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd.of(globs)
        for batch in batches:
            split = [split_url(u) for u in batch.column(1).to_pylist()]
            hits = automaton.match([f".{h}{p}".encode() for h, p in split])
            rule, verdict, matched = [], [], []
            for row in hits:
                by_rule = row[: len(ranked)]
                own = [block_globs[i] for i in np.flatnonzero(row[len(ranked) :])]
                matched.append(own)
                if by_rule.any():
                    kind, host, path = ranked[int(by_rule.argmax())]
                    rule.append(host + path)
                    verdict.append(kind)
                else:
                    rule.append(None)
                    verdict.append("block" if own else "allow")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in split], pa.string()),
                    pa.array([p for _, p in split], pa.string()),
                    pa.array(rule, pa.string()),
                    pa.array(verdict, pa.string()),
                    pa.array(matched, pa.list_(pa.string())),
                ],
                names=[id_col, "host", "path", "rule", "verdict", "globs"],
            )

    schema = f"`{id_col}` {id_field.dataType.simpleString()}, host string, path string, rule string, verdict string, globs array<string>"
    return slim.mapInArrow(judge, schema)
