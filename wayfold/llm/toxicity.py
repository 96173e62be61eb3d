"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are presences of character 3- to 5-grams of the lower-cased text, hashed to 2^20 buckets. For each bucket
r = log((p + a) / |p|) - log((q + a) / |q|) over toxic (p) and other (q) labelled texts; a logistic regression is fitted
on the presences scaled by r, with an L2 penalty. Only buckets with |r| of at least ``MIN_RATIO`` and at least
``MIN_DF`` texts are kept, which leaves the n-grams that tell the classes apart.

Fitting takes a sample of at most ``most_toxic`` + ``most_other`` labelled texts, those with the least hash of their id,
in one executor task; the fitted weights (4 MB at most) are what the driver sees. Scoring is a narrow pass over all
whole texts.

Edge cases: null and empty texts have no n-grams and get the score of the intercept; documents without label are only
scored; null labels are ignored and a document labelled twice is toxic if any label says so; with no labelled text of
one of the classes, every score is the share of toxic labels (0.0 without labels, so predicted 0); texts of any length
are hashed whole, piece by piece; a score of exactly 0.5 is predicted 1; repeated rows are scored each for itself and
count once each in fitting; an empty table gives an empty result; columns that aren't carried are not read, and carried
ones come in a struct ``carried``, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import drop_kept, release_memory, small_batches

BITS, SIZES = 20, (3, 4, 5)
MAX_TOXIC, MAX_OTHER, MIN_DF, MIN_RATIO, SMOOTH = 3000, 5000, 3, 1.0, 0.5
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Characters of a text that are hashed at once: bounds the memory for very long texts.
CHUNK = 1 << 16


def grams(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of the n-grams of a lower-cased text, in pieces."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for at in range(0, max(len(points), 1), CHUNK):
        c = points[at : at + CHUNK + max(SIZES) - 1]
        h = c
        for n in range(2, max(SIZES) + 1):
            if len(c) < n:
                break
            h = (h[:-1] * STEP) ^ c[n - 1 :]
            h += h >> np.uint64(29)
            if n in SIZES:
                mixed = (h[: CHUNK] + np.uint64(n)) * STEP
                yield (mixed >> np.uint64(64 - BITS)).astype(np.int32)


def presences(text: str | None) -> np.ndarray:
    found = list(grams(text or ""))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 150, penalty: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights by bucket and the intercept."""
    weights = np.zeros(1 << BITS, np.float32)
    toxic = np.asarray(toxic, bool)
    n_pos, n_neg = int(toxic.sum()), int((~toxic).sum())
    if not n_pos or not n_neg:
        share = min(max(n_pos / max(1, n_pos + n_neg), 1e-6), 1 - 1e-6)
        return weights, float(np.log(share / (1 - share))) if n_pos + n_neg else -20.0
    df = [np.zeros(1 << BITS, np.float64) for _ in range(2)]
    for t, y in zip(texts, toxic, strict=True):
        df[int(y)][presences(t)] += 1
    p, q = df[1] + SMOOTH, df[0] + SMOOTH
    ratio = np.log(p / (n_pos + 2 * SMOOTH)) - np.log(q / (n_neg + 2 * SMOOTH))
    keep = (df[0] + df[1] >= MIN_DF) & (np.abs(ratio) >= MIN_RATIO)
    columns = np.full(1 << BITS, -1, np.int32)
    columns[keep] = np.arange(keep.sum(), dtype=np.int32)
    r = ratio[keep]
    kept = [c[c >= 0] for c in (columns[presences(t)] for t in texts)]  # hashed again: all presences at once are some hundred MB
    lengths = np.array([len(k) for k in kept])
    cols = np.concatenate(kept) if len(kept) else np.zeros(0, np.int32)
    rows = np.repeat(np.arange(len(kept)), lengths)
    y = toxic.astype(np.float64)
    balance = np.where(toxic, 0.5 / n_pos, 0.5 / n_neg) * len(y)
    scale = 1.0 / np.sqrt(np.maximum(1.0, np.bincount(cols, minlength=len(r)) * r * r))
    w, b = np.zeros(len(r)), 0.0
    seen_w, seen_b = np.zeros(len(r)), 0.0
    for t in range(rounds):  # gradient steps with momentum, preconditioned by each column's second moment
        z = np.bincount(rows, (w * r)[cols], minlength=len(y)) + b
        e = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(cols, e[rows], minlength=len(r)) * r + penalty * len(y) * 0.01 * w
        seen_w, seen_b = 0.9 * seen_w + g * scale * scale * 0.5, 0.9 * seen_b + e.mean()
        w -= seen_w * 0.05
        b -= seen_b * 0.2
    weights[keep] = (w * r).astype(np.float32)
    return weights, float(b)


def score(text: str | None, weights: np.ndarray, used: np.ndarray, bias: float) -> float:
    hit = [g[used[g]] for g in grams(text or "")]
    z = bias + (float(weights[np.unique(np.concatenate(hit))].sum(dtype=np.float64)) if hit else 0.0)
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = MAX_TOXIC, most_other: int = MAX_OTHER):
    """Fit on labelled documents, at most so many of each class; labels should hold the rows to learn from only."""
    documents = small_batches(documents)
    one = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).alias("y"))
    ordered = one.orderBy(F.xxhash64("id"), "id")
    sample = ordered.filter("y").limit(most_toxic).union(ordered.filter("not y").limit(most_other))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    picked = texts.join(F.broadcast(sample), "id").select("id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        rows = sorted({(i, t or "", y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True)})
        weights, bias = fit([t for _, t, _ in rows], np.array([y for _, _, y in rows], bool))
        at = np.flatnonzero(weights).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([weights[at].tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["at", "w", "b"])

    return picked.repartition(1).mapInArrow(run, "at binary, w binary, b double").first()


def score_documents(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", carry: tuple[str, ...] = (), most_toxic: int = MAX_TOXIC, most_other: int = MAX_OTHER
) -> DataFrame:
    """Documents' id with score (0 to 1) and predicted (1 from 0.5); with ``carry`` also a struct ``carried`` of those columns."""
    model = train(documents, labels, id_col, text_col, label_col, most_toxic, most_other)
    at, values, bias = (bytes(model.at), bytes(model.w), model.b) if model else (b"", b"", -20.0)
    extra = [c for c in dict.fromkeys(carry) if c not in (id_col, text_col)]
    rest = [F.struct(*[F.col(f"`{c}`") for c in extra]).alias("rest")] if extra else []
    slim = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *rest)
    kept = slim.columns if carry else ["id"]
    out = slim.select(*kept, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        weights = np.zeros(1 << BITS, np.float32)
        weights[np.frombuffer(at, np.int32)] = np.frombuffer(values, np.float32)
        used = weights != 0
        for batch in batches:
            scores = np.array([score(t.as_py(), weights, used, bias) for t in batch.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])
        release_memory()

    scored = slim.mapInArrow(run, out)
    held = {id_col: F.col("id"), text_col: F.col("text")} | {c: F.col(f"rest.`{c}`") for c in extra}
    carried = [F.struct(*[held[c].alias(c) for c in carry]).alias("carried")] if carry else []
    return scored.select(F.col("id").alias(id_col), "score", "predicted", *carried)
