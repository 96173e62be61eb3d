"""Bottom-k sketches of word-shingle hashes, in DataFrame expressions only.

A sketch holds the k least distinct 64-bit hashes of a text's shingles (five words, lower-cased, split at white space; a
text of fewer words is one shingle) and the number of distinct shingles that the part at hand had. Sketches of parts
merge by union and cut. From two sketches follow resemblance (shared among the k least of the union), containment, and
the number of distinct shingles (exact below k, (k - 1) / share of the hash range beyond it).

Edge cases: null and blank texts have an empty sketch; two empty sketches are alike (1.0), an empty one and another are
not (0.0); texts of any length are sketched whole; repeated rows are sketched each for itself and follow each other;
null identifiers come last, by a hash of their text; identifiers are whole numbers, others are refused with a TypeError;
an empty table gives an empty result; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WORDS = 128, 5
BLANK = r" \t\n\u000b\u000c\r"  # SQL knows no \f


def _let(value: str, name: str, body: str) -> str:
    """Bind a value once inside an expression: a plain reference could be evaluated for each use."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def shingles(text: str, words: int = WORDS) -> str:
    """SQL for the distinct shingle hashes of a text expression."""
    trimmed = f"btrim(lower(coalesce({text}, '')), '{BLANK}')"
    hashes = f"array_distinct(transform(sequence(1, greatest(size(w) - {words - 1}, 1)), i -> xxhash64(slice(w, i, {words}))))"
    split = _let(f"split(t, '[ \\\\t-\\\\r]+')", "w", hashes)
    return _let(trimmed, "t", f"if(t = '', cast(array() as array<bigint>), {split})")


def sketch(text: str, k: int = K, words: int = WORDS) -> Column:
    """Bottom-k sketch of a text column: array of at most k hashes, ascending."""
    return F.expr(f"slice(sort_array({shingles(text, words)}), 1, {k})")


def merge(a: str, b: str, k: int = K) -> str:
    """SQL for the sketch of the union of two sketched sets."""
    return f"slice(sort_array(array_union({a}, {b})), 1, {k})"


def resemblance(a: str, b: str, k: int = K) -> Column:
    both = _let(merge(a, b, k), "u", f"if(size(u) = 0, 1D, size(array_intersect(array_intersect(u, {a}), {b})) / size(u))")
    return F.expr(f"case when {a} = {b} then 1D else {both} end")


def distinct_count(a: str, k: int = K) -> Column:
    """Estimated number of distinct shingles of a sketched set."""
    span = f"(cast(element_at({a}, {k}) as double) + 9223372036854775808D) / 18446744073709551616D"
    return F.expr(f"if(size({a}) < {k}, cast(size({a}) as double), {k - 1} / ({span}))")


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of the first set that the second holds."""
    joint = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.expr(f"size({a}) = 0"), 1.0).otherwise(F.least(F.lit(1.0), joint / distinct_count(a, k)))


def merge_sketches(parts: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts: the k least distinct hashes of all.

    A part's hashes are ranked after they were made distinct per key and dealt by hash range, so a key with very many
    parts is cut to k hashes in each of 64 ranges before its ranges meet.
    """
    hashes = parts.select(*keys, F.explode(column).alias("h")).distinct()
    dealt = hashes.withColumn("range", F.shiftright("h", 58))
    near = dealt.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "range").orderBy("h"))).filter(F.col("n") <= k)
    return near.groupBy(*keys).agg(F.expr(f"slice(sort_array(collect_list(h)), 1, {k})").alias(column))


#: Rows a bucket holds on average, quantiles of the identifiers, most buckets whose borders are broadcast, and how many
#: adjacent buckets look for their follower together.
BUCKET, QUANTILES, BUCKETS, STRETCH = 512, 256, 65_536, 4096


def with_next(documents: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", ready=lambda df: df) -> DataFrame:
    """Each row with ``next`` (a struct of ``columns``) of the row that follows in descending order of id.

    After the last row comes the first. Null ids come last, by a hash of their text; rows of one id follow each other by
    text. Rows are dealt into buckets of adjacent ids (null ids: of adjacent hashes), of which there are as many as the
    rows need; each bucket also gets a copy of the row that follows it, so one shuffle of the texts is enough. ``ready``
    is applied to the dealt rows before their neighbours are looked up.
    """
    if documents.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must hold whole numbers")
    hashed = F.xxhash64(F.col(text_col))
    n, n_null, lo, hi = documents.agg(F.count("*"), F.count_if(F.col(id_col).isNull()), F.min(id_col), F.max(id_col)).first()
    quantiles = min(QUANTILES, max(1, n // BUCKET))
    parts = max(1, n // (BUCKET * quantiles))
    cut = documents.agg(F.percentile_approx(id_col, [i / quantiles for i in range(quantiles + 1)], 20_000)).first()[0] if n and lo is not None else None
    bounds = sorted({int(x) for x in cut or [0]} | {int(lo or 0), int(hi or 0) + 1})
    array = "array(" + ", ".join(f"{b}L" for b in bounds) + ")"
    key = f"cast(`{id_col}` as bigint)"
    inside = f"cast(floor(({key} - element_at(b, q)) * {parts}D / greatest(element_at(b, q + 1) - element_at(b, q), 1)) as bigint)"
    place = _let(array, "b", _let(f"size(filter(slice(b, 1, {max(1, len(bounds) - 1)}), x -> x <= {key}))", "q", f"q * {parts}L + {inside}" if len(bounds) > 1 else "0L"))
    nulls = max(1, (n_null or 0) // BUCKET)
    last = F.shiftright(F.shiftrightunsigned(hashed, 33) * F.lit(nulls).cast("bigint"), 31)  # in order of the hash, as below
    bucket = F.when(F.col(id_col).isNull(), -1 - last).otherwise(F.expr(place)).cast("bigint")
    keyed = documents.withColumn("bucket", bucket).withColumn("h", F.shiftrightunsigned(hashed, 1))
    tops = keyed.groupBy("bucket").agg(F.max(id_col).alias("top"), F.min("h").alias("top_h"))
    # the copy goes to the next greater bucket, and from the greatest to the least; a stretch of buckets is one window
    near = Window.partitionBy("stretch").orderBy("bucket")
    tops = tops.withColumn("stretch", F.floor(F.col("bucket") / STRETCH)).withColumn("copy_to", F.lead("bucket").over(near))
    borders = tops.groupBy("stretch").agg(F.min("bucket").alias("least"))
    far = Window.orderBy("stretch")  # a row for some two million documents
    borders = borders.select("stretch", F.coalesce(F.lead("least").over(far), F.first("least").over(far)).alias("beyond"))
    tops = tops.join(borders, "stretch").select("bucket", "top", "top_h", F.coalesce("copy_to", "beyond").alias("copy_to"))
    few = parts * quantiles + nulls <= BUCKETS
    placed = keyed.join(F.broadcast(tops) if few else tops.hint("merge"), "bucket", "left")
    first = F.expr(f"if(`{id_col}` is null, h = top_h, `{id_col}` = top)")
    copies = F.filter(F.array(F.struct(F.col("bucket"), F.lit(False).alias("extra")), F.when(first, F.struct(F.col("copy_to").alias("bucket"), F.lit(True).alias("extra")))), lambda x: x.isNotNull())
    dealt = placed.withColumn("at", F.explode(copies)).drop("bucket", "top", "top_h", "copy_to").select("*", "at.bucket", "at.extra").drop("at")
    rows = ready(dealt.repartition("bucket"))
    order = Window.partitionBy("bucket").orderBy("extra", F.col(id_col).desc_nulls_last(), F.when(F.col(id_col).isNull(), F.col("h")), text_col)
    return rows.withColumn("next", F.lead(F.struct(*columns)).over(order)).filter("not extra").drop("bucket", "extra", "h")


def fingerprint_text(column: str) -> Column:
    return F.expr(f"array_join(transform({column}, x -> hex(x)), '-')")


def edited_fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Sketches of each whole text, of its edited text, and their likenesses.

    The edited text has the last third of the code points replaced by the first as many of the next document.
    """
    slim = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(slim, ["text", "sketch"], "id", "text", ready=lambda df: df.withColumn("sketch", sketch("text", k)))
    edited = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.expr("concat(substring(text, 1, int(n_chars - n_chars div 3)), substring(next.text, 1, int(n_chars div 3)))"))
    sketched = edited.select(F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", sketch("edited", k).alias("edited_sketch"), F.col("next.sketch").alias("next_sketch"))
    return sketched.select(
        id_col,
        "n_chars",
        "edited_sha256",
        "sketch",
        "edited_sketch",
        resemblance("sketch", "edited_sketch", k).alias("near_edited"),
        resemblance("sketch", "next_sketch", k).alias("near_next"),
        distinct_count("sketch", k).alias("n_shingles_estimate"),
        containment("sketch", "edited_sketch", k).alias("contained_in_edited"),
    )
