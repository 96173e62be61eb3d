"""WARC not-modified revisits: as-of join to the latest earlier full response of the same canonical URL.

A revisit (status 304) holds headers only. It resolves to the latest full response (status 2xx) before it, by fetch
time and then by record id, of the same canonical URL. Validators must agree: an ETag given on both sides must be equal
(compared weakly), and so must Last-Modified. A resolved record has the response's headers, with those of the 304 that a
not-modified answer may update merged in, and names the record whose payload it has.

Records are dealt by canonical URL and time segment. A window finds the latest response inside a segment; what earlier
segments end with is carried forward from one row per segment. So a URL with a third of all records is split by time,
and no payload is shuffled.

Edge cases: a revisit without an earlier response, or whose validators differ, stays as it is with a reason; records
without URL or time are kept with a reason, skip the windows and serve no revisit; null headers are empty, and header
names are compared in lower case (of names that differ in case only, the last holds); of records of equal time the
greater record id is the later, of equal ids a hash of status and headers decides; repeated records are resolved each for
itself; header values of any length are kept; an empty table gives an empty result; only the named columns are read, so
others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a 304 may update (RFC 9110, 15.4.5; RFC 9111, 3.2), and parameters that track.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
TRACKING = r"(utm_[a-z]+|fbclid|gclid|ref)"
#: Seconds of a segment.
SEGMENT = 3600


def canonical_url(url: Column) -> Column:
    """http for https, lower-case host without 'www.' and default port; no fragment, tracking parameters or end slash."""
    text = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.lower(F.regexp_extract(text, "^([A-Za-z]+://[^/?]*)", 1))
    tail = F.regexp_replace(text, "^[A-Za-z]+://[^/?]*", "")
    head = F.regexp_replace(F.regexp_replace(F.regexp_replace(head, "^https://", "http://"), r"://www\.", "://"), ":(80|443)$", "")
    tail = F.regexp_replace(F.regexp_replace(tail, rf"&{TRACKING}=[^&]*", ""), rf"\?{TRACKING}=[^&]*&?", "?")
    tail = F.regexp_replace(F.regexp_replace(tail, r"\?$", ""), r"/$", "")
    return F.concat(head, tail)


def _agree(mine: Column, other: Column) -> Column:
    bare = lambda c: F.regexp_replace(F.trim(c), "^W/", "")
    return mine.isNull() | other.isNull() | (bare(mine) == bare(other))


def resolve_revisits(records: DataFrame, segment_s: int = SEGMENT) -> DataFrame:
    """records: record_id, url, fetched (timestamp), status, headers map<string, string>.

    One row per record: record_id, url_key, fetched, status (as resolved), headers (merged), resolved_from, reason
    ('full', 'resolved', 'no earlier response', 'validators differ', 'no url or time', 'other status').
    """
    entries = "transform(map_entries(coalesce(headers, cast(map() as map<string, string>))), e -> struct(lower(e.key) as key, e.value as value))"
    last = "filter(k, (e, i) -> not exists(slice(k, i + 2, greatest(size(k) - i - 1, 0)), x -> x.key = e.key))"
    headers = F.expr(f"map_from_entries(element_at(transform(array({entries}), k -> {last}), 1))")
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "fetched", "status", headers.alias("headers"))
    usable = F.col("url_key").isNotNull() & F.col("fetched").isNotNull()
    full = usable & F.coalesce(F.col("status").between(200, 299), F.lit(False))
    every = rows.withColumn("usable", usable).withColumn("full", full).withColumn("segment", F.floor(F.unix_seconds(F.col("fetched").cast("timestamp")) / segment_s))
    source = F.when(F.col("full"), F.struct("record_id", "status", "headers"))
    rows = every.filter("usable")
    earlier = Window.partitionBy("url_key", "segment").orderBy("fetched", "record_id", F.xxhash64("status", F.map_entries("headers"))).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("found", F.last(source, ignorenulls=True).over(earlier))
    ends = rows.groupBy("url_key", "segment").agg(F.max_by(source, F.when(F.col("full"), F.struct("fetched", "record_id"))).alias("end"))
    before = Window.partitionBy("url_key").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("end", ignorenulls=True).over(before)).drop("end")
    joined = inside.join(carried, ["url_key", "segment"], "left").withColumn("found", F.coalesce("found", "carried")).drop("carried")
    # records without URL or time serve no revisit and need no window: as one key they would meet in one task
    joined = joined.unionByName(every.filter("not usable").withColumn("found", F.lit(None).cast(joined.schema["found"].dataType)), allowMissingColumns=True)
    theirs, mine = F.col("found.headers"), F.col("headers")
    agree = _agree(mine["etag"], theirs["etag"]) & _agree(mine["last-modified"], theirs["last-modified"])
    revisit = F.coalesce(F.col("status") == 304, F.lit(False))
    reason = (
        F.when(~F.col("usable"), "no url or time")
        .when(F.col("full"), "full")
        .when(~revisit, "other status")
        .when(F.col("found").isNull(), "no earlier response")
        .when(~agree, "validators differ")
        .otherwise("resolved")
    )
    listed = F.array(*map(F.lit, PERMITTED))
    update = F.map_filter(mine, lambda k, v: F.array_contains(listed, k))
    kept = F.map_filter(theirs, lambda k, v: ~F.map_contains_key(update, k))
    out = joined.withColumn("reason", reason)
    resolved = F.col("reason") == "resolved"
    return out.select(
        "record_id",
        "url_key",
        "fetched",
        F.when(resolved, F.col("found.status")).otherwise(F.col("status")).alias("status"),
        F.when(resolved, F.map_concat(kept, update)).otherwise(mine).alias("headers"),
        F.when(resolved, F.col("found.record_id")).alias("resolved_from"),
        "reason",
    )
