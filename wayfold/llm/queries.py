"""The thin queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import decontamination, fingerprint, html_extract, jaccard_join, mixing, pii, sstable, toxicity, url_filter, warc
from wayfold.llm.common import table


def tokenizer_file() -> str:
    """The production tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


END_ID = 2
HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score_documents(documents, labels.filter(f"not ({HELD_OUT})"))
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", "predicted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def captures(pages: DataFrame) -> DataFrame:
    """A crawl's records from pages: a full response of each page, and a later revisit of its URL.

    Revisits of every seventh page carry an ETag of other content; those of every fifth page come before the response.
    """
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    at = F.col("page_id") * 40
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"),
        "url",
        F.timestamp_seconds(at).alias("fetched"),
        F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), etag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), at.cast("string")).alias("headers"),
    )
    later = F.when(F.col("page_id") % 5 == 0, at - 10).otherwise(at + 5000)
    other = F.when(F.col("page_id") % 7 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), etag))
    seen = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        F.regexp_replace("url", "^http://", "https://").alias("url"),
        F.timestamp_seconds(later).alias("fetched"),
        F.lit(304).alias("status"),
        F.create_map(F.lit("etag"), other, F.lit("date"), later.cast("string"), F.lit("content-type"), F.lit("none")).alias("headers"),
    )
    return full.unionByName(seen)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc.resolve_revisits(captures(table(spark, sf_dir, "pages")))
    header = lambda name: F.col("headers")[name]
    return resolved.select("record_id", "url_key", "status", "resolved_from", "reason", header("etag").alias("etag"), header("date").alias("date_header"), header("content-type").alias("content_type"))


def op4_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(table(spark, sf_dir, "documents"), tokenizer_file(), END_ID)
    return sstable.read_shards(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.cluster(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint.fingerprint_text("sketch").alias("fingerprint"),
        fingerprint.fingerprint_text("edited_sketch").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "n_shingles_estimate",
        "contained_in_edited",
    )


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS]
    both = found.withColumn("every", F.concat("base", "extra"))
    n_spans = F.size("every").cast("long").alias("n_spans")
    return both.select("doc_id", *counts, F.sha2(pii.spans_text("base"), 256).alias("base_sha256"), pii.spans_text("every").alias("spans"), n_spans)


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_warc_revisits, op4_sstable, op5_jaccard_join, op6_pfair_mix, op7_url_filter, op8_fingerprint, op9_html_text, op10_pii)}


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT cast(item_id AS varchar), ',' ORDER BY cast(item_id AS varchar)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, coalesce(hw.n_hit, 0) AS n_hit, coalesce(hi.n_items, 0) AS n_items,
       sha256(coalesce(hi.ids, '')) AS items_sha256, coalesce(hw.n_hit, 0) > 0 AND 20 * coalesce(hw.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

CANONICAL_SQL = r"""
regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(trim(url), '#.*$', ''), '^([A-Za-z]+://[^/?]*)', 1)),
  '^https://', 'http://'), '://www\.', '://'), ':(80|443)$', '') ||
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z]+://[^/?]*', ''),
  '&(utm_[a-z]+|fbclid|gclid|ref)=[^&]*', '', 'g'), '\?(utm_[a-z]+|fbclid|gclid|ref)=[^&]*&?', '?', 'g'), '\?$', ''), '/$', '')
"""

OP3_SQL = f"""
WITH f AS (SELECT page_id * 2 AS record_id, {CANONICAL_SQL} AS url_key, page_id * 40 AS tm, '"' || md5(coalesce(html, '')) || '"' AS etag FROM pages),
r AS (SELECT page_id * 2 + 1 AS record_id, {CANONICAL_SQL} AS url_key, CASE WHEN page_id % 5 = 0 THEN page_id * 40 - 10 ELSE page_id * 40 + 5000 END AS tm,
             CASE WHEN page_id % 7 = 0 THEN '"other"' ELSE 'W/"' || md5(coalesce(html, '')) || '"' END AS etag FROM pages),
j AS (SELECT r.*, f.record_id AS from_id, f.etag AS from_etag,
             row_number() OVER (PARTITION BY r.record_id ORDER BY f.tm DESC, f.record_id DESC) AS k
      FROM r LEFT JOIN f ON r.url_key = f.url_key AND (f.tm < r.tm OR f.tm = r.tm AND f.record_id < r.record_id)),
v AS (SELECT *, from_id IS NOT NULL AND replace(etag, 'W/', '') = from_etag AS ok FROM j WHERE k = 1)
SELECT record_id, url_key, 200 AS status, cast(NULL AS bigint) AS resolved_from, 'full' AS reason, etag, cast(tm AS varchar) AS date_header, 'text/html' AS content_type FROM f
UNION ALL
SELECT record_id, url_key, CASE WHEN ok THEN 200 ELSE 304 END, CASE WHEN ok THEN from_id END,
       CASE WHEN from_id IS NULL THEN 'no earlier response' WHEN ok THEN 'resolved' ELSE 'validators differ' END, etag, cast(tm AS varchar),
       CASE WHEN ok THEN 'text/html' ELSE 'none' END FROM v
"""

OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(least(5, len(w)), array_to_string(w[i:i + 4], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(reach.y), d.doc_id)) AS component_id, coalesce(max(c.n), 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.x = d.doc_id LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) c ON c.x = d.doc_id GROUP BY d.doc_id, n.n
"""

OP7_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE regexp_replace(substr(url, position('://' IN url) + 3), '[?#](.|\n)*$', '') END AS rest FROM pages),
p AS (SELECT page_id, translate(CASE WHEN position('/' IN rest) > 0 THEN substr(rest, 1, position('/' IN rest) - 1) ELSE rest END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             CASE WHEN position('/' IN rest) > 0 THEN substr(rest, position('/' IN rest)) ELSE '' END AS path FROM u),
r(kind, h, q) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(kind, length(h || q)) AS kind
        FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(kind, CASE WHEN
  contains('.' || host || path, 'cheap-pills.') OR contains('.' || host || path, 'casino-') OR contains('.' || host || path, 'free-bets.') OR
  contains('.' || host || path, 'spam-farm.') OR contains('.' || host || path, 'ads-track.') OR contains('.' || host || path, '/ads/') OR
  regexp_matches('.' || host || path, '/login[^/]*$') OR ends_with('.' || host || path, '.exe') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (page_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op3_warc_revisits": OP3_SQL, "op5_jaccard_join": OP5_SQL, "op7_url_filter": OP7_SQL}
