"""The training-data operators against brute force and on edge cases."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfold.llm import decontamination, fingerprint, html_extract, jaccard_join, mixing, pii, queries, sstable, toxicity, url_filter, warc
from wayfold.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   ", "a", "one two three four", "ÄÖ ß 日本 x" * 3, "word " * 30_000, "x" * 200_000]


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source if i % 3 else None, len(t or "")) for i, t in enumerate(texts)], DOC)


def words(rng, n):
    return " ".join(rng.choice(["ab", "cd", "ef", "gh", "kl", "mn", "op"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    out = [words(rng, rng.choice([6, 12, 18, 40, 120])) for _ in range(150)]
    for i in range(0, 90, 2):  # near copies at many distances
        w = out[i].split()
        for k in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"edit{i}{k}"
        out.append(" ".join(w))
    base = words(rng, 80).split()
    for k in range(60):  # one group around a text, and a passage shared by many
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"e{k}{rng.randrange(99)}"
        out.append(" ".join(w))
    out += [words(rng, 30) + " " + " ".join(base[:30]) for _ in range(40)]
    return out + [out[3], out[3].upper()] + ODD


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            inter = len(a & sets[j])
            if inter and 100 * inter >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def test_jaccard_join_is_exact(spark, corpus):
    got = jaccard_join.cluster(docs(spark, corpus)).orderBy("doc_id").collect()
    sizes, least = brute_components(corpus)
    assert [r.n_shingles for r in got] == sizes and [r.component_id for r in got] == least


@pytest.mark.parametrize("boundary", [0, 20, 64])
def test_jaccard_join_at_any_boundary(spark, corpus, boundary, monkeypatch):
    monkeypatch.setattr(jaccard_join, "choose_boundary", lambda *a, **k: boundary)
    got = jaccard_join.cluster(docs(spark, corpus)).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == brute_components(corpus)[1]


def brute_links(texts):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return [(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if a & b and 100 * len(a & b) >= 80 * len(a | b)], sets


@pytest.mark.parametrize("block", [256, 7])
def test_jaccard_join_counts_every_link(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    rng = random.Random(8)
    base = words(rng, 100)
    texts = [*corpus, *[words(rng, 30)] * 5, *[f"{base} {x}" for x in ("left", "right", "middle")]]
    links, sets = brute_links(texts)
    got = {r.doc_id: r.n_links for r in jaccard_join.cluster(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [sum(i in x for x in links) for i in range(len(texts))]
    assert [got[i] for i in range(len(texts) - 8, len(texts))] == [4] * 5 + [2] * 3
    first = [next(i for i, other in enumerate(sets) if other == s) for s in sets]
    pairs = sorted((r.id_a, r.id_b) for r in jaccard_join.linked_pairs(docs(spark, texts)).collect())
    assert pairs == sorted({(min(first[i], first[j]), max(first[i], first[j])) for i, j in links if sets[i] != sets[j]})


def test_keep_one_handles_repeated_rows(spark):
    rows = docs(spark, ["a b c d e f", "a b c d e f", "g h", None, ""])
    kept = jaccard_join.keep_one(rows.union(rows.filter("doc_id = 2")).union(rows.limit(1).withColumn("doc_id", F.lit(None).cast("long"))))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [0, 2, 3, 4, None]
    assert jaccard_join.cluster(docs(spark, ["a"]).limit(0)).count() == 0


def test_parities_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (3, 50, 700):
        for share in (0.0, 0.5, 0.9):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[: int(n * share)], rng.integers(0, 1 << 63, n).astype(np.uint64)]))
            assert jaccard_join.least_difference(jaccard_join.parities(a), jaccard_join.parities(b)) <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "u long, v long")
    assert {r.node: r.component for r in components(edges).collect()} == {**dict.fromkeys(range(1, 41), 0), 100: 99}


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    small = lambda n: " ".join(rng.choice("a b c".split()) for _ in range(n))
    items = [small(13), small(20), "x Y", "", None, small(2)] + [small(14) for _ in range(4)]
    texts = [small(rng.randrange(60)) + rng.choice([" x, y. ", " "]) + rng.choice(items[:2]) for _ in range(60)] + ODD
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block in (10, 4_000_000):
        got = decontamination.find_contamination(docs(spark, texts), bench, block_chars=block).orderBy("doc_id").collect()
        for row, text in zip(got, texts, strict=True):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
            hit, found = set(), set()
            for i, item in enumerate(items):
                iw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").lower())
                n = min(13, len(iw))
                for s in range(len(iw) - n + 1 if n else 0):
                    for p in range(len(w) - n + 1):
                        if w[p : p + n] == iw[s : s + n]:
                            hit.update(range(p, p + n))
                            found.add(str(i))
            assert (row.n_words, row.n_hit, row.items) == (len(w), len(hit), sorted(found))
            assert row.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
            covered = [decontamination.WORD.findall(text[s.start : s.end]) for s in row.spans]
            assert sum(map(len, covered)) == len(hit)


def test_shift_and_against_regex():
    rng = random.Random(1)
    globs = ["*.a/b**", "**ab*", "a?b", "**", "*", "\\*a**", "x" * 70 + "**"] + ["".join(rng.choice(["a", "b", "/", "*", "**", "?"]) for _ in range(6)) for _ in range(30)]
    texts = ["".join(rng.choice("ab/.*") for _ in range(rng.randrange(9))) for _ in range(200)] + ["x" * 75, "é" * 3]

    def regex(g):
        g = re.split(r"(\\.|\*\*+|\*|\?)", g)
        return "".join("[^/]*" if p == "*" else ".*" if p.startswith("**") else "[^/]" if p == "?" else re.escape(p[1:]) if p[:1] == "\\" else re.escape(p) for p in g)

    globs = [g for g in globs if "***" not in g]
    hits = url_filter.ShiftAnd.of(globs).match([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert hits[i, j] == bool(re.fullmatch(regex(g).encode(), t.encode(), re.S)), (t, g)


def test_url_verdicts(spark):
    urls = [None, "", "no scheme", "http://WWW.Example.com/en/1?x", "http://m.example.com/en/", "http://example.com/fr", "http://a.net/es/#t", "http://a.net/de/", "http://evilcom/", "http://a.com", "http://x.cheap-pills.org/", "http://e.org/a.com/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r.rule, r.verdict) for r in url_filter.filter_urls(pages).orderBy("page_id").collect()]
    assert got == [(None, "allow")] * 3 + [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "allow")]


def test_fingerprints(spark):
    texts = ["one two three four five six seven " * 3, "", None, "é 日本 👍 x", "a b c d e f"] + ["w%d " % i * 9 for i in range(30)]
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs(spark, texts)).collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        n, follow = len(t) // 3, plain[i - 1]
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - n] + follow[:n]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and got[i].n_chars == len(t)
    assert got[1].sketch == got[2].sketch == [] and got[2].near_next == 1.0
    parts = spark.sql("select 1 as k, array(1L, 5L) as sketch union all select 1, array(2L, 5L)")
    assert fingerprint.merge_sketches(parts, ["k"], k=2).first().sketch == [1, 2]
    assert fingerprint.edited_fingerprints(docs(spark, ["x y"])).first().near_next == 1.0


def test_html_without_container_or_mostly_links_keeps_its_text():
    text = lambda page: html_extract.articles(html_extract.parse(page), [])
    assert text("<title>x</title><p>first<p>second") == "first\n\nsecond"
    assert text("<nav>menu</nav><p>text") == "text"
    assert text("<body><div>short <a href=x>a long link text</a></div></body>") == "short a long link text"
    assert text("<p>a long text of its own, outside<div>end</div>") == "a long text of its own, outside\n\nend"
    assert text("") == text("<title>x</title>") == ""


def test_pfair_deviation_and_order(spark):
    rows = spark.range(1200).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('s', id % 5) end as source", "'t' as text")
    got = mixing.mix(rows, {"hot": 3, "s1": 2}, 1, block_docs=4).collect()
    assert sorted(r.doc_id for r in got) == list(range(1200))
    order = {r.slot: r.source or "" for r in got}
    assert sorted(order) == list(range(len(order)))
    weights = {s: {"hot": 3, "s1": 2}.get(s, 1) for s in set(order.values())}
    blocks = {s: sum(v == s for v in order.values()) for s in weights}
    total, seen = sum(weights.values()), dict.fromkeys(weights, 0)
    for t in range(min(blocks[s] // weights[s] for s in weights) * total):
        seen[order[t]] += 1
        assert all(abs(seen[s] - (t + 1) * weights[s] / total) < 1 for s in weights)
    assert mixing.mix(rows.limit(0)).count() == 0 and mixing.mixed_rows(rows).columns == rows.columns


def test_sstable_round_trip(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    texts = ODD + ["Hello, world!  two\n lines <|endoftext|> it's", " lead", "trail ", "tab\tx", "Ġ x"] + [words(random.Random(i), 50) for i in range(30)]
    rows = docs(spark, texts)
    rows = rows.union(rows.filter("doc_id = 3")).union(rows.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    manifest = sstable.write_shards(rows, queries.tokenizer_file(), 2, str(tmp_path / "t"), shards=3)
    t = Tokenizer.from_file(queries.tokenizer_file())
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in enumerate(texts)}
    got = sstable.read_shards(manifest).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted([*want, 3, None], key=str)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = want[r.doc_id or 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    found = sstable.lookup(manifest, [0, 3, 20, 99, -5])
    assert [list(x) for x in found[20]] == [want[20]] and len(found[3]) == 2 and not found[99] and not found[-5]


def test_html(spark):
    page = "<html><body><nav>menu</nav><div class='ad x'>buy</div><article><h1>T &amp;\n t</h1><p>one <b>two</b>\n<i>three</i><br>four<p>five<script>var t='</p>';</script><ul><li>a<li>b</ul><div id=comments>c</div></article><footer>f</footer>"
    pages = spark.createDataFrame([(1, "http://h.org/1", page), (2, None, None), (3, "x", ""), (4, "http://h.org/2", "<p>only<!-- open"), (5, "http://h.org/3", "<article></article>")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_main_text(pages).collect()}
    assert got[1][0] == "T & t\n\none two three four\n\nfive\n\na\n\nb"
    assert got[2] == got[3] == ("", 0) and got[5] == ("", 0)


def brute_pii(x):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub(r"[ -]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_pii_base_spans_against_regex():
    rng = random.Random(2)
    for _ in range(5000):
        x = "".join(rng.choice("1234567890..--  ++()ab@@%._xé") for _ in range(rng.randrange(32)))
        assert pii.base_spans(x) == brute_pii(x), x


def test_pii_finds_unseen_identifiers(spark):
    good = [n for n in (str(4_000_000_000_000_000 + 7 * i) for i in range(400)) if brute_pii(n)][:30]
    texts = [f"please charge card {c} at once, n{i}" for i, c in enumerate(good)] + ["please charge card 4111111111111112 at once", "order 1234567890 came", None, ""]
    got = pii.find_pii(docs(spark, texts)).orderBy("doc_id").collect()
    assert [len(r.base) for r in got] == [1] * 30 + [0] * 4
    assert [(s.kind, s.start, s.end) for s in got[30].extra] == [("card", 19, 35)] and not got[31].extra


def test_toxicity(spark):
    rng = random.Random(4)
    texts = [words(rng, 60) + (" grobnik villain " if i % 4 == 0 else " ") + words(rng, 30) for i in range(400)] + [None, ""]
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(300)] + [(9999, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs(spark, texts), labels).orderBy("doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in got[300:400]) >= 95
    none = toxicity.score_documents(docs(spark, texts[:3]), labels.limit(0)).collect()
    assert [r.predicted for r in none] == [0, 0, 0]


def test_warc(spark):
    rows = [(1, "http://www.A.org/x/", 100, 200, {"ETag": '"1"', "Date": "d1", "X": "y"}), (2, "https://a.org/x#f", 4000, 304, {"etag": 'W/"1"', "Date": "d2", "Content-Type": "z"}), (3, "http://a.org/x", 50, 304, {}), (4, "http://a.org/x", 9000, 304, {"ETag": '"2"'}), (5, None, 1, 200, None), (6, "http://a.org/x?utm_source=q", 9001, 304, None), (7, "http://a.org/x", None, 304, None), (8, "http://a.org/x", 70, 404, {})]
    records = spark.createDataFrame(rows, "record_id long, url string, at long, status int, headers map<string, string>").withColumn("fetched", F.timestamp_seconds("at"))
    got = {r.record_id: r for r in warc.resolve_revisits(records).collect()}
    assert {k: r.reason for k, r in got.items()} == {1: "full", 2: "resolved", 3: "no earlier response", 4: "validators differ", 5: "no url or time", 6: "resolved", 7: "no url or time", 8: "other status"}
    assert got[2].headers == {"etag": 'W/"1"', "date": "d2", "x": "y"} and got[6].resolved_from == 1 and got[2].status == 200


def test_pipeline_matches_brute_force(spark):
    import corpus_pipeline

    directory = "/root/testdata/sf0.001"
    try:
        documents = spark.read.parquet(f"{directory}/documents.parquet")
    except Exception:
        pytest.skip("no tables")
    kept = documents
    for _, stage in corpus_pipeline.STAGES[:1]:
        kept = stage(spark, kept, directory)
    left = {r.doc_id: r.text for r in kept.collect()}
    ids = sorted(left)
    sizes, least = brute_components([left[i] for i in ids])
    once = [i for k, i in enumerate(ids) if least[k] == k]
    flagged = {r.doc_id for r in queries.op2_decontamination(spark, directory).filter("contaminated").collect()}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, directory).collect()) == [i for i in once if i not in flagged]


def test_words_hash_alike_whatever_the_array():
    texts = pa.array([None, "", "A  b\tc", "a b C", "a b c d e f g"])
    sets = [s.tolist() for s in jaccard_join.shingle_sets(texts)]
    assert sets[:2] == [[], []] and sets[2] == sets[3] and len(sets[4]) == 3
    assert [s.tolist() for s in jaccard_join.shingle_sets(texts.slice(2, 2))] == sets[2:4]
