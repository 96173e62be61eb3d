"""Edge cases of every training-data operator, and brute-force versions of those that SQL can't express."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import decontamination, fingerprint, html_extract, jaccard_join, mixing, pii, queries, sstable, toxicity, url_filter, warc

DOC = "doc_id long, text string, source string"
LONG = "word " * 40_000 + "x" * 100_000


def docs(spark, rows):
    return spark.createDataFrame([r if isinstance(r, tuple) else (i, r, "s") for i, r in enumerate(rows)], DOC)


def clashing(df, *names):
    """The frame with further columns of names that operators use inside."""
    for name in names:
        df = df.withColumn(name, F.lit("mine"))
    return df


NAMES = ("id", "score", "predicted", "carried", "rest", "row", "n_words", "items", "contaminated", "spans", "runs", "slot", "place", "name", "a", "n", "k", "rank", "shape", "cycle", "u", "group", "ref", "component", "map_word", "bucket", "next", "h", "uid", "base", "seen", "pattern", "shard", "position", "n_chars", "lang")


# toxicity


def plain_buckets(text):
    points, out, mask = [ord(c) for c in text.lower()], set(), (1 << 64) - 1
    step = int(toxicity.STEP)
    for i in range(len(points)):
        h = points[i]
        for n in range(2, 6):
            if i + n > len(points):
                break
            h = (h * step & mask) ^ points[i + n - 1]
            h = (h + (h >> 29)) & mask
            if n >= 3:
                out.add(((h + n) * step & mask) >> (64 - toxicity.BITS))
    return out


def test_toxicity_features_against_plain_python():
    for text in ("", "ab", "abc", "Größe x 日本 y", "the the the"):
        assert set(toxicity.presences(text).tolist()) == plain_buckets(text)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(8)) + (" vile" if i % 3 == 0 else "") for i in range(60)]
    y = np.array([i % 3 == 0 for i in range(60)])
    weights, bias = toxicity.fit(texts, y)
    counts = [Counter(b for t, v in zip(texts, y, strict=True) if v == label for b in plain_buckets(t)) for label in (False, True)]
    for b in set(counts[0]) | set(counts[1]):
        ratio = math.log((counts[1][b] + 0.5) / 21) - math.log((counts[0][b] + 0.5) / 41)
        if counts[0][b] + counts[1][b] < toxicity.MIN_DF or abs(ratio) < toxicity.MIN_RATIO - 1e-9:
            assert weights[b] == 0
        elif weights[b]:
            assert (weights[b] > 0) == (ratio > 0)
    got = [toxicity.score(t, weights, weights != 0, bias) for t in texts]
    want = [1 / (1 + math.exp(-bias - sum(float(weights[b]) for b in plain_buckets(t)))) for t in texts]
    assert np.allclose(got, want, atol=1e-5) and all((s >= 0.5) == v for s, v in zip(got, y, strict=True))


def test_toxicity_edges(spark):
    texts = [f"calm words {i} here" + (" vile grob" if i % 2 else "") for i in range(40)] + [None, "", LONG]
    table = docs(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    rows = clashing(table.union(table.filter("doc_id < 2")), *NAMES)
    got = toxicity.score_documents(rows, labels, carry=tuple(rows.columns)).collect()
    assert len(got) == 45 and all(r.carried.score == "mine" and r.carried.doc_id == r.doc_id for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id < 40) and len({r.score for r in got if r.doc_id == 1}) == 1
    assert toxicity.score_documents(table.limit(0), labels).count() == 0
    assert [r.predicted for r in toxicity.score_documents(table.limit(2), labels, most_toxic=1, most_other=1).collect()]


# decontamination


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (None, "four five")], "item_id long, text string")
    table = docs(spark, ["x one two three y", "x one two three y", None, "", LONG, "four five"])
    rows = clashing(table.union(table.limit(1)), *NAMES)
    got = decontamination.find_contamination(rows, bench, carry=tuple(rows.columns)).collect()
    assert sorted((r.doc_id, r.n_hit, r.items) for r in got) == [(0, 3, ["1"]), (0, 3, ["1"]), (1, 3, ["1"]), (2, 0, []), (3, 0, []), (4, 0, []), (5, 2, ["null"])]
    assert all(r.carried.contaminated == "mine" and r.contaminated == (r.n_hit > 0) for r in got)
    assert {r.doc_id: r.n_words for r in got}[4] == 40_001
    assert decontamination.find_contamination(table, bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.find_contamination(table.limit(0), bench).count() == 0


# crawl records


def brute_revisits(rows):
    out = {}
    for rid, url, at, status, headers in rows:
        mine = {k.lower(): v for k, v in (headers or {}).items()}
        if url is None or at is None:
            out[rid] = "no url or time"
        elif status is not None and 200 <= status <= 299:
            out[rid] = "full"
        elif status != 304:
            out[rid] = "other status"
        else:
            before = [r for r in rows if r[1] == url and r[2] is not None and r[3] is not None and 200 <= r[3] <= 299 and (r[2], r[0]) < (at, rid)]
            if not before:
                out[rid] = "no earlier response"
            else:
                best = max(before, key=lambda r: (r[2], r[0]))
                theirs = {k.lower(): v for k, v in (best[4] or {}).items()}
                agree = all(h not in mine or h not in theirs or mine[h] == theirs[h] for h in ("etag", "last-modified"))
                out[rid] = best[0] if agree else "validators differ"
    return out


def test_warc_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice(["http://a.org/x", "http://b.org/y", None]), rng.choice([None, *[100 * k for k in range(90)]]), rng.choice([200, 304, 304, 404, None]), rng.choice([None, {"ETag": rng.choice("ab")}, {"Last-Modified": rng.choice("cd"), "ETag": "a"}])) for i in range(250)]
    schema = "record_id long, url string, at long, status int, headers map<string, string>"
    records = spark.createDataFrame(rows, schema).withColumn("fetched", F.timestamp_seconds("at"))
    want = brute_revisits(rows)
    for segment in (60, 3600, 10**7):
        got = warc.resolve_revisits(clashing(records, "segment", "found", "full", "usable", "reason"), segment).collect()
        assert {r.record_id: r.resolved_from if r.reason == "resolved" else r.reason for r in got} == want
    twice = [(1, "http://a.org/x", 5, 200, None), (1, "http://a.org/x", 5, 200, None), (2, "http://a.org/x", 5, 304, None), (2, "http://a.org/x", 5, 304, None)]
    got = warc.resolve_revisits(spark.createDataFrame(twice, schema).withColumn("fetched", F.timestamp_seconds("at"))).collect()
    assert sorted((r.record_id, r.reason) for r in got) == [(1, "full")] * 2 + [(2, "resolved")] * 2
    assert warc.resolve_revisits(records.limit(0)).count() == 0


# shards


def test_sstable_edges_and_order(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    table = docs(spark, ["a b", "c  d", None, LONG, "a b"])
    rows = clashing(table, "id", "shard", "uri", "start").withColumn("at", 10 - F.col("doc_id")).withColumn("part", F.lit(0))
    manifest = sstable.write_shards(rows, queries.tokenizer_file(), 2, str(tmp_path / "t"), shard_col="part", order_col="at")
    got = sstable.read_shards(manifest).orderBy("start").collect()
    assert [(r.doc_id, r.position) for r in got] == [(0, 4), (1, 3), (2, 2), (3, 1), (4, 0)]
    shard = sstable.open_shard(manifest.first().uri)
    assert [sstable.identifier_of(k) for k, _ in shard.in_order(1)] == [4, 3, 2, 1, 0]
    assert [len(ids) for _, ids in shard.in_order()][::-1] == [r.n_tokens for r in got]
    plain = sstable.write_shards(table, queries.tokenizer_file(), 2, str(tmp_path / "p"), shards=2)
    assert [r.position for r in sstable.read_shards(plain).orderBy("start").collect()] == [0, 1, 2, 3, 4]
    empty = sstable.write_shards(table.limit(0), queries.tokenizer_file(), 2, str(tmp_path / "e"))
    assert sstable.read_shards(empty).count() == 0 and sstable.lookup(empty, [1]) == {1: []}


def test_encoding_in_pieces_equals_encoding_whole():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_file())
    rng = random.Random(4)
    texts = ["", " ", "a ", " a", "a  b", "\t x", "Ġ x", "<|endoftext|> a b", "日本 ß é", " 　 z", *["".join(rng.choice(" ab\n\t.é日'") for _ in range(rng.randrange(40))) for _ in range(800)]]
    encode = sstable.Encoder(queries.tokenizer_file())
    for _ in range(2):
        assert list(encode(texts)) == [np.array(e.ids, encode.dtype).tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)]


# near duplicates


def test_jaccard_edges(spark):
    base = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"v{i}" for i in range(20_000))
    table = docs(spark, [base, base, base + " end", None, "", "a b", long, long + " y"])
    rows = clashing(table.union(table.limit(1)), *NAMES)
    kept = jaccard_join.keep_one(rows)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5, 6]
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.cluster(clashing(table, *NAMES)).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (0, 2), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 1), 7: (6, 1)}


def test_long_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PART", 3)
    monkeypatch.setattr(jaccard_join, "OPEN_BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "HOT", 12)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 1)
    rng = random.Random(2)
    shared = " ".join(f"s{i}" for i in range(12))
    texts = [shared + " " + " ".join(f"{rng.choice('abcdef')}{k}{rng.randrange(2)}" for k in range(6)) for _ in range(50)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(50))

    def find(i):
        return i if root[i] == i else find(root[i])

    links = Counter()
    for j in range(50):
        for i in range(j):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                links.update((i, j))
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.cluster(docs(spark, texts)).collect()}
    assert got == {i: (find(i), links[i]) for i in range(50)}


# mixing


def brute_mix(counts, weights, other, block):
    left = {s: -(-n // block) for s, n in counts.items()}
    share = {s: weights.get(s, other) for s in counts}
    out = []
    while any(left.values()):
        m = {s: min(share[s], k) for s, k in left.items() if k}
        q, done = sum(m.values()), Counter()
        for t in range(q):
            ready = [(-(-(done[s] + 1) * q // m[s]), -m[s], s) for s in m if done[s] < m[s] and done[s] * q // m[s] <= t]
            s = min(ready)[2]
            done[s] += 1
            out.append(s)
        for s, k in m.items():
            left[s] -= k
    return out


@pytest.mark.parametrize("sources, weights, other", [(5, {"s0": 3, "s1": 2}, 1), (30, {"s0": 7, "s1": 5, "s2": 5}, 2), (8, {"s1": 0.75, "s2": 0.5}, 0.25), (300, {}, 1)])
def test_mix_is_earliest_deadline_first(spark, sources, weights, other):
    rng = random.Random(sources)
    names = [f"s{min(int(rng.expovariate(4 / sources)), sources - 1)}" for _ in range(1500)]
    got = mixing.mix(docs(spark, [(i, "", s) for i, s in enumerate(names)]), weights, other, block_docs=4).collect()
    order = {r.slot: r.source for r in got}
    whole = [Fraction(str(w)) * 4 for w in (*weights.values(), other)]
    scaled = [int(w) for w in whole]
    want = brute_mix(Counter(names), dict(zip(weights, scaled[:-1], strict=True)), scaled[-1], 4) if any(w != int(w / 4) * 4 for w in scaled) else brute_mix(Counter(names), weights, other, 4)
    assert [order[i] for i in range(len(order))] == want
    assert Counter((r.slot, r.place) for r in got).most_common(1)[0][1] == 1 and len(got) == 1500


def test_mix_edges(spark):
    rows = docs(spark, [(i if i % 4 else None, "t", "hot" if i % 3 else None) for i in range(200)])
    rows = clashing(rows.union(rows.limit(20)), *NAMES)
    made = mixing.mixed_rows(rows, {"hot": 2}, 1, 4)
    assert made.columns == rows.columns and made.count() == 220 and {r.slot for r in made.collect()} == {"mine"}
    got = mixing.mix(rows, {"hot": 2}, 1, 4, carry=tuple(rows.columns)).collect()
    assert {r.carried.slot for r in got} == {"mine"} and sorted(Counter(r.slot for r in got).values())[-1] == 4
    for weights, other in (({"hot": 0}, 1), ({"hot": -1}, 1), ({"hot": 1}, 0), ({"hot": 0.0000001}, 1000)):
        with pytest.raises(ValueError):
            mixing.mix(rows, weights, other)
    assert mixing.whole_weights({"a": 0.1, "b": 0.3}, 0.2) == ({"a": 1, "b": 3}, 2)
    assert mixing.mix(rows.limit(0)).count() == 0 and mixing.mixed_rows(rows.limit(0)).count() == 0
    assert mixing.attach(rows.select("doc_id"), rows.limit(0).select("doc_id"), ["doc_id"]).count() == 0


# addresses


def test_url_edges(spark):
    urls = ["http://a.com/" + "x" * 200_000 + ".exe", "http://a.net/x.exe", "http://a.net/x.exe", None]
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(urls)], "page_id long, url string, rule string, verdict string")
    got = url_filter.filter_urls(pages).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("com/", "allow"), (None, "block"), (None, "block"), (None, "allow")]
    assert url_filter.filter_urls(pages.union(pages)).count() == 8 and url_filter.filter_urls(pages.limit(0)).count() == 0


def test_thousands_of_rules_from_a_table(spark):
    rows = [("block" if i % 2 else "allow", f"host{i}.org", f"/p{i % 7}") for i in range(3000)]
    table = spark.createDataFrame(rows, "verdict string, host string, path string")
    rules = url_filter.rules_of(table)
    urls = [(i, f"https://www.host{i}.org/p{i % 7 if i % 3 else 9}/x") for i in range(0, 3000, 100)]
    got = url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), rules, ("**/x",)).collect()
    assert len(rules) == 3000
    for r in got:
        fits = r.page_id % 3 or r.page_id % 7 == 9
        assert (r.rule, r.verdict) == ((f"host{r.page_id}.org/p{r.page_id % 7}", "block" if r.page_id % 2 else "allow") if fits else (None, "block"))
    with pytest.raises(ValueError):
        url_filter.rules_of(spark.range(url_filter.MOST_RULES + 1).selectExpr("'allow' as verdict", "'h' as host", "'/' as path"))


def test_saved_folders_can_be_forgotten(spark):
    from pathlib import Path

    from wayfold.llm import common

    since = len(common.written())
    frames = [common.saved(spark.range(i + 1)) for i in range(3)]
    folders = [Path(p.removeprefix("file:")) for p in common.written()[since:]]
    assert all(f.exists() for f in folders)
    common.forget(spark, since, but=1)
    assert [f.exists() for f in folders] == [False, False, True] and frames[2].count() == 3 and len(common.written()) == since + 1


# fingerprints


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints_of_small_sets_are_exact(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefg") + str(rng.randrange(3)) for _ in range(rng.randrange(40))) for _ in range(60)] + ["", None]
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs(spark, texts)).collect()}
    for i, t in enumerate(t or "" for t in texts):
        follow = texts[i - 1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + follow[:n]
        a, b, c = plain_set(t), plain_set(edited), plain_set(follow)
        like = lambda p, q: 1.0 if p == q else len(p & q) / len(p | q) if p | q else 1.0
        assert got[i].near_edited == pytest.approx(like(a, b)) and got[i].near_next == pytest.approx(like(a, c))
        assert got[i].n_shingles_estimate == len(a) and len(got[i].sketch) == len(a)


def test_large_fingerprints_are_near_the_truth(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    texts = [" ".join(base)] + [" ".join(base[: 3000 - 200 * k] + [f"z{k}{j}" for j in range(200 * k)]) for k in range(1, 12)]
    got = fingerprint.edited_fingerprints(docs(spark, texts)).collect()
    errors = []
    for r in got:
        a, c = plain_set(texts[r.doc_id]), plain_set(texts[r.doc_id - 1])
        errors.append(abs(r.near_next - len(a & c) / len(a | c)))
        assert abs(r.n_shingles_estimate - len(a)) < 0.35 * len(a)
    assert max(errors) < 4 * math.sqrt(0.25 / fingerprint.K)  # four standard errors


def test_fingerprint_edges(spark):
    rows = [(5, "five a b c d e", "s"), (None, "null one", "s"), (3, LONG, "s"), (None, "null two", "s"), (5, "five a b c d e", "s"), (-2, "minus", "s")]
    got = fingerprint.edited_fingerprints(clashing(docs(spark, rows), *NAMES)).collect()
    assert len(got) == 6 and sum(r.doc_id is None for r in got) == 2
    chain = {r.doc_id: r.edited_sha256 for r in got if r.doc_id in (3, 5)}
    text = LONG
    assert chain[3] == hashlib.sha256((text[: len(text) - len(text) // 3] + "minus").encode()).hexdigest()
    nulls = {r.edited_sha256 for r in got if r.doc_id is None}
    options = {hashlib.sha256((t[:6] + f[:2]).encode()).hexdigest() for t in ("null one", "null two") for f in ("null one", "null two", "five a b c d e")}
    assert nulls <= options
    assert fingerprint.edited_fingerprints(docs(spark, rows).limit(0)).count() == 0
    with pytest.raises(TypeError):
        fingerprint.edited_fingerprints(docs(spark, rows).withColumn("doc_id", F.col("doc_id").cast("string")))


def test_followers_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET", 4)
    monkeypatch.setattr(fingerprint, "STRETCH", 8)
    monkeypatch.setattr(fingerprint, "BUCKETS", 10)
    ids = random.Random(1).sample(range(-500, 100_000), 300)
    made = fingerprint.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string"), ["text"])
    order = sorted(ids, reverse=True)
    assert {r.doc_id: r.next.text for r in made.collect()} == {i: f"t{j}" for i, j in zip(order, order[1:] + order[:1], strict=True)}
    rows = [(None, f"n{i}") for i in range(60)] + [(i, f"t{i}") for i in range(20)]
    made = fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"]).collect()
    assert len(made) == 80 and sorted(r.next.text for r in made) == sorted(t for _, t in rows)


# pages


PAGE = "page_id long, url string, html string"


def test_article_text_keeps_its_classes(spark):
    article = "<article><h1 class='entry-header'>Title</h1><p class='share'>one</p><figure><img><figcaption class='share ad'>cap</figcaption></figure><section class='social-history'>two</section><label>three</label><div class='share'>out</div><div id='comments'>out</div><div class='ad-slot'>out</div><form>out</form><ul class='notice-list'><li>four</li></ul></article>"
    text = html_extract.articles(html_extract.parse(f"<body><div class='site-header'>no</div>{article}</body>"), [])
    assert text == "Title\n\none\n\ncap\n\ntwo\n\nthree\n\nfour"
    assert html_extract.articles(html_extract.parse("<body><div class=post><div class=entry-header><h1>T</h1></div><p>long enough text</p></div></body>"), []) == "T\n\nlong enough text"


def page(i, story, aside):
    return f"<body><div class='story'><p>{story}</p></div><div class='archive n{i}'><p>{aside}</p></div></body>"


def test_the_host_vote_overrides_a_page(spark):
    long, short = "many words of a story " * 6, "teaser"
    rows = [(i, f"http://h.org/{i}", page(i, long, short)) for i in range(5)]
    rows += [(9, "http://h.org/9", page(9, "brief story", "a list of many other teasers " * 9)), (10, "http://other.org/1", page(9, "brief story", "a list of many other teasers " * 9))]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, PAGE)).collect()}
    assert got[9] == "brief story" and got[10].startswith("a list")


def test_pages_against_two_plain_passes(spark, monkeypatch):
    rng = random.Random(7)
    tags = ["div", "section", "article", "td"]
    rows = []
    for i in range(120):
        boxes = "".join(f"<{t} class='{rng.choice('abc')}'>{'w ' * rng.randrange(1, 30)}<a>{'l ' * rng.randrange(4)}</a></{t}>" for t in rng.choices(tags, k=rng.randrange(1, 5)))
        rows.append((i, f"http://h{i % 3}.org/{i}", f"<body>{boxes}</body>"))
    rows += rows[:5] + [(200, None, None), (201, "http://h0.org/e", "")]
    votes: dict = {}
    for _, url, body in rows:
        top = html_extract.best(html_extract.parse(body))
        if top:
            host = html_extract.split_url(url)[0]
            votes.setdefault(host, Counter())[html_extract.path_key(top[1])] += 1
    want = []
    for i, url, body in rows:
        tally = votes.get(html_extract.split_url(url)[0], Counter())
        keys = [k for k, _ in sorted(tally.items(), key=lambda x: (-x[1], x[0]))[: html_extract.PATHS]]
        want.append((i, html_extract.articles(html_extract.parse(body), keys)))
    table = clashing(spark.createDataFrame(rows, PAGE), "id", "host_key", "paths", "text", "salt", "n")
    for bound in (html_extract.BROADCAST_HOSTS, 0):
        monkeypatch.setattr(html_extract, "BROADCAST_HOSTS", bound)
        got = html_extract.extract_main_text(table).collect()
        assert sorted((r.page_id, r.text) for r in got) == sorted(want) and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract_main_text(table.limit(0)).count() == 0
    (row,) = html_extract.extract_main_text(spark.createDataFrame([(1, "http://x.org", f"<article><p>{LONG}</p></article>")], PAGE)).collect()
    assert row.text == LONG.strip()


# personal data


def brute_accept(edges):
    """Bootstrapping in plain Python: {pattern: (kind, confidence)}."""
    kinds: dict = {}
    for p, i, k in edges:
        old = kinds.get((p, i))
        kinds[p, i] = k if old in (None, "no") and k is not None and not (k == "no" and old) else max(filter(None, (old, k)), default=None) if old not in (None, "no") and k not in (None, "no") else old or k
    seeds, refused = {}, set()
    for (_, i), k in kinds.items():
        if k == "no":
            refused.add(i)
        elif k:
            seeds[i] = max(k, seeds.get(i, k))
    refused -= set(seeds)
    every = len({i for _, i in kinds})
    share = {k: min(0.5, max(1, sum(v == k for v in seeds.values())) / every) for k in pii.ALL_KINDS}
    by: dict = {}
    for p, i in kinds:
        by.setdefault(p, set()).add(i)
    supported = sum(sum(kinds[p, i] not in (None, "no") for i in own) >= pii.SUPPORT for p, own in by.items())
    bar = pii.MARGIN + math.log(max(1, supported))
    accepted: dict = {}
    found: dict = {}
    while True:
        known = {**{i: "no" for i in refused if i not in found}, **found, **seeds}
        size = len(accepted)
        for p, own in by.items():
            n = Counter(known.get(i) for i in own)
            kind = max(pii.ALL_KINDS, key=lambda k: (n[k], k))
            pos, judged = n[kind], sum(v for k, v in n.items() if k)
            r, null = pos / len(own), share[kind]
            gain = pos * math.log(r / null) + ((len(own) - pos) * math.log((1 - r) / (1 - null)) if r < 1 else 0) if r > null else 0
            if p not in accepted and pos >= pii.SUPPORT and pos / (judged + 1) >= pii.CONFIDENCE and r >= pii.SHARE and gain >= bar:
                accepted[p] = (kind, pos / (judged + 1))
        if len(accepted) == size:
            return accepted
        found = {}
        for (p, i), k in kinds.items():
            if p in accepted and i not in seeds and (k is None or k == "no" and not p.startswith("#")):
                found[i] = max(found.get(i, (0.0, "")), accepted[p][::-1])
        found = {i: v[1] for i, v in found.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bootstrapping_against_plain_python(spark, seed):
    rng = random.Random(seed)
    pattern_kind = {f"p{i}": rng.choice(pii.KINDS) for i in range(12)} | {f"#s{i}": rng.choice(pii.KINDS) for i in range(4)} | {f"q{i}": None for i in range(6)}
    edges = []
    for i in range(400):
        kind = rng.choice(pii.KINDS)
        fit = [p for p, k in pattern_kind.items() if k == kind or k is None or rng.random() < 0.02]
        seen = rng.choice([kind] * 6 + [None, None, "no"])
        edges += [(p, f"i{i}", seen) for p in rng.sample(fit, min(3, len(fit)))]
    got = pii.accept_patterns(spark.createDataFrame(edges, "pattern string, instance string, kind string"))
    want = brute_accept(edges)
    assert {r.pattern: (r.kind, round(r.confidence, 9)) for r in got.collect()} == {p: (k, round(c, 9)) for p, (k, c) in want.items()}
    assert want


def card(n):
    body = f"4{n:014d}"
    return body + str(next(d for d in range(10) if pii.luhn(body + str(d))))


def test_unseen_identifiers_of_every_kind_are_found(spark):
    filler = [f"the table {i} had {1000 + i} rows and version 3.{i} of it" for i in range(40)]
    seeds = [x for i in range(12) for x in (f"please charge card {card(i)} at once", f"write to the mail address u{i}@h{i}.example.org soon", f"she called phone number +1 (555) 010-{1000 + i} twice", f"logged from server node 10.0.{i}.7 today", f'and token = "{hashlib.sha1(str(i).encode()).hexdigest()}" is set')]
    unseen = {
        "card": "please charge card 4111-1111-1111-1112 at once",
        "email": "write to the mail address jane at example dot org soon",
        "phone": "she called phone number 555 010 9999 twice",
        "ip": "logged from server node 2001:db8::ff00:42:8329 today",
        "secret": 'and TOKEN = "AAAABBBBCCCCDDDD1111" is set',
    }
    joined = f"numbers {card(77)} {card(78)} here"
    texts = filler + seeds + list(unseen.values()) + [joined, None, "", LONG]
    got = pii.find_pii(clashing(docs(spark, texts), *NAMES)).orderBy("doc_id").collect()
    for k, (kind, text) in enumerate(unseen.items()):
        row = got[100 + k]
        assert not row.base and [s.kind for s in row.extra] == [kind], (kind, text, row)
    span = got[101].extra[0]
    assert unseen["email"][span.start : span.end] == "jane at example dot org"
    assert [s.kind for s in got[105].extra] == ["card", "card"] and not got[105].base
    assert not any(r.extra or r.base for r in got[:40]) and not got[106].extra and not got[108].extra
    again = docs(spark, [(1, t, "s") for t in seeds * 2])
    assert pii.find_pii(again).count() == 120 and pii.find_pii(again.limit(0)).count() == 0


def test_overlapping_spans_and_ties():
    assert pii.disjoint([(0.9, 0, 10, "card"), (0.9, 5, 20, "ip"), (0.8, 21, 25, "ip"), (0.9, 10, 12, "x")]) == [("ip", 5, 20), ("ip", 21, 25)]
    assert pii.disjoint([]) == [] and pii.base_spans("1.1.1.1@a.b")[0][0] == "email"
    text = "mail 1.2.3.4@h.org and +1 555 0100 200 4111111111111111"
    assert [k for k, _, _ in pii.base_spans(text)].count("ip") == 1
    assert pii.candidates("x" * 50_000 + "1" * 50_000, []) == [(0, 100_000)]


# pipeline


def test_each_stage_takes_odd_documents(spark, tmp_path):
    import corpus_pipeline

    base = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"calm text number {i} of the corpus " * 4, f"s{i % 3}") for i in range(40)] + [(40, None, None), (41, "", "s1"), (42, LONG, "s2"), (43, base, "s0"), (44, base, "s0"), (45, base + " x", None), (46, "one two three four five six seven eight nine ten eleven twelve thirteen", "s1")]
    table = clashing(docs(spark, rows), *NAMES)
    spark.createDataFrame([(1000 + i, i % 2) for i in range(6)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[-1][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for empty in (False, True):
        where, kept = tmp_path / f"documents{empty}", table.limit(0) if empty else table
        for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, kept, str(tmp_path))
            if name != "token_shards":
                assert made.columns == table.columns
            made.write.parquet(f"{where}/{number}")
            kept = spark.read.parquet(f"{where}/{number}")
            ids = sorted(r.doc_id for r in kept.collect())
            if not empty:
                gone = {"toxicity": set(), "near_duplicates": {44, 45}}.get(name, {44, 45, 46})
                assert ids == [i for i in range(47) if i not in gone], name
                if name == "mixing":
                    mixed = [r.doc_id for f in sorted(f for f in (where / str(number)).glob("part-*.parquet")) for r in spark.read.parquet(str(f)).collect()]
            else:
                assert ids == []
        if not empty:
            assert [r.doc_id for r in sorted(kept.collect(), key=lambda r: r.position)] == mixed
