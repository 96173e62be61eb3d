"""HTML main text by consensus host paths.

Pass 1 scores every page's containers (text outside links, weighted by tag) and lets the page vote for the generalised
tag-class path of its best one; votes are summed per host and path in Spark, so a host with a third of all pages costs
one row per map task. Pass 2 extracts each page again with its host's winning paths, and by its own best container
where none of them occurs.

A generalised path is the chain of tags from the root, each with its classes and id, digits folded to ``#``.

Text: blocks in page order joined by two newlines; white space inside a block becomes one space. Menus, page headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out. Outside an article a block
container whose class or id has a part from the name list is one of them; inside an article only one whose
whole class or id is on the list of inserted blocks. Headings, paragraphs, figures, captions, lists and inline elements
are text whatever their classes are.

Edge cases: null or empty html, or a page without any text, gives an empty text; a page without a container (the body
tag is optional) is taken whole, and one whose containers are mostly links by the best of them; a page without a host
votes for the empty host; unclosed tags and comments end with the page; pages of any length are parsed whole; equal
votes go to the lesser path key, equal scores on a page to the container that comes first; repeated rows vote and are
extracted each for itself; null ids are kept; an empty table gives an empty result; only the named columns are read, so
others may have any name.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import saved, small_batches
from wayfold.llm.url_filter import split_url

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg|select|xmp|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

#: Elements without an end tag, elements that end an open paragraph, containers and left-out elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = {"article": 3.0, "main": 2.0, "section": 1.2, "div": 1.0, "td": 0.8, "body": 0.5}
LEFT_OUT = frozenset("nav footer aside form button menu dialog head".split())
LEFT_OUT_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: Parts of class names and ids of page furniture, and whole ones of blocks inserted into articles.
LEFT_OUT_NAME = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored banner promo promotion cookie cookies consent gdpr notice notices alert menu nav navbar navigation sidebar breadcrumb breadcrumbs footer masthead comment comments disqus share sharing social related recommended newsletter subscribe subscription popup modal overlay pagination pager toolbar widget login signup form".split()
)
INSERTED = frozenset(
    "ad ads advert advertisement ad-slot ad-container ad-banner ad-unit sponsored sponsored-content promo cookie cookies cookie-notice cookie-banner consent notice notices menu nav navbar navigation sidebar breadcrumb breadcrumbs comment comments comment-list comments-area comments-section user-comments disqus disqus_thread share sharing share-buttons social social-share related related-posts related-articles recommended newsletter newsletter-signup subscribe popup modal overlay pagination pager toolbar signup login".split()
)
PAGE_HEADER = frozenset("header site-header page-header main-header global-header top-header siteheader pageheader".split())
#: Elements that are left out by name.
NAMED = frozenset("div section ul ol table aside header center dl details".split())
PEERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


#: Mark of a block border among a node's items.
BREAK = None


class Node:
    __slots__ = ("tag", "label", "parent", "out", "size", "linked", "items")

    def __init__(self, tag: str, label: str, parent, out: bool):
        self.tag, self.label, self.parent, self.out = tag, label, parent, out
        self.size = self.linked = 0
        self.items: list = []

    def path(self) -> str:
        node, labels = self, []
        while node is not None and node.tag:
            labels.append(node.label)
            node = node.parent
        return ">".join(reversed(labels))


def _attributes(text: str) -> dict:
    return {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in ATTRIBUTE.finditer(text)} if text and not text.isspace() else {}


def _left_out(tag: str, attributes: dict, inside_article: bool) -> bool:
    if tag in LEFT_OUT or tag == "header" and not inside_article:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in LEFT_OUT_ROLE:
        return True
    if tag not in NAMED:
        return False
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    if inside_article:
        return any(name in INSERTED for name in names)
    return any(name in PAGE_HEADER or part in LEFT_OUT_NAME for name in names for part in re.split(r"[-_\d]+", name))


def parse(page: str | None) -> Node:
    """A light tree: nodes hold child nodes, text pieces and marks of block borders."""
    root = Node("", "", None, False)
    node, at, depth_article, page = root, 0, 0, page or ""

    def text(piece: str) -> None:
        if piece and not node.out:
            piece = entities.unescape(piece) if "&" in piece else piece
            node.items.append(piece)
            n = len(piece) - piece.count(" ") if not piece.isspace() else 0
            up, link = node, node.tag == "a"
            while up is not None and n:
                up.size += n
                if link:
                    up.linked += n
                up = up.parent
                link = link or (up is not None and up.tag == "a")

    def close(to) -> None:
        nonlocal node, depth_article
        while node is not to:
            depth_article -= node.tag == "article"
            node = node.parent

    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if not m[3]:
            if m[1]:
                node.items.append(" ")
            continue
        tag = m[3].lower()
        if m[2]:
            up = node
            while up.tag and up.tag != tag and not (up.tag in ("td", "th") and tag not in ("tr", "table", "tbody", "thead", "tfoot", "body", "html")):
                up = up.parent
            if up.tag == tag:
                close(up.parent)
            if tag in BLOCK:
                node.items.append(BREAK)
            continue
        if tag == "br":
            node.items.append(" ")
            continue
        if tag in BLOCK:
            up = node
            while up.tag and up.tag != "p" and up.tag not in CONTAINER and up.tag not in ("li", "td", "th", "blockquote", "form", "nav", "footer", "header", "aside"):
                up = up.parent
            if up.tag == "p":
                close(up.parent)
            if tag in PEERS:
                up, barrier = node, BARRIER.get(tag, set())
                while up.tag and up.tag not in barrier and up.tag not in PEERS[tag]:
                    up = up.parent
                if up.tag in PEERS[tag]:
                    close(up.parent)
            node.items.append(BREAK)
        if tag in VOID:
            continue
        attributes = _attributes(m[4])
        names = "".join("." + c for c in sorted(attributes.get("class", "").split())) + ("#" + attributes["id"] if attributes.get("id") else "")
        child = Node(tag, tag + re.sub(r"\d+", "#", names), node, node.out or _left_out(tag, attributes, depth_article > 0))
        node.items.append(child)
        if not m[4].rstrip().endswith("/") or tag in BLOCK:
            node = child
            depth_article += tag == "article"
    text(page[at:])
    return root


def containers(root: Node) -> list[tuple[float, str, Node]]:
    """(score, path, node) of containers that hold text, in page order; the page stands for a body that isn't written."""
    out, stack, body = [], [root], False
    while stack:
        node = stack.pop()
        children = [x for x in node.items if isinstance(x, Node)]
        stack += reversed(children)
        body |= node.tag == "body"
        if (node is root or node.tag in CONTAINER) and not node.out and node.size:
            inner = max((c.size for c in children if c.tag in CONTAINER), default=0)
            score = CONTAINER[node.tag or "body"] * (node.size - 2 * node.linked) * (0.4 if inner > 0.9 * node.size and node.tag != "article" else 1.0)
            out.append((score, node.path(), node))
    return [x for x in out if x[2] is not root] if body else out


def text_of(node: Node) -> str:
    blocks: list[list[str]] = [[]]
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is BREAK:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif not x.out:
            stack += reversed(x.items)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(x for x in lines if x)


def best(root: Node) -> tuple[float, str, Node] | None:
    found = containers(root)
    top = max(found, key=lambda x: x[0], default=None)
    return top if top and top[0] > 0 else None


def path_key(path: str) -> int:
    return xxhash.xxh64_intdigest(path.encode()) - (1 << 63)


def articles(root: Node, keys: list[int]) -> str:
    """Text of the containers on the first winning path that occurs; else of the page's best container."""
    found = containers(root)
    for key in keys:
        nodes = [n for _, p, n in found if path_key(p) == key]
        if nodes:
            return "\n\n".join(t for t in map(text_of, nodes) if t)
    return text_of(max(found, key=lambda x: x[0])[2]) if found else ""


#: So many winning paths a host has, so many hosts are broadcast at most (24 bytes and 8 a path each), and into so many
#: parts the pages of a host are dealt beyond that.
PATHS, BROADCAST_HOSTS, SALTS = 2, 200_000, 64


def vote_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host_key, paths: keys of each host's winning paths, by votes and then by path key."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict = {}
            for url, page in zip(batch.column(0), batch.column(1), strict=True):
                top = best(parse(page.as_py()))
                if top:
                    key = (path_key("h" + split_url(url.as_py())[0]), path_key(top[1]))
                    n, s = tally.get(key, (0, 0.0))
                    tally[key] = (n + 1, s + top[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in tally], pa.int64()) for i in (0, 1)] + [pa.array([v[0] for v in tally.values()], pa.int64())],
                names=["host_key", "path_key", "n"],
            )

    cast = pages.select(url_col, html_col).mapInArrow(votes, "host_key long, path_key long, n long")
    summed = cast.groupBy("host_key", "path_key").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("host_key").orderBy(F.desc("n"), "path_key"))
    top = summed.withColumn("place", place).filter(F.col("place") <= PATHS)  # a host's paths stay rows until two are left
    return top.groupBy("host_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path_key"))), lambda x: x["path_key"]).alias("paths"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    pages = small_batches(pages)
    winners = saved(vote_paths(pages, url_col, html_col))

    def with_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([path_key("h" + split_url(u)[0]) for u in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=["id", "url", "html", "host_key"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [articles(parse(p.as_py()), list(k.as_py() or [])) for p, k in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[id_col, "url", "text", "n_chars"]
            )

    kind = pages.schema[id_col].dataType.simpleString()
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    keyed = slim.mapInArrow(with_host, f"id {kind}, url string, html string, host_key long")
    if winners.count() <= BROADCAST_HOSTS:
        joined = keyed.join(F.broadcast(winners), "host_key", "left")
    else:
        dealt = keyed.withColumn("salt", F.pmod(F.xxhash64("url", "id"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host_key", "salt"], "left")
    joined = joined.select("id", "url", "html", "paths")
    return joined.mapInArrow(extract, f"`{id_col}` {kind}, url string, text string, n_chars long")
