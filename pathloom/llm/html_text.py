"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of block elements (a node is its
chain of tags and classes). A node's presentation importance is the entropy of
the child sequences it has, its content importance one minus the mean entropy
of its texts' spread over pages: what looks and reads the same on every page of
a host is furniture, what differs is content. Branches of low importance are
removed. What differs from page to page and still is no text (rotating adverts,
reader comments, related links) no entropy can tell, nor anything on a host with
few pages: elements whose names say what they are (menus, forms, adverts, ...)
never count as text, and where a page marks its article only that counts. Names
are those of an element itself: a class that only tells how a page is laid out
(``has-sidebar``, ``no-comments``), and any class of ``html``, ``body`` or
``main``, or of an article within no other, names nothing.

Pages of a host whose text is the same (repeated rows, mirrors) count once, so
what only copies share is not furniture; and where a marked article would lose
more than half of its characters, its pages are copies but for a date or the
like, and it stays whole.

How it holds at scale: pages are parsed one by one; copies are found by a hash
of host and text, and the tree's rows are counted per batch and then by map-side
combined aggregation over (host, node, value) hashes, so a host with a third of
all pages is no group anywhere. Chains end at DEPTH elements, and what is nested
deeper counts to the last, so a page costs time and memory in proportion to its
length however deep it is. Of the tree only nodes to be removed are kept. They are shipped with the function while
there are at most 50,000; beyond that each page gets its host's list by a join.

Defined results: a null or empty html gives an empty text. Markup that never
ends is read to the end of the page; a broken reference stays as it is.
Repeated rows each keep a row, an empty table gives no rows. Columns other than
id, url and html pass unseen, so none can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .reputation import host_and_path
from .store import cut, drop

#: Element names. Fixed values.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "noframes")
SKIPPED = set("head nav footer aside form button menu dialog search canvas audio video map label fieldset".split())
#: Words of class, id and role that name furniture.
FURNITURE = set("ad ads advert adverts advertisement advertising sponsor sponsored banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disqus footer menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related replies reply search share sharing sidebar skip social subscribe toolbar widget".split())
HEADING = {"header", "masthead"}
#: A class that begins with one of these tells of a page's layout.
LAYOUT = re.compile(r"(?:has|no|with|without|is|js|hide|show|not)[-_]")
UNNAMED = {"html", "body", "main"}

TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<[a-zA-Z][^<]*\Z", re.S)
ATTRIBUTE = re.compile(r"([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
CLOSES_P = BLOCKS - {"html", "body"}

SHIPPED = 50_000
DEPTH = 64
LEAST_PAGES = 5
LOWEST = 0.3
DECAY = 0.9


class Block:
    __slots__ = ("nodes", "parts", "in_article")

    def __init__(self, nodes: tuple[int, ...], in_article: bool):
        self.nodes, self.parts, self.in_article = nodes, [], in_article


_nodes: dict[tuple[int, str], int] = {}


def _node(parent: int, name: str) -> int:
    """A 63-bit number of the node below ``parent``; remembered within bounds."""
    if (got := _nodes.get((parent, name))) is None:
        if len(_nodes) > 100_000:
            _nodes.clear()
        got = _nodes[parent, name] = int.from_bytes(hashlib.blake2b(f"{parent} {name}".encode(), digest_size=8).digest(), "big") >> 1
    return got


def parse(html: str) -> tuple[list[tuple[tuple[int, ...], str]], dict[int, list[str]], bool]:
    """The text blocks of a page outside furniture, each with its chain of nodes, the child names of each node, and whether the blocks are a marked article.

    Elements that a page hides are text like others: the contract drops what an element is, not how it is shown.
    """
    stack: list[tuple[str, int, bool, bool]] = []  # tag, node, skipped, within an article
    open_tags: Counter = Counter()
    paragraphs: list[int] = []  # places of open p in the stack
    walls: list[int] = []  # places of what an open p does not reach through
    blocks: list[Block] = []
    children: dict[int, list[str]] = {}
    now: Block | None = None
    at, end = 0, len(html)

    def close(i: int) -> None:
        for tag, *_ in stack[i:]:
            open_tags[tag] -= 1
        del stack[i:]
        for places in (paragraphs, walls):
            while places and places[-1] >= i:
                places.pop()

    while at < end:
        m = TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at and not (stack and stack[-1][2]):
            if now is None:
                now = Block(tuple(s[1] for s in stack[:DEPTH]), bool(stack and stack[-1][3]))
                blocks.append(now)
            now.parts.append(html[at:stop])
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS:
                now = None
            if open_tags[tag]:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                close(i)
            continue
        if tag in RAW_END:
            if not m[3].endswith("/"):
                found = RAW_END[tag].search(html, at)
                at = found.end() if found else end
            continue
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            now = None
        if tag in VOID or not (block or tag in SKIPPED):
            continue
        if tag in CLOSES_P and paragraphs and not (walls and walls[-1] > paragraphs[-1]):
            close(paragraphs[-1])
        if tag in ("li", "dd", "dt", "tr", "td", "th") and stack and stack[-1][0] == tag:
            close(len(stack) - 1)
        if tag == "body" or len(stack) == 1 and stack[0][0] == "head":
            close(1 if stack and stack[0][0] == "html" else 0)
        parent, skipped, article = stack[-1][1:] if stack else (0, False, False)
        own, names, name = set(), set(), tag
        if m[3]:
            values = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m[3])}
            marks = " ".join(values.get(k, "") for k in ("class", "id", "role")).lower()
            own = {x for word in marks.split() if not LAYOUT.match(word) for x in re.split(r"[^a-z0-9]+", word)}
            if tag not in UNNAMED and (tag != "article" or article):
                names = own
            name = f"{tag}.{values.get('class', '')}"
        article = article or tag in ("article", "main") or "article" in own and tag in ("div", "section")
        skipped = skipped or tag in SKIPPED or bool(names & FURNITURE) or not article and (tag == "header" or bool(names & HEADING))
        node = parent
        if len(stack) < DEPTH:
            node = _node(parent, name)
            children.setdefault(parent, []).append(name)
        open_tags[tag] += 1
        if tag == "p":
            paragraphs.append(len(stack))
        elif tag in ("td", "th", "table", "button"):
            walls.append(len(stack))
        stack.append((tag, node, skipped, article))
    kept = [(b.nodes, t, b.in_article) for b in blocks if (t := " ".join(unescape("".join(b.parts)).split()))]
    marked = any(a for *_, a in kept)
    if marked:
        kept = [b for b in kept if b[2]]
    return [(nodes, t) for nodes, t, _ in kept], children, marked


def _value(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, importance) of the nodes that at least LEAST_PAGES different pages of a host have, from (host, html)."""

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, bytes] = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks, children, _ = parse(html or "")
                if not blocks:
                    continue
                texts = sorted({(node, _value(t)) for nodes, t in blocks for node in nodes})
                nodes = sorted({node for node, _ in texts})
                shown = [(node, _value(" ".join(children.get(node, ())))) for node in nodes]
                tree = np.array([(len(texts), 0), *texts, *shown], np.int64).tobytes()
                key = host, _value("\n".join(t for _, t in blocks))
                rows[key] = min(tree, rows.get(key, tree))
            keys = list(zip(*rows, strict=True)) if rows else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int64()), pa.array(rows.values(), pa.binary())], ["host", "content", "tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: Counter = Counter()
            for host, tree in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (n, _), *pairs = np.frombuffer(tree, np.int64).reshape(-1, 2).tolist()
                rows.update((host, node, int(i >= n), value) for i, (node, value) in enumerate(pairs))
            keys = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int64()), pa.array(keys[2], pa.int32()), pa.array(keys[3], pa.int64()), pa.array(rows.values(), pa.int64())], ["host", "node", "kind", "value", "n"])

    # A page content counts once; of its copies the least tree stands for all.
    distinct = pages.select("host", "html").mapInArrow(contents, "host string, content long, tree binary").groupBy("host", "content").agg(F.min("tree").alias("tree"))
    rows = distinct.select("host", "tree").mapInArrow(run, "host string, node long, kind int, value long, n long")
    counts = rows.groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("n"))
    # Of presentations n pages each: entropy ln m - sum(n ln n) / m. Of a text on n pages alike: entropy ln n.
    nodes = counts.groupBy("host", "node").agg(
        F.sum(F.expr("if(kind = 1, n, 0)")).alias("m"),
        F.sum(F.expr("if(kind = 1, n * ln(n), 0D)")).alias("shown"),
        F.sum(F.expr("if(kind = 1, 1, 0)")).alias("styles"),
        F.sum(F.expr("if(kind = 0, ln(n), 0D)")).alias("spread"),
        F.sum(F.expr("if(kind = 0, 1, 0)")).alias("texts"),
    ).where(f"m >= {LEAST_PAGES}")
    presentation = F.expr("(ln(m) - shown / m) / ln(m)")
    content = F.expr("1 - spread / texts / ln(m)")
    share = F.pow(F.lit(DECAY), F.col("styles"))
    return nodes.select("host", "node", ((1 - share) * presentation + share * F.greatest(content, F.lit(0.0))).alias("importance"), content.alias("content"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", lowest: float = LOWEST) -> DataFrame:
    """Per page its id, url, ``text`` (blocks of the main text, one a line) and ``n_chars``."""
    own = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("html"))
    host, _ = host_and_path(F.col("_url"))
    own = own.withColumn("host", host)
    low = cut(style_tree(own).where(f"importance < {lowest} and content < {lowest}").select("host", "node"))
    few = low.count() <= SHIPPED
    removed: dict[str, set[int]] = {}
    if few:
        for r in low.collect():
            removed.setdefault(r["host"], set()).add(r["node"])
        own = own.withColumn("low", F.lit(None).cast("array<bigint>"))
    else:
        own = own.join(low.groupBy("host").agg(F.collect_set("node").alias("low")), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, html, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                gone = removed.get(host, set()) if low is None else set(low)
                blocks, _, marked = parse(html or "")
                left = [t for nodes, t in blocks if gone.isdisjoint(nodes)]
                if marked and 2 * sum(map(len, left)) < sum(len(t) for _, t in blocks):
                    left = [t for _, t in blocks]
                texts.append("\n".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    own = own.select("_id", "_url", "host", "html", "low")
    kind = own.schema["_id"].dataType.simpleString()
    out = own.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    if few:
        drop(low)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
