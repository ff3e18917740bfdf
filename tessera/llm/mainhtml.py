"""Operator 9: main-text extraction from HTML by minimum-cut labelling.

A page is cut into text blocks at its block-level tags.  A linear classifier scores each block from its
element, its ancestors (names, class and id words), link density and length; the score gives the costs of
the labels "content" and "boilerplate" as terminal capacities.  Blocks next to one another and blocks
under one parent are joined by smoothness edges, weaker the further apart they are in the tree and where one
is in an article and the other is not.  The maximum flow separates the two labels at least cost; blocks on the
content side are the text.  Elements that say what they are (an article, a menu, an advert) weigh more than
the edges; where a page has no such elements, edges decide on short and on linked blocks by what is around them.
Pages are independent: Spark spreads them over tasks and each is labelled inside one, in time linear in
the page but for the flow.

Form controls (button, select, textarea) count as forms; noscript, iframe, noframes and template contents are never shown.

Results of odd input: a null or empty page has an empty text; a tag, comment or quoted value that is not closed
goes on to the end of the page, an element that is not closed ends with its parent, stray end tags only end blocks; pages of any length are read whole; repeated rows give equal rows; further input
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names and the words that sites use in class and id attributes.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mover mroot mrow ms msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover nobr object q rp rt ruby s samp semantics small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select button noframes".split())
P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT_WORDS = frozenset("article articlebody blog body content entry hentry main maincontent post posttext story text".split())
BOILER_WORDS = frozenset("ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies copyright dialog discussion disqus feedback footer form gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())


# Words that parts of articles have as well.
VAGUE_WORDS = frozenset("byline caption disclaimer meta reader tags toc".split())


@dataclass(frozen=True)
class Costs:
    """Weights of the classifier and of the smoothness edges."""

    bias: float = -1.0
    article: float = 3.0
    content_word: float = 2.0
    boiler_element: float = -6.0
    boiler_word: float = -7.0
    vague_word: float = -1.5
    page_header: float = -4.0
    outside_article: float = -4.0
    paragraph: float = 0.5
    heading: float = 0.5
    list_item: float = -0.3
    link_share: float = -4.0
    words_per_point: float = 30.0
    most_length: float = 1.5
    adjacency: float = 1.5
    siblings: float = 0.6
    across: float = 0.2


BOILER_ELEMENTS = frozenset("nav aside footer form menu dialog fieldset".split())
# A tag goes on to its bracket or the end of the page; quotes count after an equals sign only.  Every branch takes what it has read, so a page is read once.
_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^>=]|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)>?|<[!?/][^>]*+>?|[^<]+|<", re.S)
_ATTR = re.compile(r"([a-zA-Z][\w:-]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s\"'>]++)))?")
_RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW | {"xmp"}}
_HEAD_END = re.compile(r"</head\s*+>|<body\b", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@lru_cache(maxsize=4096)
def _element(tag: str, attributes: str, in_article: bool, costs: Costs) -> tuple[float, bool]:
    """What an element adds to the score of everything inside it, and whether it holds an article."""
    score, article = 0.0, tag in ("article", "main")
    if tag in BOILER_ELEMENTS:
        score += costs.boiler_element
    if tag == "header" and not in_article:
        score += costs.page_header
    if attributes.strip():
        got = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attributes)}
        role = got.get("role", "").lower()
        article = article or role in ("main", "article")
        words = {w.lower() for key in ("class", "id") for w in _WORD.findall(got.get(key, ""))} | {w for key in ("class", "id") for w in got.get(key, "").lower().split()}
        boiler = words & BOILER_WORDS
        if words & VAGUE_WORDS and not boiler:
            score += costs.vague_word
        if boiler or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"):
            score += costs.boiler_word
        elif "header" in words and not in_article:
            score += costs.page_header
        elif words & CONTENT_WORDS:
            score += costs.content_word
        if "hidden" in got or got.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", got.get("style", "")):
            score += costs.boiler_element
    return score + (costs.article if article and not in_article else 0.0), article


@dataclass
class Block:
    text: str
    tag: str
    region: float
    in_article: bool
    parent: int
    depth: int
    linked: int


def blocks_of(html: str, costs: Costs) -> list[Block]:
    """The text blocks of a page in page order."""
    out: list[Block] = []
    # of each open block-level element: tag, region score, in article, number
    stack: list[tuple[str, float, bool, int]] = [("", 0.0, False, 0)]
    opened: Counter[str] = Counter()
    text: list[str] = []
    head_seen = False
    made, linked, links, at = 0, 0, 0, 0

    def close_block() -> None:
        nonlocal linked
        if text:
            joined = " ".join(unescape("".join(text)).split())
            text.clear()
            if joined:
                tag, region, article, number = stack[-1]
                out.append(Block(joined, tag, region, article, stack[-2][3] if len(stack) > 1 else number, len(stack), linked))
        linked = 0

    def leave() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    n = len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                text.append(piece)
                if links:
                    linked += len(piece)
            continue
        tag = tag.lower()
        if m[1]:
            if tag in INLINE:
                links -= tag == "a" and links > 0
            else:
                close_block()
                if opened[tag]:
                    links = 0
                    while leave() != tag:
                        pass
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag == "head":
            end = None if head_seen else _HEAD_END.search(html, at)
            head_seen = True
            if end:
                at = end.end() if end[0][1] == "/" else end.start()
            close_block()
            continue
        if tag in _RAW_END:
            if tag not in ("svg", "button", "select"):
                close_block()
            end = _RAW_END[tag].search(html, at)
            if tag == "xmp":  # its text is shown as it is
                text.append(html[at : end.start() if end else n].replace("&", "&amp;"))
                close_block()
            at = end.end() if end else n
            continue
        if tag in INLINE:
            links += tag == "a"
            continue
        close_block()
        links = 0
        if tag in P_CLOSERS and stack[-1][0] == "p":
            leave()
        if tag in ("li", "td", "th", "tr", "dt", "dd", "option") and stack[-1][0] == tag:
            leave()
        if tag in VOID:
            continue
        _, region, article, _ = stack[-1]
        add, opens = _element(tag, m[3], article, costs)
        made += 1
        opened[tag] += 1
        stack.append((tag, region + add, article or opens, made))
    close_block()
    return out


def scores(found: list[Block], costs: Costs) -> list[float]:
    """Log-odds of content."""
    framed = any(b.in_article and b.region > 0 for b in found)
    out = []
    for b in found:
        n = b.text.count(" ") + 1
        s = costs.bias + b.region + min(costs.most_length, n / costs.words_per_point) + costs.link_share * min(1.0, b.linked / max(1, len(b.text)))
        s += costs.paragraph if b.tag in ("p", "blockquote", "pre") else costs.heading if b.tag in HEADINGS else costs.list_item if b.tag in ("li", "td", "th", "dd", "dt") else 0.0
        out.append(s + (costs.outside_article if framed and not b.in_article else 0.0))
    return out


def edges_of(found: list[Block], costs: Costs) -> list[tuple[int, int, float]]:
    """Smoothness edges between neighbours, and between successive blocks of one parent."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            apart = abs(found[i - 1].depth - b.depth) + (0 if found[i - 1].parent == b.parent else 1)
            out.append((i - 1, i, costs.adjacency / (1 + apart) * (1.0 if found[i - 1].in_article == b.in_article else costs.across)))
        if b.parent in last:
            out.append((last[b.parent], i, costs.siblings * (1.0 if found[last[b.parent]].in_article == b.in_article else costs.across)))
        last[b.parent] = i
    return out


def min_cut(to_content: list[float], to_boiler: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut.

    to_content[i] is the capacity from the source (cut if i becomes boilerplate), to_boiler[i] that to the sink.
    Shortest augmenting paths in level graphs."""
    n = len(to_content)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    ends: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(ends))
        ends.append(b)
        room.append(forth)
        head[b].append(len(ends))
        ends.append(a)
        room.append(back)

    for i in range(n):
        both = min(to_content[i], to_boiler[i])  # flows straight through
        if to_content[i] > both:
            join(source, i, to_content[i] - both, 0.0)
        if to_boiler[i] > both:
            join(i, sink, to_boiler[i] - both, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] > 1e-12 and level[ends[e]] < 0:
                    level[ends[e]] = level[a] + 1
                    queue.append(ends[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                path, a = [], source
                continue
            while tried[a] < len(head[a]):
                e = head[a][tried[a]]
                if room[e] > 1e-12 and level[ends[e]] == level[a] + 1:
                    break
                tried[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                a = ends[e ^ 1]
                tried[a] += 1
                continue
            path.append(e)
            a = ends[e]


def label(found: list[Block], costs: Costs) -> list[bool]:
    """True for content."""
    odds = scores(found, costs)
    cost = [max(0.0, s) + math.log1p(math.exp(-abs(s))) for s in odds]  # log(1 + e^s): of the label boilerplate
    return min_cut(cost, [c - s for c, s in zip(cost, odds, strict=True)], edges_of(found, costs))


def main_text(html: str | None, costs: Costs = Costs()) -> str:  # noqa: B008
    found = blocks_of(html or "", costs)
    return " ".join(b.text for b, kept in zip(found, label(found, costs), strict=True) if kept)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", costs: Costs = Costs()) -> DataFrame:  # noqa: B008
    """page_id, url, text and n_chars of every page."""
    src = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                texts = [main_text(h, costs) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = src.schema
    return src.mapInArrow(run, f"page_id {kinds['page_id'].dataType.simpleString()}, url {kinds['url'].dataType.simpleString()}, text string, n_chars long")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
