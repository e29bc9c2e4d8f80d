"""Main-text extraction by minimum-cut labelling.

A page is cut into blocks of text. A linear classifier gives each block the cost of
calling it content and of calling it boilerplate, which become capacities to two
terminals; blocks that follow each other and blocks under one container are tied by
smoothness edges, stronger the nearer they are in the DOM. The minimum cut is the
cheapest labelling of the whole page.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_PLAIN = re.compile(r"[^>\"']*+")
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|\Z)""", re.I)
_WORDS = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
SPACES = frozenset("br td th wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is up to their end tag, without markup.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements that show no text of the page: code, pictures and media, form controls, and the source of a formula beside the formula.
SILENT = RAW - {"xmp"} | frozenset("template svg canvas object video audio select button datalist annotation annotation-xml head".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template head".split())
#: Regions beside the article; ``header`` only outside an article.
OUTSIDE = frozenset("nav footer aside dialog menu fieldset".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status tablist".split())
#: Regions that often are beside the article but may hold it, too.
DOUBTFUL = frozenset("form noscript".split())
INSIDE = frozenset("article main".split())
#: Words of class names and ids that speak for a region beside the article, or for the article.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related "
    "recommended recommendations comment comments reply replies respond disqus newsletter subscribe subscription signup login search "
    "pagination pager footer masthead topbar toolbar widget widgets tagcloud copyright outbrain taboola".split()
)
GOOD_NAMES = frozenset("article content entry story post main".split())
#: Words of names that say how something is laid out, not what it is.
LAYOUT_NAMES = frozenset(
    "area bar block body bottom box col column container content group header holder inner item items left link links list outer panel "
    "posts right section side site text top unit wrap wrapper".split()
)
#: Words by which a name says that something is there, or isn't, rather than that this is it.
ABOUT_NAMES = frozenset("has with no non not without free hide is under".split())

#: Weights of the block classifier, as log-odds: positive speaks for content. All that a block's text says lies
#: within about 3 of 0, so a region outweighs it and ties decide what neither says clearly.
BIAS = -0.5
W_OUTSIDE, W_NAMED, W_DOUBTFUL, W_INSIDE, W_GOOD = -5.0, -5.0, -2.0, 2.5, 1.0
W_LENGTH, W_LINKS, W_STOP, W_HEADING = 0.9, -3.0, 0.8, 0.6
#: Log of words at which length says neither, and at which more words say no more.
LENGTH_EVEN, LENGTH_MOST = 1.5, 3.5
#: A region below this isn't made content by an article inside it (a reader's comment, say).
STRONG = -3.0
#: Weights of the smoothness edges; blocks are never further apart than ``FAR`` steps of the DOM.
NEXT, NEAR, SIBLING = 0.3, 1.5, 0.4
FAR = 16


def name_score(names: str) -> float:
    """0 to ``W_NAMED`` for class names and ids: the worst of them counts.

    A name counts by the share of its telling words that speak for a region beside the
    article, so ``comment-list`` counts in full and ``search-algorithms`` by an eighth.
    """
    worst = 0.0
    for name in names.split():
        words = _WORDS.findall(name)
        bad = sum(w in BAD_NAMES for w in words)
        if bad and ABOUT_NAMES.isdisjoint(words):
            telling = sum(w in BAD_NAMES or w not in LAYOUT_NAMES for w in words)
            worst = min(worst, W_NAMED * (bad / telling) ** 3)
    return worst


class _Element:
    __slots__ = ("tag", "parent", "depth", "against", "favour", "inside", "silent")

    def __init__(self, tag: str, attrs: str, parent: _Element | None) -> None:
        self.tag, self.parent = tag, parent
        if parent is None:
            self.depth, self.against, self.favour, self.inside, self.silent = 0, 0.0, 0.0, False, False
            return
        self.depth, self.against, self.favour, self.inside = parent.depth + 1, parent.against, parent.favour, parent.inside
        self.silent = parent.silent or tag in SILENT
        role = names = ""
        against = 0.0
        if attrs and not attrs.isspace():
            for key, a, b, c in _ATTR.findall(attrs):
                key, value = key.lower(), (a or b or c).lower()
                if key == "role":
                    role = value
                elif key in ("class", "id"):
                    names += " " + value
                elif key == "hidden" or (key == "style" and "display:none" in value.replace(" ", "")):
                    against = W_OUTSIDE
                elif key == "aria-hidden" and value == "true":
                    against = min(against, W_DOUBTFUL)
        if tag in INSIDE or role in INSIDE:
            if self.against > STRONG:
                self.favour = W_INSIDE
            self.inside = True
        if tag in OUTSIDE or role in OUTSIDE_ROLES or (tag == "header" and not self.inside):
            against = W_OUTSIDE
        elif tag in DOUBTFUL:
            against = min(against, W_DOUBTFUL)
        if names and tag not in ("html", "body"):
            named = name_score(names)
            if named < 0:
                against = min(against, named)
            elif not self.favour and self.against > STRONG and not GOOD_NAMES.isdisjoint(_WORDS.findall(names)):
                self.favour = W_GOOD
        if against <= STRONG:
            self.favour = 0.0
        self.against = min(self.against, against)


class Block:
    __slots__ = ("text", "links", "element", "heading")

    def __init__(self, text: str, links: int, element: _Element, heading: bool) -> None:
        self.text, self.links, self.element, self.heading = text, links, element, heading


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name, data)`` in page order: kind is ``text``, ``open`` or ``close``; linear in the page's length.

    A comment or raw element without an end goes on to the end of the page; a tag without ``>`` and
    what is after it are dropped, as browsers do. A quote opens a value only after ``=`` and if it is closed.
    """
    at, end, last = 0, len(html), html.rfind(">")
    gone = {'"': False, "'": False}
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            yield "text", "", html[at:lt]
            at = lt
            continue
        after = html[lt + 1 : lt + 2]
        if after in ("!", "?"):
            if html.startswith("<!--", lt):
                close = html.find("-->", lt + 2)
                at = end if close < 0 else close + 3
            else:
                at = end if lt > last else html.index(">", lt) + 1
            continue
        name = _NAME.match(html, lt + 1 + (after == "/"))
        if name is None:
            yield "text", "", "<"
            at = lt + 1
            continue
        if lt > last:
            return
        stop = name.end()
        while True:
            since = stop
            stop = _PLAIN.match(html, since).end()
            if stop >= end:
                return
            quote = html[stop]
            if quote == ">":
                break
            close = -1
            if not gone[quote] and html[since:stop].rstrip().endswith("="):
                close = html.find(quote, stop + 1)
                gone[quote] = close < 0
            stop = stop + 1 if close < 0 else close + 1
        tag = name[0].lower()
        yield "close" if after == "/" else "open", tag, html[name.end() : stop]
        at = stop + 1
        if after != "/" and tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            stop = close.start() if close else end
            yield "text", "", html[at:stop]
            at = stop


def blocks_of(html: str) -> list[Block]:
    """Blocks of text in page order; markup is repaired as far as blocks need it, in time linear in the page."""
    root = _Element("html", "", None)
    stack, breaking, open_ = [root], [0], Counter()
    out: list[Block] = []
    parts: list[str] = []
    linked = anchors = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                element = stack[breaking[-1]]
                out.append(Block(text, min(linked, len(text)), element, element.tag in HEADINGS))
            parts.clear()
            linked = 0

    def cut(size: int) -> None:
        nonlocal anchors
        for element in stack[size:]:
            open_[element.tag] -= 1
            anchors -= element.tag == "a"
        del stack[size:]
        while breaking[-1] >= size:
            breaking.pop()

    for kind, tag, data in tokens(html):
        if kind == "text":
            if not stack[-1].silent:
                parts.append(data)
                if anchors:
                    linked += len(data.strip())
            continue
        if tag in SPACES:
            parts.append(" ")
        breaks = tag in BREAKS
        if breaks:
            flush()
        if tag in VOID:
            continue
        if kind == "close":
            if open_[tag]:
                size = len(stack) - 1
                while stack[size].tag != tag:
                    size -= 1
                cut(size)
            continue
        top = stack[breaking[-1]].tag
        if top == "head" and tag not in IN_HEAD:
            cut(breaking[-1])
        elif breaks and (top == "p" or top == tag and tag in ("li", "option", "tr", "dt", "dd")):
            cut(breaking[-1])
        if data.endswith("/") and not breaks and tag not in RAW:
            continue
        open_[tag] += 1
        anchors += tag == "a"
        if breaks:
            breaking.append(len(stack))
        stack.append(_Element(tag, data, stack[-1]))
    flush()
    return out


def score(block: Block) -> float:
    """Log-odds that a block is content, from its own text and its region."""
    text, element = block.text, block.element
    s = BIAS + element.against + element.favour + W_LINKS * block.links / len(text)
    s += W_LENGTH * (min(math.log1p(text.count(" ") + 1), LENGTH_MOST) - LENGTH_EVEN)
    if text[-1] in ".!?…\"”'»:。":
        s += W_STOP
    return s + W_HEADING if block.heading else s


def _distance(a: _Element, b: _Element) -> int:
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def ties_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    out = []
    last: dict[int, int] = {}
    for j, block in enumerate(blocks):
        if j:
            out.append((j - 1, j, NEXT + NEAR / (1 + _distance(blocks[j - 1].element, block.element))))
        parent = id(block.element.parent or block.element)
        i = last.get(parent)
        if i is not None and i < j - 1:
            out.append((i, j, SIBLING))
        last[parent] = j
    return out


def _flow(excess: dict[int, float], ties: list[tuple[int, int, float]]) -> set[int]:
    """Nodes on the source side of a minimum cut (Dinic); ``excess`` is the capacity from the source, or to the sink if negative."""
    nodes = {v: k for k, v in enumerate(excess)}
    s, t = len(nodes), len(nodes) + 1
    graph: list[list[int]] = [[] for _ in range(t + 1)]
    to: list[int] = []
    room: list[float] = []

    def edge(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(there)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for v, x in excess.items():
        if x > 0:
            edge(s, nodes[v], x, 0.0)
        elif x < 0:
            edge(nodes[v], t, -x, 0.0)
    for i, j, w in ties:
        edge(nodes[i], nodes[j], w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (t + 1)
        level[s] = 0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            for e in graph[v]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return {v for v, k in nodes.items() if level[k] >= 0}
        at = [0] * (t + 1)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                path, v = [], s
                continue
            while at[v] < len(graph[v]):
                e = graph[v][at[v]]
                if room[e] > tiny and level[to[e]] == level[v] + 1:
                    break
                at[v] += 1
            if at[v] < len(graph[v]):
                path.append(graph[v][at[v]])
                v = to[path[-1]]
            elif path:
                v = to[path.pop() ^ 1]
                at[v] += 1
            else:
                break


def label(scores: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """The cheapest labelling; true is content.

    A block whose score outweighs all its ties has its label in every minimum cut, so it
    is fixed first and its ties are added to its neighbours' scores; the rest goes to max-flow.
    """
    n = len(scores)
    around: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, w in ties:
        around[i].append((j, w))
        around[j].append((i, w))
    excess, slack = list(scores), [sum(w for _, w in a) for a in around]
    fixed: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if fixed[i] is None and abs(excess[i]) > slack[i]:
            fixed[i] = excess[i] > 0
            for j, w in around[i]:
                if fixed[j] is None:
                    excess[j] += w if fixed[i] else -w
                    slack[j] -= w
                    todo.append(j)
    free = {i: excess[i] for i in range(n) if fixed[i] is None}
    if free:
        kept = _flow(free, [(i, j, w) for i, j, w in ties if i in free and j in free])
        for i in free:
            fixed[i] = i in kept
    return [bool(f) for f in fixed]


def extract(html: str | None) -> str:
    """Main text of one page: blocks in page order joined by an empty line; null and empty pages give an empty text."""
    if not html:
        return ""
    blocks = blocks_of(html)
    keep = label([score(b) for b in blocks], ties_of(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_pydict(
            {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null html counts as empty; null ids and urls stay null; repeated rows give repeated
    results; an empty table gives an empty result; other columns are not read. Malformed
    markup is repaired in time linear in the page, however long it is.
    """
    small_batches(pages.sparkSession)
    kind = pages.select("page_id").schema[0].dataType.simpleString()
    narrow = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")
