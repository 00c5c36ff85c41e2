"""Main text of web pages by minimum cut.

A page becomes blocks of text with the elements around them. A linear classifier over tags,
names of classes, link density, length and punctuation gives each block log odds of being
content; they are the capacities to the two terminals. Neighbours in page order and neighbours
among the children of one element are joined by smoothness edges. Blocks of equal sign that
follow one another in the same element are one node. The minimum cut is the labelling of
least cost: blocks on the source's side are content.

The weights are fixed values below; the pages carry no labels to learn them from.

Nulls: a null html is empty and gives an empty text; url and page_id are kept as they are.
Pages are read whole. Markup may be unclosed, wrongly nested or cut off anywhere. Repeated
rows give repeated rows.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, deque
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import store
from .bpe import map_texts

#: Kinds of elements, and words in class, id or role that mark boilerplate and content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head title script style noscript template svg math iframe object textarea select option button datalist canvas audio video map".split())
RAW = frozenset("script style textarea title template noscript iframe svg math".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var".split())
OUTSIDE = frozenset("nav aside footer form menu dialog fieldset".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that the start of another one closes if they are open around it with nothing but inline elements between.
CLOSES = {t: frozenset(c.split()) for t, c in {"p": "p", "li": "li p", "dt": "dt dd p", "dd": "dt dd p", "td": "td th p", "th": "td th p", "tr": "td th tr p", "option": "option"}.items()}
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|overlay|nav\w*|menu|breadcrumbs?|sidebar|side|widget|footer|foot|copyright|comments?|comment-?\w*|disqus|replies|reply"
    r"|respond|discussion|share|sharing|social|related|recommend\w*|newsletter|subscri\w+|signup|login|search|pagination|pager|tags?|meta|byline|masthead|toolbar|skip|complementary|navigation|contentinfo|site-?header|page-?header|topbar)(?:$|[\s_-])|(?:^|\s)(?:is-|visually-)?hidden(?:$|\s)",
    re.I,
)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article\w*|content|post|entry|story|body|main|text|prose)(?:$|[\s_-])", re.I)
HIDDEN_STYLE = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
#: Elements that a head may hold; any other start tag, and text, ends a head that is open.
IN_HEAD = frozenset("base link meta title style script noscript template head html".split())
#: Weights of the classifier.
BIAS, PER_WORD, FULL_WORDS, SENTENCE, LINKS = -0.3, 0.05, 40, 0.7, -4.0
IN_MAIN, IN_OUTSIDE, IN_HEADER, NAMED_BOILERPLATE, NAMED_CONTENT = 2.0, -6.0, -3.0, -6.0, 1.2
HEADING, ITEM, RIGHTS = 0.8, -0.4, -2.0
#: Capacities of the edges between neighbours: in one element, elsewhere, and among children.
NEAR, APART, SIBLINGS = 1.0, 0.25, 0.6
#: Capacities below this are rounding.
LEAST_FLOW = 1e-9

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z", re.S)
RAW_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass(slots=True)
class Element:
    tag: str
    number: int
    parent: int
    score: float
    silent: bool
    outside: bool
    main: bool
    #: Depth of the element itself or, if it is inline, of the block that it is in.
    block: int = 0


@dataclass(slots=True)
class Block:
    text: str
    parent: int
    score: float


def _element(tag: str, attributes: str, number: int, up: Element) -> Element:
    score, silent, outside, main = up.score, up.silent or tag in SILENT, up.outside, up.main
    if tag in OUTSIDE:
        score, outside = score + IN_OUTSIDE, True
    elif tag == "header" and not main:
        score += IN_HEADER
    elif tag in MAIN and not main:
        main = True
        if not outside:
            score += IN_MAIN
    if attributes and tag not in ("html", "body"):
        own: dict[str, str] = {}
        for name, x, y, z in ATTRIBUTE.findall(attributes):
            own.setdefault(name.lower(), x or y or z)
        names = " ".join(own[n] for n in ("class", "id", "role") if own.get(n))
        if names:
            if BOILERPLATE.search(names):
                score, outside = score + NAMED_BOILERPLATE, True
            elif CONTENT.search(names) and not outside:
                score += NAMED_CONTENT
        if own.get("hidden", "false").lower() != "false" or own.get("aria-hidden", "").lower() == "true" or HIDDEN_STYLE.search(own.get("style", "")):
            silent = True
    return Element(tag, number, up.number, score, silent, outside, main)


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, with their element and log odds, in time linear in the page."""
    root = Element("", 0, -1, BIAS, False, False, False)
    stack, number = [root], 0
    is_open: Counter[str] = Counter()
    out: list[Block] = []
    parts: list[str] = []
    linked = 0

    def close_text() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            parts.clear()
            text = " ".join((html_lib.unescape(raw) if "&" in raw else raw).split())
            if text:
                own = stack[stack[-1].block]
                words = text.count(" ") + 1
                score = own.score + PER_WORD * min(words, FULL_WORDS) + LINKS * min(1.0, linked / len(text))
                if text[-1] in ".!?…:;\"”»)":
                    score += SENTENCE
                if own.tag in HEADINGS:
                    score += HEADING
                elif own.tag == "li":
                    score += ITEM
                if "©" in text or text.lower().startswith("copyright"):
                    score += RIGHTS
                out.append(Block(text, own.parent if own.tag not in ("", "body", "div", "section", "article", "main") else own.number, score))
        linked = 0

    def close_elements(depth: int) -> None:
        is_open.subtract(e.tag for e in stack[depth:])
        del stack[depth:]

    def depth_of(tag: str, within: int) -> int:
        """Of the innermost open ``tag`` at depth ``within`` or deeper; 0 if there is none."""
        return next((k for k in range(len(stack) - 1, within - 1, -1) if stack[k].tag == tag), 0) if is_open[tag] else 0

    at, size = 0, len(page)
    in_link = 0
    while at < size:
        m = TAG.search(page, at)
        end = m.start() if m else size
        if end > at and stack[-1].tag == "head" and not page[at:end].isspace():
            close_elements(len(stack) - 1)
        if end > at and not stack[-1].silent:
            piece = page[at:end]
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "a":
            in_link = 0 if closing else 1
        if tag not in INLINE:
            close_text()
        if tag in VOID:
            continue
        if closing:
            # an inline end tag closes nothing beyond its block
            depth = depth_of(tag, stack[-1].block + 1 if tag in INLINE else 1)
            if depth:
                close_elements(depth)
            continue
        if tag not in IN_HEAD and is_open["head"]:
            close_elements(depth_of("head", 1))
        if tag in CLOSES:
            depth, k = 0, stack[-1].block
            while k and stack[k].tag in CLOSES[tag]:
                depth, k = k, stack[k - 1].block
            if depth:
                close_elements(depth)
        elif tag not in INLINE and stack[-1].tag == "p":
            close_elements(len(stack) - 1)
        if attributes.endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            stop = RAW_ENDS[tag].search(page, at)
            at = stop.end() if stop else size
            continue
        number += 1
        element = _element(tag, attributes, number, stack[-1])
        element.block = stack[-1].block if tag in INLINE else len(stack)
        stack.append(element)
        is_open[tag] += 1
    close_text()
    return out


def min_cut(gain: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of least cost: a node on the false side loses its positive gain, one on the true side pays its negative one, a cut edge its capacity.

    Maximum flow, one source node after the other: what a node has to give goes by shortest paths to the nearest nodes that still
    take something. If it can't all go, whatever it reaches is closed: no path to a sink will ever lead through there, so it is
    never searched again, and at the end the closed nodes are the source's side. A search stays near its start.
    """
    near: list[dict[int, float]] = [{} for _ in gain]
    for (i, j), c in edges.items():
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    takes = [-g if g < 0 else 0.0 for g in gain]
    closed = [False] * len(gain)
    for source, gives in enumerate(gain):
        while gives > LEAST_FLOW and not closed[source]:
            back = {source: source}
            todo = deque([source])
            sink = -1
            while todo:
                i = todo.popleft()
                if takes[i] > LEAST_FLOW:
                    sink = i
                    break
                for j, c in near[i].items():
                    if c > LEAST_FLOW and j not in back and not closed[j]:
                        back[j] = i
                        todo.append(j)
            if sink < 0:
                for i in back:
                    closed[i] = True
                break
            path = [sink]
            while path[-1] != source:
                path.append(back[path[-1]])
            steps = list(zip(path[1:], path))
            flow = min([gives, takes[sink], *(near[i][j] for i, j in steps)])
            gives -= flow
            takes[sink] -= flow
            for i, j in steps:
                near[i][j] -= flow
                near[j][i] += flow
    return closed


def main_text(page: str | None) -> str:
    """Blocks of content, one a line."""
    blocks = blocks_of(page or "")
    node, gain, parents = [], [], []
    for b in blocks:
        if not parents or parents[-1] != b.parent or (gain[-1] > 0) != (b.score > 0):
            parents.append(b.parent)
            gain.append(0.0)
        gain[-1] += b.score
        node.append(len(gain) - 1)
    edges: dict[tuple[int, int], float] = {}
    seen: dict[int, int] = {}
    for i, p in enumerate(parents):
        if i:
            edges[i - 1, i] = NEAR if parents[i - 1] == p else APART
        if p in seen and seen[p] != i - 1:
            edges[seen[p], i] = edges.get((seen[p], i), 0.0) + SIBLINGS
        seen[p] = i
    content = min_cut(gain, edges)
    return "\n".join(b.text for b, k in zip(blocks, node, strict=True) if content[k])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text and n_chars in place of ``html``; a column called text or n_chars gives way."""
    kept = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def work(batch: pa.RecordBatch) -> dict[str, Any]:
        texts = [main_text(p) for p in batch.column(html).to_pylist()]
        return {f.name: batch.column(f.name) for f in kept} | {"text": texts, "n_chars": [len(t) for t in texts]}

    return map_texts(pages.select(*(f.name for f in kept), html), html, schema, work)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(store.table(spark, sf_dir, "pages", "page_id", "url", "html"))
