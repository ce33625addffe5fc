"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A linear classifier over what is known of a
block (its text, its links, the names of the elements around it) gives the cost
of calling it content or boilerplate: the capacities to the two terminals. Edges
between neighbours and between blocks under one element make the labelling
smooth. The minimum cut is the labelling of least cost.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from textlode.llm._common import tidy

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style head title template noscript iframe object svg math canvas select option button textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_ITSELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())

# words of class, id and role names: never content; content or not, as the rest has it; content
BAD_NAMES = re.compile(r"ads?|adv|advert\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|newsletter\w*|subscri\w*|comments?|commentlist|replies|reply|respond|disqus|sidebar\w*|nav|navbar\w*|navigation|menu\w*|footer\w*|masthead|topbar|breadcrumbs?|sharing|share|social\w*|related|recommend\w*|widget\w*|login|signup|popup|modal|overlay|pagination|pager|toolbar|contentinfo|complementary|notices?|notification\w*|alert\w*|banner\w*|header|hidden")
OPEN_NAMES = re.compile(r"side|foot|head|tags?|search\w*|discussion|disclaimer|copyright|nav\w+")
GOOD_NAMES = re.compile(r"article\w*|content|main|post|entry|story|body|text")
HEADING = re.compile(r"h[1-6]")
HEAD_PARTS = frozenset("title meta link script style base noscript template".split())


@dataclass
class _Element:
    """An open element; what is said of it holds for all that is in it."""

    tag: str
    around: _Element | None = None  # nearest element that makes blocks, itself included
    parent: _Element | None = None  # of those, the next outer one
    depth: int = 0
    weight: float = 0.0  # for content, summed from the outside
    barred: bool = False  # in a part that is never content
    skipped: bool = False
    article: bool = False
    heading: bool = False
    link: bool = False
    foreign: bool = False


@dataclass
class Block:
    text: str
    element: _Element
    link_chars: int = 0


_OUTSIDE = _Element("")
_OUTSIDE.around = _OUTSIDE


@dataclass
class _Parser(HTMLParser):
    blocks: list[Block] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Element] = []
        self.counts: Counter[str] = Counter()
        self.parts: list[str] = []
        self.link_chars, self.at = 0, None

    def _top(self) -> _Element:
        return self.open[-1] if self.open else _OUTSIDE

    def _cut(self, k: int) -> None:
        self.counts.subtract(e.tag for e in self.open[k:])
        del self.open[k:]

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.at or self._top(), min(len(text), self.link_chars)))
        self.parts, self.link_chars, self.at = [], 0, None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag not in INLINE:
            self._flush()
            self._close_implied(tag)
        if tag in VOID:
            return
        outer, own = self._top(), dict(attrs)
        weight, barred = self._names(tag, own, outer.article)
        found = _Element(
            tag,
            weight=outer.weight + weight,
            barred=outer.barred or barred,
            skipped=outer.skipped or tag in SKIPPED or self._hidden(own),
            article=outer.article or tag in ("article", "main"),
            heading=outer.heading or bool(HEADING.fullmatch(tag)),
            link=outer.link or tag == "a",
            foreign=outer.foreign or tag in ("svg", "math"),
        )
        if tag in INLINE:
            found.around = outer.around
        else:
            found.around, found.parent, found.depth = found, outer.around, outer.around.depth + 1
        self.open.append(found)
        self.counts[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        """``<div/>`` opens an element, but drawings and what is skipped have nothing in them when written so."""
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and (self.open[-1].foreign or tag in SKIPPED):
            self._cut(len(self.open) - 1)

    @staticmethod
    def _hidden(attrs: dict[str, str | None]) -> bool:
        style = (attrs.get("style") or "").replace(" ", "").lower()
        return "hidden" in attrs or "display:none" in style or "visibility:hidden" in style

    @staticmethod
    def _names(tag: str, attrs: dict[str, str | None], inside: bool) -> tuple[float, bool]:
        """(weight for content, whether nothing in it is content) by the element's own names."""
        if tag in ("html", "body"):
            return 0.0, False
        if tag in BOILERPLATE or (tag == "header" and not inside):
            return 0.0, True
        if tag in ("article", "main"):
            return 4.0, False
        whole = [x for k in ("class", "id", "role") for x in (attrs.get(k) or "").lower().split()]
        parts = [x for w in whole for x in re.split(r"[^a-z0-9]+", w) if x]
        good = any(GOOD_NAMES.fullmatch(w) for w in whole)
        bad = any(BAD_NAMES.fullmatch(x) for x in parts) and not (inside and (HEADING.fullmatch(tag) or tag == "header"))
        # a name that stands alone says more than a part of a longer one
        if bad and not good:
            return 0.0, True
        unsure = bad or not good and any(OPEN_NAMES.fullmatch(x) for x in parts)
        return 1.5 * any(GOOD_NAMES.fullmatch(x) for x in parts) - 3.0 * unsure, False

    def _close_implied(self, tag: str) -> None:
        """A block-level element ends an open paragraph; an item ends the item before it; the body, and what cannot be in a head, ends the head."""
        if self.counts["head"] and (tag == "body" or self.open[-1].tag == "head" and tag not in HEAD_PARTS):
            self._cut(next(k for k, e in enumerate(self.open) if e.tag == "head"))
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k].tag
            if name == "p" or name == tag and tag in ENDS_ITSELF:
                self._cut(k)
                return
            if name not in INLINE and (name not in ENDS_ITSELF or name in ENDS_ITSELF.get(tag, ())):
                return

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        if not self.counts[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                self._cut(k)
                return
            if tag in INLINE and self.open[k].tag not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        some = not data.isspace()
        if some and self.open and self.open[-1].tag == "head":
            self._cut(len(self.open) - 1)
        top = self._top()
        if top.skipped:
            return
        if some and self.at is None:
            self.at = top
        self.parts.append(data)
        if top.link:
            self.link_chars += len(data.strip())


def parse(html: str) -> tuple[list[Block], bool]:
    """The blocks of a page in order, and whether it has an article element with text of its own."""
    parser = _Parser()
    parser.feed(html)
    parser.close()
    parser._flush()
    return parser.blocks, any(b.element.article and not b.element.barred for b in parser.blocks)


def evidence(block: Block, has_article: bool) -> float:
    """Log-odds that a block is content: the classifier, linear in what is known of it."""
    n, element = len(block.text), block.element
    words = block.text.count(" ") + 1
    ends = block.text.rstrip("\"'»”’)").endswith((".", "!", "?", ":", "…"))
    score = (-1.2 if has_article else -0.2) + 0.5 * math.log1p(words) + 0.8 * ends + 1.2 * element.heading - 4.0 * block.link_chars / n
    if re.match(r"(©|\(c\)\s|copyright\b)", block.text, re.I):
        score -= 4.0
    if element.barred:
        return score - 8.0
    return score + element.weight - (2.5 if has_article and not element.article else 0.0)


def steps(a: _Element, b: _Element) -> int:
    """Elements between two places of a page. What lies between blocks in order was opened or closed there, so all steps of a page are linear in its size."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent or _OUTSIDE
        else:
            b = b.parent or _OUTSIDE
        n += 1
    return n


class MaxFlow:
    """Dinic's algorithm on residual arrays."""

    def __init__(self, n: int):
        self.head: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def edge(self, a: int, b: int, room: float, back: float = 0.0) -> None:
        self.head[a].append(len(self.to))
        self.to.append(b)
        self.room.append(room)
        self.head[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.head)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in self.head[a]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def cut(self, source: int, sink: int) -> list[bool]:
        """Saturate the flow; True for nodes on the source's side."""
        while (level := self.levels(source))[sink] >= 0:
            nexts = [0] * len(self.head)
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    most = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= most
                        self.room[e ^ 1] += most
                    full = next(k for k, e in enumerate(path) if self.room[e] <= 1e-9)
                    del path[full + 1 :]
                    a = self.to[path.pop() ^ 1]
                    continue
                while nexts[a] < len(self.head[a]):
                    e = self.head[a][nexts[a]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[a] + 1:
                        break
                    nexts[a] += 1
                if nexts[a] < len(self.head[a]):
                    path.append(self.head[a][nexts[a]])
                    a = self.to[path[-1]]
                elif path:
                    nexts[self.to[path[-1] ^ 1]] += 1
                    a = self.to[path.pop() ^ 1]
                else:
                    break
        return [x >= 0 for x in self.levels(source)]


def label(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: the evidence given up plus the weights of edges that are cut.

    A block whose evidence outweighs all its edges keeps its own label in any
    minimum cut; it becomes part of a terminal, and only the others flow.
    """
    n = len(scores)
    pull = [0.0] * n
    for a, b, w in edges:
        pull[a] += w
        pull[b] += w
    fixed = [abs(s) > p for s, p in zip(scores, pull, strict=True)]
    flow, source, sink = MaxFlow(n + 2), n, n + 1
    for a, b, w in edges:
        if fixed[a] and fixed[b]:
            continue
        if fixed[a] or fixed[b]:
            known, other = (a, b) if fixed[a] else (b, a)
            flow.edge(source, other, w) if scores[known] > 0 else flow.edge(other, sink, w)
        else:
            flow.edge(a, b, w, w)
    for i in range(n):
        if not fixed[i]:
            flow.edge(source, i, scores[i]) if scores[i] > 0 else flow.edge(i, sink, -scores[i])
    if all(fixed):
        return [s > 0 for s in scores]
    side = flow.cut(source, sink)
    return [scores[i] > 0 if fixed[i] else side[i] for i in range(n)]


def links(blocks: list[Block], smooth: float) -> list[tuple[int, int, float]]:
    """Edges of neighbours, the heavier the nearer they are in the page's tree, and of blocks under one element that others part."""
    edges = []
    last_under: dict[int, int] = {}
    for i, block in enumerate(blocks):
        here = block.element.around
        if i:
            edges.append((i - 1, i, smooth / max(1, steps(blocks[i - 1].element.around, here) - 1)))
        under = id(here.parent)
        if (j := last_under.get(under, i)) < i - 1:
            edges.append((j, i, smooth / 2))
        last_under[under] = i
    return edges


def main_text(html: str, smooth: float = 1.5) -> str:
    """The blocks labelled as content, joined by an empty line."""
    blocks, has_article = parse(html)
    labels = label([evidence(b, has_article) for b in blocks], links(blocks, smooth))
    return "\n\n".join(b.text for b, good in zip(blocks, labels, strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """Return (page_id, url, text, n_chars long): a row per row of ``pages``.

    A null or empty html gives an empty text, an empty table no rows. Null and
    repeated ids and urls are carried as they are; other columns are ignored.
    Labels that cost the same are told apart by the cut, the same in every run.
    Very long and very deep pages take time in line with their size, but for
    cuts among very many doubtful blocks in a row.
    """
    kinds = dict(pages.dtypes)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
