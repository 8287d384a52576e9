"""Main text of web pages by minimum-cut labelling (operator 8).

A page becomes blocks of text in page order. A logistic classifier judges each block by its tag, words and links; what the elements
around it say is added, and the sum is the capacity of an edge from the source (content) or to the sink (boilerplate).
Neighbouring blocks are tied by edges that weaken with their distance in the DOM, and every block is tied to its parent element
and that to its own, weakly across the borders of sections. The minimum cut, found by maximum flow, labels all blocks at once:
a short line among paragraphs goes with them, a long one in a menu with the menu.

White space inside a block becomes one space; blocks that are content are joined by an empty line. Scripts, styles, comments of the
markup, hidden elements and form controls are never text. Markup that is not closed ends where HTML ends it, or with the page.

The classifier is trained (`trained`) on blocks whose surrounding elements tell what they are: those of articles against those of menus, footers,
sidebars, notices and forms, of at most LEARN_PAGES pages and LEARN_BLOCKS blocks, each class with half of the weight. Its weights have a normal prior around PRIOR, so
that tables with few or no such blocks stay near it. A classifier's word is bounded by BOUNDS, so that it weighs less than plain markup.

Nulls: a null html is empty and gives an empty text; page_id and url pass as they are. Pages without content give an empty text. Repeated rows
give equal rows. An empty table gives an empty result. Extra columns play no part. Each page is one row of an Arrow batch: no page needs another.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_arrow_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never text.
SILENT = frozenset("script style noscript template head title svg math canvas iframe object audio video select option datalist button textarea input label map progress meter dialog".split())
#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
#: Open elements that a start tag closes first, up to the element that bounds them.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
RULES = {"p": ({"p"}, {"button", "table", "object", "td", "th"}), **CLOSES}
RULED = frozenset().union(*(tags | bounds for tags, bounds in RULES.values()))
#: Judgements of elements: above nought for content.
ELEMENT = {"article": 4.0, "main": 4.0, "nav": -8.0, "footer": -8.0, "aside": -8.0, "menu": -6.0, "form": -6.0, "search": -6.0, "header": -6.0, "fieldset": -4.0}
OUTRIGHT = frozenset(("nav", "footer", "aside"))
ROLE = {"main": 4.0, "article": 4.0, "navigation": -8.0, "banner": -6.0, "contentinfo": -8.0, "complementary": -8.0, "search": -6.0, "dialog": -6.0, "alertdialog": -6.0, "alert": -6.0, "menu": -6.0, "menubar": -6.0, "form": -6.0}
#: Words of class and id.
FOR = frozenset("article post entry content story body text main prose".split())
AGAINST = frozenset(
    """ad ads advert adverts advertisement advertisements adsense adbox sponsor sponsored sponsors promo promos promotion sidebar sidebars widget widgets menu menus
    nav navbar navigation breadcrumb breadcrumbs footer header masthead banner banners cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription
    signup login share sharing social related recommended recommendations trending pagination pager toolbar comment comments commentlist respond reply replies disqus copyright disclaimer skip topbar""".split()
)
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
TAG = {"p": 1.0, "pre": 1.0, "blockquote": 1.0, "h1": 1.0, "h2": 0.7, "h3": 0.5, "h4": 0.3, "li": -0.5, "legend": -4.0, "address": -1.0}
#: Weights that the classifier starts from: constant, binary logarithm of 1 + words (6 at most), share of linked text, end of a sentence, then the tags.
PRIOR = np.array([-1.0, 0.5, -4.0, 0.5, *TAG.values()])
SENTENCE_ENDS = ".!?:;…\"'»”)"
#: Inverse variance of the prior; least and most that a classifier says of a block; judgement of the elements from which a block counts as labelled.
PRECISION, BOUNDS, LABELLED = 20.0, (-6.0, 3.0), 2.0
#: Bounds of the sample of labelled blocks.
LEARN_PAGES, LEARN_BLOCKS = 400, 20_000


class Element:
    """An open or closed element. What its ancestors say of it is kept as sums, so that no depth of nesting makes a block dear."""

    __slots__ = ("tag", "parent", "depth", "judged", "silent", "link", "border", "number", "block", "inside", "outright", "nearby", "open")

    def __init__(self, tag: str, parent: Element | None, attributes: dict[str, str | None]):
        self.tag, self.parent, self.number = tag, parent, -1
        self.depth = parent.depth + 1 if parent else 0
        self.link = tag == "a" or bool(parent and parent.link)
        self.silent = tag in SILENT or bool(parent and parent.silent) or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(HIDDEN.search(attributes.get("style") or ""))
        #: the tag of the nearest block element, whether an article holds this element
        self.block = tag if tag in BLOCK or not parent else parent.block
        self.inside = bool(parent and (parent.inside or parent.tag in ("article", "main")))
        self.judged = self._judge(attributes)
        self.border = self.judged != 0.0 or tag == "section"
        self.outright, self.nearby = (parent.outright, parent.nearby) if parent else (0.0, 0.0)
        if self.judged:
            self.nearby *= 0.25
            if tag in OUTRIGHT:
                self.outright += self.judged
            else:
                self.nearby += self.judged
        #: of each rule, the outermost open element that it closes
        self.open: dict[str, Element] = parent.open if parent else {}
        if parent and tag in RULED:
            self.open = {k: v for k, v in self.open.items() if tag not in RULES[k][1]}
            for k, (tags, bounds) in RULES.items():
                if tag in tags and tag not in bounds:
                    self.open.setdefault(k, self)

    def _judge(self, attributes: dict[str, str | None]) -> float:
        if self.tag in ("html", "body"):
            return 0.0
        by_element = ELEMENT.get(self.tag, 0.0) or ROLE.get((attributes.get("role") or "").lower(), 0.0)
        if by_element < 0 and self.tag == "header" and self.inside:
            return -1.0
        if by_element:
            return by_element
        named = f"{attributes.get('class') or ''} {attributes.get('id') or ''}"
        if attributes.get("itemprop") == "articleBody":
            return 4.0
        if named == " ":
            return 0.0
        words = set(WORDS.findall(CAMEL.sub(" ", named).lower()))
        good, bad = bool(words & FOR), bool(words & AGAINST)
        return 0.0 if good == bad else 2.0 if good else -6.0

    def evidence(self) -> float:
        """The elements around: the nearest judgement counts in full, those beyond a quarter of it each; menus, footers and sidebars always."""
        return self.outright + self.nearby


class Block:
    __slots__ = ("element", "text", "linked")

    def __init__(self, element: Element, text: str, linked: float):
        self.element, self.text, self.linked = element, text, linked

    def features(self) -> list[float]:
        words = self.text.count(" ") + 1
        return [1.0, min(6.0, math.log2(1 + words)), self.linked, float(self.text[-1] in SENTENCE_ENDS), *(float(self.element.block == t) for t in TAG)]

    def judge(self, weights: np.ndarray) -> float:
        return min(BOUNDS[1], max(BOUNDS[0], float(weights @ self.features()))) + self.element.evidence()


class Page(HTMLParser):
    """Blocks of a page in order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.at = Element("html", None, {})
        self.opened: Counter[str] = Counter()
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.owner = self.at
        self.feed(html)
        self.close()
        self.flush()

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(self.owner, text, min(1.0, self.linked / len(text))))
            self.parts, self.linked = [], 0

    def leave(self, to: Element) -> None:
        """Close the elements up to one that stays open."""
        while self.at is not to:
            self.opened[self.at.tag] -= 1
            self.at = self.at.parent or to

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
            closed = self.at.open.get("p") or (tag in CLOSES and self.at.open.get(tag)) or None
            if closed:
                self.leave(closed.parent or self.at)
        elif tag == "br":
            self.parts.append(" ")
        if tag not in VOID:
            self.at = Element(tag, self.at, dict(attrs))
            self.opened[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes void elements only

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if self.opened[tag]:
            e = self.at
            while e.parent and e.tag != tag:
                e = e.parent
            self.leave(e.parent or e)

    def handle_data(self, data: str) -> None:
        if self.at.silent or not self.parts and data.isspace():
            return
        if not self.parts:
            self.owner = self.at
        self.parts.append(data)
        if self.at.link:
            self.linked += len(data)


def least_cut(terminals: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut. terminals: capacity from the source, or below nought to the sink."""
    n = len(terminals)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for k, c in enumerate(terminals):
        if c > 0:
            add(source, k, c, 0)
        elif c < 0:
            add(k, sink, -c, 0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:  # a blocking flow along the levels
            if a == sink:
                pushed = min(room[e] for e in path)
                for e in path:
                    room[e] -= pushed
                    room[e ^ 1] += pushed
                cut = next(k for k, e in enumerate(path) if not room[e])
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            edges_out = out[a]
            while turn[a] < len(edges_out) and not (room[edges_out[turn[a]]] and level[to[edges_out[turn[a]]]] == level[a] + 1):
                turn[a] += 1
            if turn[a] < len(edges_out):
                path.append(edges_out[turn[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                back = path.pop()
                a = to[back ^ 1]
                turn[a] += 1


def _distance(a: Element, b: Element) -> float:
    """How closely two blocks are tied: by the steps to their common ancestor, less for each border on the way."""
    steps, borders = 0, 0
    while a is not b:
        if a.depth >= b.depth and a.parent:
            steps, borders, a = steps + 1, borders + a.border, a.parent
        elif b.parent:
            steps, borders, b = steps + 1, borders + b.border, b.parent
    return 1.5 / (1 + steps / 2) * 0.1**borders


def fitted(features: np.ndarray, content: np.ndarray) -> np.ndarray:
    """The most likely weights under the prior, by Newton's method; PRIOR itself where a class has no rows."""
    weights = PRIOR.copy()
    if content.all() or not content.any():
        return weights
    share = np.where(content, 0.5 / content.sum(), 0.5 / (~content).sum()) * len(content)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        slope = features.T @ (share * (content - p)) - PRECISION * (weights - PRIOR)
        curve = (features * (share * p * (1 - p))[:, None]).T @ features + PRECISION * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights += step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return weights


def trained(pages: DataFrame, learn_pages: int = LEARN_PAGES, learn_blocks: int = LEARN_BLOCKS) -> np.ndarray:
    """Weights of the classifier from a bounded sample of labelled blocks: pages with the smallest hashes of page_id and url, of each an even spread of its blocks.

    Only hashes and features of the sample reach the driver. Pages that share a hash may exceed learn_pages; learn_blocks bounds them too."""
    each = max(1, learn_blocks // learn_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, rows = [], []
            for h, html in zip(batch.column("h").to_pylist(), batch.column("html").to_pylist(), strict=True):
                blocks = [b for b in Page(html or "").blocks if abs(b.element.evidence()) >= LABELLED]
                for k in range(min(each, len(blocks))):
                    b = blocks[k * len(blocks) // min(each, len(blocks))]
                    hashes.append(h)
                    rows.append([float(b.element.evidence() > 0), *b.features()])
            yield pa.record_batch([pa.array(hashes, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["h", "row"])

    keyed = pages.select(F.xxhash64("page_id", "url").alias("h"), "html")
    smallest = keyed.select("h").distinct().orderBy("h").limit(learn_pages).agg(F.max("h")).first()[0]
    if smallest is None:
        return PRIOR.copy()
    sample = keyed.where(F.col("h") <= smallest).mapInArrow(run, "h long, row array<double>").orderBy("h", "row").limit(learn_blocks)
    rows = np.array([x.row for x in sample.collect()]).reshape(-1, 1 + len(PRIOR))
    return fitted(rows[:, 1:], rows[:, 0] > 0)


def main_text(html: str | None, weights: np.ndarray = PRIOR) -> str:
    """The content blocks of a page, joined by empty lines."""
    blocks = Page(html or "").blocks
    if not blocks:
        return ""
    terminals = [round(100 * b.judge(weights)) for b in blocks]
    edges = [(k, k + 1, round(100 * _distance(blocks[k].element, blocks[k + 1].element))) for k in range(len(blocks) - 1)]
    for k, b in enumerate(blocks):
        node, weight, e = k, 100.0, b.element
        while e and e.parent:
            if e.border:
                weight *= 0.1
            parent = e.parent
            new = parent.number < 0
            if new:
                parent.number = len(terminals)
                terminals.append(0)
            if round(weight):
                edges.append((node, parent.number, round(weight)))
            if not new:
                break
            node, weight, e = parent.number, weight / 2, parent
    content = least_cut(terminals, [x for x in edges if x[2]])
    return "\n\n".join(b.text for b, keep in zip(blocks, content, strict=False) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, weights) for x in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    small_arrow_batches(pages.sparkSession)
    weights = trained(pages)
    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")
