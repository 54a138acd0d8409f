"""Main text of web pages by minimum-cut labelling of their text blocks."""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small, texts_of

#: Fixed values of HTML: elements whose content is raw or never shown, elements without content, and elements that
#: begin and end a block of text.
SKIPPED = frozenset("script style template noscript iframe noembed noframes object svg math canvas audio video title head".split())
RAW = frozenset("script style iframe noembed noframes noscript title textarea xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "textarea tfoot th thead tr ul".split()
)
#: A start tag on the left closes an open element on the right, up to a scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("table ul ol dl select article aside nav header footer main section form body".split())
#: Evidence that an element's text is, or is not, the page's main text.
AGAINST = frozenset("nav footer aside form button select textarea dialog menu fieldset search label legend".split())
AGAINST_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
COMMENT_NAMES = frozenset("comment comments disqus reply replies respond".split())
AGAINST_NAMES = COMMENT_NAMES | frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline consent cookie cookies disclaimer "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo "
    "recommend recommended related search share sharing sidebar signup social sponsor sponsored subscribe subscription tags "
    "toolbar widget".split()
)
FOR = frozenset("article main".split())
FOR_NAMES = frozenset("article articlebody content entry main maincontent post postbody story text".split())
#: What an element says about the text in it. Names are the weakest, since a page's outermost wrapper may carry them.
NONE, MAIN, PARTS, NAMED, COMMENTS = range(5)
#: A wrapper around so much of a page's text is no part beside its main text.
WRAPS, WRAPS_COMMENTS = 0.6, 0.95

_START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


@dataclass
class Block:
    """A run of text between block boundaries: its text, share of link text, the element it stands in, and what that says."""

    text: str
    linked: float
    element: int
    evidence: int = NONE


@dataclass
class Page:
    """The blocks of a page in order, and for each element its parent; element 0 is the page, parents come first."""

    blocks: list[Block]
    parents: list[int]


@dataclass
class _Open:
    tag: str
    number: int
    inside: bool
    link: bool


def tags_of(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(begin, end, whether it closes, name, attributes) of every tag; comments and declarations have no name.

    One pass: nothing is looked at again. A tag whose quotes never end, ends at the next ``>``, and so do all later ones.
    """
    at, quotes = 0, True
    while (begin := page.find("<", at)) >= 0:
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = len(page) if end < 0 else end + 3
            yield begin, at, False, "", ""
        elif start := _START.match(page, begin):
            rest = _REST.match(page, start.end()) if quotes else None
            if rest is None:
                quotes = False
                end = page.find(">", start.end())
                if end < 0:
                    yield begin, len(page), False, "", ""
                    return
                at = end + 1
            else:
                at = rest.end()
            yield begin, at, bool(start[1]), start[2].lower(), page[start.end() : at - 1]
        elif page[begin + 1 : begin + 2] in ("!", "?", "/"):
            end = page.find(">", begin)
            at = len(page) if end < 0 else end + 1
            yield begin, at, False, "", ""
        else:
            at = begin + 1


def _said(tag: str, attributes: str, inside: bool) -> int:
    """What an element's tag, role and names say about its text; a header inside an article is a part of it."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    names = {x.lower() for x in _NAME.findall(html.unescape(f"{found.get('class', '')} {found.get('id', '')}"))}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return PARTS
    if names & COMMENT_NAMES and tag not in ("html", "body"):
        return COMMENTS
    if tag in FOR or found.get("role", "").lower() in FOR:
        return MAIN
    if tag in ("html", "body"):
        return NONE
    if tag in AGAINST or (tag == "header" and not inside) or found.get("role", "").lower() in AGAINST_ROLES:
        return PARTS
    against = names & (AGAINST_NAMES - {"header", "byline", "tags"} if inside else AGAINST_NAMES)
    if names & FOR_NAMES:
        return NONE if against else MAIN
    return NAMED if against else NONE


def _settle(blocks: list[Block], parents: list[int], said: list[int]) -> None:
    """Gives every block what its elements say: the nearest word for main text, unless one around it speaks against.

    What speaks against holds for all below, but not for a wrapper: an element around the page's main element, or, if no
    element is marked as such, around most of its text.
    """
    n = len(parents)
    mass = [0.0] * n
    for block in blocks:
        mass[block.element] += len(block.text) * (1 - block.linked)
    for e in range(n - 1, 0, -1):
        mass[parents[e]] += mass[e]
    # Below a part or a comment, an element marked as main text is a teaser or an answer, if there is another one.
    below = [False] * n
    for e in range(1, n):
        below[e] = below[parents[e]] or said[parents[e]] in (PARTS, COMMENTS)
    marked = [e for e in range(n) if said[e] == MAIN]
    wraps = [False] * n
    if marked:
        # Among elements of the same text the inner one is the main one.
        at = max(marked, key=lambda e: (not below[e], mass[e], e))
        while at:
            wraps[at] = True
            at = parents[at]
    else:
        total = max(mass[0], 1.0)
        wraps = [m >= total * (WRAPS_COMMENTS if s == COMMENTS else WRAPS) for m, s in zip(mass, said, strict=True)]
    states = [NONE] * n
    for e in range(1, n):
        above = states[parents[e]]
        own = NONE if wraps[e] and said[e] != MAIN else said[e]
        states[e] = above if above >= PARTS or own == NONE else own
    for block in blocks:
        block.evidence = states[block.element]


def page_of(page: str) -> Page:
    """The text blocks of a page in order; tags need not be closed or well nested. The work is in proportion to the page."""
    stack = [_Open("", 0, False, False)]
    blocks: list[Block] = []
    parents, said = [0], [NONE]
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = shown = 0
    skipped = 0

    def flush() -> None:
        nonlocal parts, linked, shown
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, linked / max(1, shown), stack[-1].number))
            parts, linked, shown = [], 0, 0

    def add(text: str) -> None:
        nonlocal linked, shown
        if text and not skipped:
            parts.append(text)
            size = len(text)
            shown += size
            if stack[-1].link:
                linked += size

    def push(name: str, attributes: str, link: bool) -> None:
        nonlocal skipped
        above = stack[-1]
        parents.append(above.number)
        said.append(_said(name, attributes, above.inside))
        inside = above.inside or said[-1] == MAIN
        stack.append(_Open(name, len(parents) - 1, inside, link))
        opened[name] = opened.get(name, 0) + 1
        skipped += name in SKIPPED

    def close(depth: int) -> None:
        nonlocal skipped
        for x in stack[depth:]:
            skipped -= x.tag in SKIPPED
            opened[x.tag] -= 1
        del stack[depth:]

    at = 0
    raw_until = 0
    for begin, end, closes, name, attributes in tags_of(page):
        if begin < raw_until:
            continue
        add(page[at:begin])
        at = end
        if not name:
            continue
        if name == "br":
            add("\n")
            continue
        if name in BLOCK:
            flush()
        if closes:
            if opened.get(name):
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == name))
            continue
        if name in VOID:
            continue
        if name in BLOCK and stack[-1].tag == "p":
            close(len(stack) - 1)
        if any(opened.get(x) for x in CLOSES.get(name, ())):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[name]:
                    close(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        if name == "body" and skipped:
            # The head ends here, closed or not.
            close(next(k for k in range(1, len(stack)) if stack[k].tag in SKIPPED))
        if name in RAW:
            # Raw content lasts up to its own end tag, whatever stands in it.
            found = _ENDS[name].search(page, at)
            if name not in SKIPPED:
                push(name, attributes, False)
                add(page[at : found.start() if found else len(page)])
                flush()
                close(len(stack) - 1)
            at = raw_until = found.end() if found else len(page)
            continue
        if attributes.rstrip().endswith("/") and name in ("svg", "math"):
            continue
        push(name, attributes, stack[-1].link or name == "a")
    if at < len(page):
        add(page[at:])
    flush()
    _settle(blocks, parents, said)
    return Page(blocks, parents)


_ENDS = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}


def features(blocks: list[Block]) -> np.ndarray:
    """What the text classifier sees of each block: length, links, sentence ends, words, and the neighbours' length."""
    rows = np.zeros((len(blocks), 7))
    for k, block in enumerate(blocks):
        text = block.text
        size = len(text)
        words = text.count(" ") + 1
        rows[k, :6] = (1.0, math.log1p(size), block.linked, (text.count(". ") + text.endswith((".", "!", "?", "…"))) / words, size / words / 10, math.log1p(words))
    if len(blocks) > 1:
        rows[1:, 6] += rows[:-1, 1] / 2
        rows[:-1, 6] += rows[1:, 1] / 2
    return rows


@dataclass(frozen=True)
class BlockClassifier:
    """Logistic regression on ``features``, and how much structure, text and smoothness count in the cut.

    No word of a page's markup outweighs the text and the neighbours of a block together.
    """

    weights: tuple[float, ...] = (0.0,) * 7
    main: float = 3.0
    parts: float = 4.6
    named: float = 4.2
    outside: float = -2.0
    text: float = 1.5
    adjacency: float = 1.2
    proximity: float = 1.2
    mean: tuple[float, ...] = field(default=(0.0,) * 7)
    scale: tuple[float, ...] = field(default=(1.0,) * 7)

    def scores(self, blocks: list[Block]) -> list[float]:
        """Log odds that each block is main text; what text alone says is bounded by ``text``."""
        usual = ((features(blocks) - np.array(self.mean)) / np.array(self.scale)) @ np.array(self.weights)
        usual = self.text * np.tanh(usual / self.text)
        # Where a page marks its main text, unmarked blocks are less likely to be part of it.
        plain = self.outside if any(b.evidence == MAIN for b in blocks) else 0.0
        words = {NONE: plain, MAIN: self.main, PARTS: -self.parts, NAMED: -self.named, COMMENTS: -self.parts}
        return [u + words[b.evidence] for u, b in zip(usual.tolist(), blocks, strict=True)]


def edges_of(page: Page, model: BlockClassifier) -> list[tuple[int, int, float]]:
    """Smoothness edges: between neighbours, weaker the more containers lie between them, and between siblings."""
    parents = page.parents
    edges = []
    last: dict[int, int] = {}
    for k, block in enumerate(page.blocks):
        if k:
            # Up from both to where they meet: the higher number is never above the lower one.
            a, b, between = page.blocks[k - 1].element, block.element, 0
            while a != b:
                if a > b:
                    a = parents[a]
                else:
                    b = parents[b]
                between += 1
            edges.append((k - 1, k, model.adjacency / (1 + between)))
        holder = parents[block.element]
        if holder in last:
            edges.append((last[holder], k, model.proximity))
        last[holder] = k
    return edges


def minimum_cut(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling of least cost: which blocks are on the source's (content) side.

    ``gains`` are terminal capacities: above zero what labelling a block boilerplate costs, below zero what labelling
    it content costs. An edge costs its weight if its ends differ. Flow is pushed along shortest paths from blocks with
    spare source capacity to blocks with spare sink capacity until none is left; what the spare source capacity still
    reaches is content.
    """
    n = len(gains)
    spare = list(gains)
    around: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, weight in edges:
        around[a].append(len(to))
        to.append(b)
        room.append(weight)
        around[b].append(len(to))
        to.append(a)
        room.append(weight)
    tiny = 1e-9
    while True:
        came: list[int] = [-2] * n
        queue = deque(k for k in range(n) if spare[k] > tiny)
        for k in queue:
            came[k] = -1
        sinks = []
        while queue:
            k = queue.popleft()
            if spare[k] < -tiny:
                sinks.append(k)
                continue
            for e in around[k]:
                if room[e] > tiny and came[to[e]] == -2:
                    came[to[e]] = e
                    queue.append(to[e])
        if not sinks:
            return [c != -2 for c in came]
        # All sinks of this search tree are served in turn, as far as their paths still have room.
        for sink in sinks:
            k, flow = sink, -spare[sink]
            while came[k] >= 0:
                flow = min(flow, room[came[k]])
                k = to[came[k] ^ 1]
            flow = min(flow, spare[k])
            if flow <= 0:
                continue
            spare[k] -= flow
            spare[sink] += flow
            k = sink
            while came[k] >= 0:
                room[came[k]] -= flow
                room[came[k] ^ 1] += flow
                k = to[came[k] ^ 1]


def main_text(page: str, model: BlockClassifier) -> str:
    """The blocks on the content side of the cut, joined by an empty line."""
    found = page_of(page)
    if not found.blocks:
        return ""
    kept = minimum_cut(model.scores(found.blocks), edges_of(found, model))
    return "\n\n".join(b.text for b, k in zip(found.blocks, kept, strict=True) if k)


def train(pages: DataFrame, key: str = "page_id", page: str = "html", sample: int = 300) -> BlockClassifier:
    """A text classifier from at most ``sample`` pages, the first by a hash of their key.

    The labelled samples are blocks whose markup says what they are: inside an article or main element, or inside
    navigation, footers and the like. Without both kinds the text counts for nothing.
    """
    rows = pages.select(F.coalesce(F.md5(F.col(key).cast("string")), F.lit("")).alias("h"), F.col(page).alias("t")).where("t IS NOT NULL")
    # Only hashes are sorted; then the pages up to the last hash wanted reach the driver, not some of every task.
    last = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    tables, labels = [], []
    for row in rows.where(F.col("h") <= F.lit(last or "")).orderBy("h", "t").limit(sample).collect():
        blocks = page_of(row["t"]).blocks
        if blocks:
            tables.append(features(blocks))
            labels.append(np.array([0 if b.evidence == NONE else 1 if b.evidence == MAIN else -1 for b in blocks]))
    if not tables:
        return BlockClassifier()
    x, y = np.concatenate(tables), np.concatenate(labels)
    x, y = x[y != 0], (y[y != 0] > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return BlockClassifier()
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[0], scale[0] = 0.0, 1.0
    x = (x - mean) / scale
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w = np.zeros(x.shape[1])
    for _ in range(300):
        w += 1.0 * (x.T @ (weight * (y - 1 / (1 + np.exp(-x @ w)))) - 1e-3 * w)
    return BlockClassifier(weights=tuple(w), mean=tuple(mean), scale=tuple(scale))


def extract(pages: DataFrame, model: BlockClassifier, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``(key, url, text, n_chars)`` of every row: the main text of the whole page and its code points.

    Blocks are in page order, joined by two line ends; inside a block character references are decoded and white
    space is one space. A null or empty page, or one without main text, has the empty text. Repeated rows each get
    theirs; pages are read whole, one at a time, where they lie.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [main_text(t, model) if t else "" for t in texts_of(batch.column(2))]
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "u", "text", "n_chars"])

    kinds = f"k {pages.schema[key].dataType.simpleString()}, u {pages.schema[url].dataType.simpleString()}, text string, n_chars long"
    found = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(page).alias("p")).mapInArrow(run, kinds)
    return found.select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars")
