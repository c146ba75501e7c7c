"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read into text blocks with their open elements. A logistic classifier scores each block
from its elements, class names, link share and length; the cost of either label becomes a terminal
capacity. Neighbouring blocks and blocks of one container are tied by smoothness edges, the tighter
the closer they are in the document tree. The maximum flow separates content from boilerplate.

Blocks keep page order; white space inside a block is one space; blocks are joined by an empty line.
Scripts, styles, comments, widgets and hidden elements never become blocks; formulas (<math>) are text.
Line breaks (<br>) count as white space. What an element says about the blocks in it is carried down as it
opens, so that a page takes time in proportion to its length, however deeply it is nested.

A class name or id speaks against a block only as a whole: all its parts must be words of page
furniture ("cookie-notice", "relatedPosts", "sidebar-2"), not just one ("related-work", "legal-analysis").
A form is furniture by what it holds: controls and little text, not the page's article. On a page of which
nothing would be left, the name or form around most of the text isn't believed.

The weights are fitted (fit_weights) to pages of known main text that a generator makes in the tests; ties are
on the scale of the costs they are weighed against, so that a doubtful block goes with those around it.

Defined cases: a null, empty or tag-only page has an empty text; unclosed elements close with their
container; an unclosed comment, script, style, textarea or title runs to the end of the page; a widget
without an end tag behind it, or closed in itself, is empty, a drawing ends at the next element of the text; rows are read each by itself,
so repeated or null ids are kept; columns named text or n_chars are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mfrac mi mn mo mrow ms msqrt mstyle msub msubsup msup mtext semantics".split())
#: Elements whose content is never text of the page.
SILENT = frozenset("script style template noscript svg iframe object canvas title textarea select button annotation annotation-xml audio video head".split())
#: Elements that end a drawing without an end tag.
BREAKS_OUT = frozenset("article aside b blockquote body br center code dd div dl dt em figure footer form h1 h2 h3 h4 h5 h6 header hr i img li main menu nav ol p pre section small span strong sub sup table ul".split())
RAW = frozenset("script style textarea title".split())
#: What an opening tag closes if still open: itself, up to a container.
CLOSES = {"li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
#: What stands in an opening tag: quotes count behind "=" only, a bare value runs to white space or ">".
_INSIDE = r"""(?:[^>=]|=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?)*+"""
TOKEN = re.compile(rf"""<!--(.*?)(?:-->|\Z)|<([a-zA-Z][^\s/>]*+)({_INSIDE})>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<[!?][^>]*+>|<[a-zA-Z/][^<>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?)?+""", re.S)

#: Weights of the block classifier (log odds of content), fitted to made pages.
WEIGHTS = {
    "base": 3.24, "article": 1.8, "main": 1.88, "heading": 1.13, "named_main": 3.84, "away": -7.0, "named_away": -9.31, "masthead": -5.79, "form": -8.66,
    "links": -3.8, "article_links": 4.05, "long": 0.97, "sentence": -1.03, "short": -1.86,
}
AWAY = frozenset("nav footer aside menu dialog".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
FORMS, CONTROLS = frozenset(("form", "fieldset")), frozenset("input select textarea button".split())
#: Words of class names and ids: for furniture, for mastheads, for the main text, and those that say nothing.
AWAY_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsors sponsored promo promos promoted promotion promotions banner banners sidebar sidebars side menu menus submenu nav navs navbar navigation breadcrumb breadcrumbs footer footers foot topbar cookie cookies consent notice notices gdpr privacy popup popups modal overlay newsletter newsletters subscribe subscription signup signin login register share shares sharing social follow related recommended recommendations widget widgets comment comments commentlist disqus respond reply replies toolbar pagination pager skip legal copyright disclaimer alert alerts search".split()
)
HEAD_WORDS = frozenset("header headers head masthead".split())
MAIN_WORDS = frozenset("article content post entry story body main text".split())
PLAIN_WORDS = frozenset(
    "a about and area bar block blocks bottom box boxes btn button buttons by card cards cell center class col column columns container desktop div element fixed for form global group holder id in inner item items js large layer layout left level line link links list lists media message messages middle mini mobile module modules more my new news of on outer page pages panel panels part post posts articles stories entries primary reader readers right row rows secondary section sections share site slot small sticky strip tab table tabs the thread title to top ui ul unit us user users view website wide wrap wrapper you your zone".split()
)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+")
#: Ties: of neighbours, falling with the 1.5th power of their steps in the tree; of blocks of one container; and
#: the steps that an article's, form's or name's edge counts for. Chosen for fewest errors on made pages.
ADJACENT, CONTAINER, EDGE = 80.0, 1.0, 100


def attributes_of(inside: str) -> dict[str, str]:
    """Names (lower-cased, the first of each counts) and values of the attributes of an opening tag."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(inside):
        found.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return found


class Form:
    """What a form holds: visible controls, characters of text, and whether an article or the main part is in it."""

    __slots__ = ("around", "controls", "chars", "holds_main")

    def __init__(self, around: Form | None):
        self.around, self.controls, self.chars, self.holds_main = around, 0, 0, False

    def furniture(self) -> bool:
        return self.controls > 0 and not self.holds_main and self.chars < 150 * (1 + self.controls)


def name_kind(name: str) -> str:
    """What a class or id attribute says: away, head, main or nothing."""
    kind = ""
    for token in name.split():
        parts = {x.lower() for x in _PARTS.findall(token)}
        rest = parts - PLAIN_WORDS - MAIN_WORDS
        if parts & AWAY_WORDS and not rest - AWAY_WORDS - HEAD_WORDS:
            return "away"
        if parts & HEAD_WORDS and not rest - HEAD_WORDS:
            kind = "head"
        elif parts & MAIN_WORDS:
            kind = kind or "main"
    return kind


class Element:
    """An open element and what it says, with those around it, about the blocks in it."""

    __slots__ = ("tag", "parent", "depth", "silent", "holder", "article", "away", "masthead", "main", "heading", "named_away", "named_main", "form")

    def __init__(self, tag: str, parent: Element | None, attributes: str = "", silent: bool = False):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.silent = silent or (parent is not None and parent.silent)
        self.holder = parent.holder if parent is not None and tag in INLINE else self
        self.article = tag == "article" or (parent is not None and parent.article)
        self.main = tag == "main" or (parent is not None and parent.main)
        self.away = tag in AWAY or (parent is not None and parent.away)
        self.masthead = tag == "header" or (parent is not None and parent.masthead)
        self.heading = tag in HEADINGS or (parent is not None and parent.heading)
        self.named_away: Element | None = parent.named_away if parent else None
        self.named_main = parent is not None and parent.named_main
        self.form: Form | None = parent.form if parent else None
        for key, value in attributes_of(attributes).items() if attributes else ():
            if key in ("class", "id"):
                self._named(value)
            elif key == "role":
                role = value.lower()
                self.away |= role in AWAY_ROLES
                self.article |= role == "article"
                self.main |= role == "main"
                if role == "form":
                    self.form = Form(self.form)
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN_STYLE.search(value):
                self.silent = True
        if tag in FORMS:
            self.form = Form(self.form)
        if tag in ("article", "main"):
            form = self.form
            while form is not None:
                form.holds_main, form = True, form.around

    def claims(self) -> tuple:
        """What tells the element's part of the page from others."""
        return self.article, self.main, self.away, id(self.named_away), self.named_main, self.masthead, id(self.form)

    def _named(self, name: str) -> None:
        kind = name_kind(name)
        if kind == "head" and self.tag not in ("html", "body"):
            self.masthead = True
        elif kind and self.tag not in ("html", "body", "article", "main"):
            if kind == "away":
                self.named_away = self
            else:
                self.named_main = True


HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_STOPS = frozenset(("ul", "ol", "table", "dl", "article", "section", "div", "body", "html", "td", "th", *SILENT))
_ROW_STOPS = frozenset(("table", "body", "html", *SILENT))


@dataclass
class Block:
    at: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


class _Reader:
    """Reads a page into blocks."""

    def __init__(self, page: str):
        self.page, self.here = page, Element("html", None)
        self.open: Counter[str] = Counter()
        self.block: Block | None = None
        self.out: list[Block] = []
        self.last_end: dict[str, int] = {}

    def close(self) -> None:
        """The block ends."""
        if self.block is not None:
            self.block.text = " ".join(html.unescape("".join(self.block.parts)).split())
            if self.block.text:
                self.out.append(self.block)
                form = self.block.at.form
                while form is not None:
                    form.chars, form = form.chars + len(self.block.text), form.around
        self.block = None

    def put(self, text: str) -> None:
        if self.here.silent:
            return
        if self.block is None:
            if not text.strip():
                return
            self.block = Block(self.here.holder)
        self.block.parts.append(text)
        if self.open["a"]:
            self.block.linked += len(text.strip())

    def enter(self, element: Element) -> None:
        self.here = element
        self.open[element.tag] += 1

    def leave(self, element: Element) -> None:
        """Close all that is open up to an element, itself included."""
        parent = element.parent
        while self.here is not parent:
            self.open[self.here.tag] -= 1
            self.here = self.here.parent

    def leave_tag(self, tag: str) -> None:
        walk = self.here
        while walk.tag != tag:
            walk = walk.parent
        self.leave(walk)

    def implied(self, tag: str, stops: frozenset[str]) -> None:
        """An element that a new one closes, if it is open in the same container."""
        walk: Element | None = self.here if self.open[tag] else None
        while walk is not None and walk.tag not in stops:
            if walk.tag == tag:
                self.leave(walk)
                return
            walk = walk.parent

    def start(self, tag: str, attributes: str, at: int) -> int:
        """An opening tag; returns where to read on."""
        if tag == "br" and not self.open["svg"]:
            self.put(" ")
            return at
        if tag not in INLINE:
            self.close()
        if tag in CONTROLS and self.here.form is not None and attributes_of(attributes).get("type", "").lower() != "hidden":
            self.here.form.controls += 1
        if tag in VOID:
            return at
        if tag in RAW or tag == "head":
            return _past(self.page, at, tag)
        closed = attributes.rstrip().endswith("/")
        if tag in SILENT:
            if tag not in self.last_end:
                self.last_end[tag] = max((x.start() for x in re.finditer(rf"</{tag}\b", self.page, re.I)), default=-1)
            if not closed and (tag == "svg" or self.last_end[tag] >= at):
                self.enter(Element(tag, self.here, silent=True))
            return at
        if self.open["svg"] and tag in BREAKS_OUT and self.last_end["svg"] < at:  # the drawing has no end tag
            self.leave_tag("svg")
        if tag in CLOSES or tag not in INLINE:
            for old in CLOSES.get(tag, ("p",)):
                self.implied(old, _ROW_STOPS if old == "tr" else _STOPS)
        if not closed or tag in INLINE:
            self.enter(Element(tag, self.here, attributes))
        return at

    def end(self, tag: str) -> None:
        """A closing tag; one without an open element closes nothing."""
        if tag not in INLINE:
            self.close()
        if self.open[tag]:
            self.leave_tag(tag)


def blocks(page: str) -> list[Block]:
    """Text blocks in page order."""
    reader, at, n = _Reader(page), 0, len(page)
    while at < n:
        found = TOKEN.search(page, at)
        if found is None:
            reader.put(page[at:])
            break
        if found.start() > at:
            reader.put(page[at : found.start()])
        at = found.end()
        if found[2]:
            at = reader.start(found[2].lower(), found[3] or "", at)
        elif found[4]:
            reader.end(found[4].lower())
    reader.close()
    return reader.out


def _past(page: str, at: int, tag: str) -> int:
    end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
    if end is None:
        return at if tag == "head" else len(page)
    return end.end()


FEATURES = tuple(WEIGHTS)


def features(block: Block, believed: bool = True) -> list[float]:
    """What is known about a block, in the order of the weights. believed: whether names and forms count."""
    at, length = block.at, len(block.text)
    linked = min(1.0, block.linked / max(1, length))
    form = at.form
    while form is not None and not form.furniture():
        form = form.around
    return [
        1.0, at.article, at.main, at.heading, at.named_main, at.away, believed and at.named_away is not None, at.masthead and not at.article, believed and form is not None,
        linked, linked * (at.article or at.main), length >= 80, block.text[-1] in ".!?:;…。！？", length < 25 and block.linked > 0,
    ]


def score(block: Block, believed: bool = True) -> float:
    """Log odds that a block is content."""
    return sum(w * x for w, x in zip(WEIGHTS.values(), features(block, believed), strict=True))


def fit_weights(pages: list[tuple[str, set[str]]], ridge: float = 1.0, rounds: int = 60) -> dict[str, float]:
    """Logistic weights of blocks, from pages and the texts of their content blocks (Newton's method)."""
    import numpy as np

    rows = [(features(b), b.text in content) for page, content in pages for b in blocks(page)]
    x, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
    return dict(zip(FEATURES, w.tolist(), strict=True))


def distance(a: Element, b: Element) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    x: Element | None = a
    y: Element | None = b
    while x is not y:
        if x is None or (y is not None and y.depth > x.depth):
            y = y.parent
        else:
            x = x.parent
        steps += 1
    return steps


def content(scores: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: log-loss of the scores plus the weight of every tie that is cut."""
    n = len(scores)
    source, sink = n, n + 1
    to, room, edges = [], [], [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        edges[a].append(len(to)), to.append(b), room.append(forth)
        edges[b].append(len(to)), to.append(a), room.append(back)

    for i, s in enumerate(scores):
        edge(source, i, math.log1p(math.exp(min(s, 30.0))), 0.0)  # cost of calling it boilerplate
        edge(i, sink, math.log1p(math.exp(min(-s, 30.0))), 0.0)
    for a, b, weight in ties:
        edge(a, b, weight, weight)
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, [source]
        for x in queue:
            for e in edges[x]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nth = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                x = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nth[x] < len(edges[x]):
                e = edges[x][nth[x]]
                if room[e] > 1e-9 and level[to[e]] == level[x] + 1:
                    path.append(e)
                    x = to[e]
                    break
                nth[x] += 1
            else:
                if x == source:
                    break
                e = path.pop()
                x = to[e ^ 1]
                nth[x] += 1


#: Characters from which on the text in one element can be the page's main text whatever the element's name.
MOST = 400


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    ties, last_in = [], {}
    for i, block in enumerate(found):
        if i:
            before = found[i - 1].at
            steps = 1 + distance(before, block.at) + (EDGE if before.claims() != block.at.claims() else 0)
            ties.append((i - 1, i, ADJACENT / steps**1.5))
        holder = id(block.at.parent)
        if holder in last_in:
            ties.append((last_in[holder], i, CONTAINER / (i - last_in[holder])))
        last_in[holder] = i
    keep = content([score(b) for b in found], ties)
    if not any(keep):
        doubted = _doubted(found)
        keep = content([score(b, id(b.at.named_away or b.at.form) != doubted) for b in found], ties) if doubted else keep
    return "\n\n".join(b.text for b, kept in zip(found, keep, strict=True) if kept)


def _doubted(found: list[Block]) -> int:
    """The named element or form that holds most of a page's unlinked text, if that is much; else 0."""
    size: Counter[int] = Counter()
    for b in found:
        size[id(b.at.named_away or b.at.form)] += 0 if b.at.away or b.linked * 2 > len(b.text) else len(b.text)
    (most, chars), *_ = size.most_common(1)
    return most if chars >= MOST and most != id(None) and 3 * chars >= 2 * sum(size.values()) else 0


def extract(pages: DataFrame) -> DataFrame:
    """pages without html, with text and n_chars (its code points)."""
    own = [c for c in pages.columns if c not in ("text", "n_chars", "html")]
    schema = T.StructType([pages.schema[c] for c in own]).add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(batch.schema.get_field_index("html"))]
            made = [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), *made], names=[*own, "text", "n_chars"])

    return pages.select(*own, "html").mapInArrow(run, schema)
