"""Main text of web pages from flat text blocks and a small decision tree.

A page becomes a flat list of text blocks. Each block is described by its word
count and link density, those of its neighbours and of its siblings, its kind,
and weak hints: what its open elements' tags and class words say of their role
and how much of the page lies inside them. A decision tree keeps or drops it.
It is trained on a small labelled table of layouts in which tags and class
words are right, missing or wrong whatever the label is, so that no word of the
list decides alone. Kept blocks are joined by two newlines.

Null or empty html gives an empty text. Pages are read whole, however broken:
unclosed elements end with their container, an unclosed tag or comment takes
the rest of the page; a self-closed svg or math is empty. Repeated rows are
each extracted.
"""

from __future__ import annotations

import functools
import html as entities
import itertools
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..ship import ship

# Elements by what they do to the text.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "canvas", "object", "title", "select", "noembed", "noframes", "xmp"}
#: Those that a slash at the end of their tag closes.
FOREIGN = {"svg", "math"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
MAIN_TAGS = {"article", "main"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BOILER_WORDS = (
    "ad ads advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus dropdown footer footnav gdpr masthead menu nav navbar navigation newsletter "
    "notification outbrain pager paging pagination popup promo promotion promoted recommended reply replies respond "
    "sharing sidebar signup sponsor sponsored subscribe taboola"
).split()
#: Words that pages also give to the frames of articles.
LOOSE_WORDS = "alert banner byline copyright donate form header legal login meta modal notice notices privacy related search share skip social tags toolbar topbar widget".split()
MAIN_WORDS = "article content entry main post story body text".split()
#: Words of the short headings that stand over what is not the article.
HEADING_WORDS = "about ads advertisement archives categories comment comments discussion follow links menu navigation newsletter popular recent recommended related replies reply responses search share sponsored subscribe tags trending".split()

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Attributes that end with a slash of the tag, not of an unquoted value.
_CLOSED = re.compile(r"""(?:[^"'=]|=\s*(?:"[^"]*"|'[^']*'|[^\s"'][^\s]*(?=\s))|"[^"]*"|'[^']*')*+(?<=/)""")
_WORDS = re.compile(r"[a-z]+")
_BOILER, _LOOSE, _MAIN, _OVER = frozenset(BOILER_WORDS), frozenset(LOOSE_WORDS), frozenset(MAIN_WORDS), frozenset(HEADING_WORDS)
#: Headings of more words are not looked at.
SHORT_HEADING = 5
#: "with-sidebar" and the like say what stands elsewhere.
_ABOUT = frozenset(("with", "has", "no", "without"))
FEATURES = (
    "words", "links", "previous_words", "previous_links", "next_words", "next_links", "sibling_words", "sibling_links", "sibling_share",
    "heading", "paragraph", "item", "named", "loose", "tagged", "region_share", "main", "hint", "headed",
)


@dataclass
class Block:
    """A text block: its words, those in links, and the places of its element's parent and of its region."""

    text: str
    words: int
    linked: int
    kind: str
    parent: int
    region: int
    named: bool
    loose: bool
    tagged: bool
    main: bool
    hint: bool
    headed: bool

    @property
    def boiler(self) -> bool:
        """Whether an element around it hints at boilerplate."""
        return self.named or self.loose or self.tagged


@dataclass
class _Open:
    """An open element; ``region`` is the innermost element around it whose tag or words hint at boilerplate."""

    tag: str
    place: int = 0
    parent: int = 0
    region: int = 0
    named: bool = False
    loose: bool = False
    tagged: bool = False
    main: bool = False
    hint: bool = False
    #: Whether the last heading directly inside says that what follows is not the article.
    headed: bool = False


_PAGE = _Open("")


@dataclass
class _State:
    stack: list[_Open] = field(default_factory=list)
    #: Places of each tag's open elements in the stack, ascending.
    places: dict[str, list[int]] = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)
    #: Parent of every element in order of opening; the page itself is element 0.
    parents: list[int] = field(default_factory=lambda: [0])
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    anchors: int = 0

    def flush(self) -> None:
        if self.parts:
            words = " ".join(entities.unescape("".join(self.parts)).split())
            if words:
                inner = self.stack[-1] if self.stack else _PAGE
                count = words.count(" ") + 1
                kind = next((e.tag for e in reversed(self.stack) if e.tag in HEADINGS or e.tag in ("p", "li", "td", "th", "dd", "dt", "blockquote", "pre")), "")
                if inner.tag in HEADINGS and len(self.stack) > 1:
                    self.stack[-2].headed = count <= SHORT_HEADING and not _OVER.isdisjoint(_WORDS.findall(words.lower()))
                headed = any(e.headed for e in self.stack)
                self.blocks.append(Block(words, count, min(self.linked, count), kind, inner.parent, inner.region, inner.named, inner.loose, inner.tagged, inner.main, inner.hint, headed))
        self.parts.clear()
        self.linked = 0

    def open(self, tag: str, attributes: str) -> None:
        outer = self.stack[-1] if self.stack else _PAGE
        new = _Open(tag, len(self.parents), outer.place, outer.region, outer.named, outer.loose, outer.tagged, outer.main, outer.hint)
        self.parents.append(outer.place)
        names, role, hidden = _hints(attributes) if attributes else (frozenset(), "", False)
        if tag in BOILER_TAGS or (tag == "header" and not outer.main) or role in BOILER_ROLES or hidden:
            new.tagged, new.region = True, new.place
        if names & (_BOILER | _LOOSE) and not names & _ABOUT:
            new.named |= bool(names & _BOILER)
            new.loose |= bool(names & _LOOSE)
            new.region = new.place
        new.main |= tag in MAIN_TAGS or role in MAIN_TAGS
        new.hint |= bool(names & _MAIN)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(new)

    def pop(self) -> None:
        self.places[self.stack.pop().tag].pop()

    def close(self, tag: str) -> None:
        """End the innermost open element of the tag, at any depth, and all inside it."""
        if found := self.places.get(tag):
            for _ in range(len(self.stack) - found[-1]):
                self.pop()


def _hints(attributes: str) -> tuple[frozenset[str], str, bool]:
    """Words of class and id, the role, and whether the element is hidden."""
    names, role, hidden = [], "", False
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            names += _WORDS.findall(value)
        elif name == "role":
            role = value
        elif name == "aria-hidden":
            hidden |= value == "true"
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "")
    return frozenset(names), role, hidden


def blocks(page: str) -> list[Block]:
    """Flat text blocks in page order; only block-level elements separate them."""
    return _parsed(page).blocks


def _parsed(page: str) -> _State:
    s, at, n, quotes = _State(), 0, len(page), True

    def text(a: int, b: int) -> None:
        if b > a:
            piece = page[a:b]
            s.parts.append(piece)
            if s.anchors:
                s.linked += len(piece.split())

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(at, n)
            break
        text(at, lt)
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        name = _NAME.match(page, lt)
        if name is None:
            text(lt, lt + 1)
            at = lt + 1
            continue
        rest = _REST.match(page, name.end()) if quotes else None
        if rest is not None:
            end = rest.end()
        else:
            quotes = False  # an unclosed quote: from here on tags end at the next >
            end = page.find(">", name.end()) + 1 or n
        closing, tag = name.group(1), name.group(2).lower()
        attributes = page[name.end() : end - 1]
        at = end
        if not closing and tag in FOREIGN and _CLOSED.fullmatch(attributes):
            continue
        if not closing and tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, end)
            stop = page.find(">", close.end()) if close else -1
            at = n if stop < 0 else stop + 1
            continue
        if tag in INLINE:
            if tag == "a":
                s.anchors = max(s.anchors + (-1 if closing else 1), 0)
            elif tag in ("br", "img"):
                s.parts.append(" ")
            continue
        s.flush()
        if tag == "hr" or tag in VOID:
            continue
        s.anchors = 0
        if closing:
            s.close(tag)
        else:
            if tag in CLOSED_BY:
                while s.stack and s.stack[-1].tag in CLOSED_BY[tag].split():
                    s.pop()
            elif s.stack and s.stack[-1].tag == "p":
                s.pop()
            s.open(tag, attributes)
    s.flush()
    return s


def described(page: str) -> tuple[list[Block], np.ndarray]:
    """The blocks of a page and one row of ``FEATURES`` for each."""
    state = _parsed(page)
    found = state.blocks
    within = [0] * len(state.parents)  # words inside each element, at any depth
    siblings: dict[int, list[int]] = {}
    for b in found:
        both = siblings.setdefault(b.parent, [0, 0])
        both[0] += b.words
        both[1] += b.linked
        if b.region:
            within[b.region] += b.words
    for place in range(len(within) - 1, 0, -1):
        within[state.parents[place]] += within[place]
    total = max(sum(b.words for b in found), 1)
    own = [(b.words, b.linked / b.words) for b in found]
    edge = (0, 0.0)
    rows = []
    for i, b in enumerate(found):
        words, linked = siblings[b.parent]
        kinds = (b.kind in HEADINGS, b.kind in ("p", "blockquote", "pre"), b.kind in ("li", "td", "th", "dd", "dt"))
        near = (*(own[i - 1] if i else edge), *(own[i + 1] if i + 1 < len(found) else edge))
        rows.append((*own[i], *near, words, linked / words, words / total, *kinds, b.named, b.loose, b.tagged, within[b.region] / total if b.region else 0.0, b.main, b.hint, b.headed))
    return found, np.array(rows, dtype=float).reshape(-1, len(FEATURES))


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1 and its share of main text."""

    feature: list[int]
    cut: list[float]
    low: list[int]
    high: list[int]
    share: list[float]

    def keep(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        feature, cut, low, high, share = map(np.asarray, (self.feature, self.cut, self.low, self.high, self.share))
        while True:
            inner = feature[node] >= 0
            if not inner.any():
                return share[node] > 0.5
            value = rows[np.arange(len(rows)), np.maximum(feature[node], 0)]
            node = np.where(inner, np.where(value <= cut[node], low[node], high[node]), node)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 20, least: int = 5) -> Tree:
    """Decision tree by Gini impurity with at least ``least`` rows in a leaf; equal gains go to the first feature and cut."""
    tree = Tree([], [], [], [], [])

    def impurity(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 2 * ones * (n - ones) / n

    def split(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Best gain and cut of one feature, over all places where its value changes."""
        order = np.argsort(x, kind="stable")
        x, ones, n = x[order], np.cumsum(y[order]), len(y)
        at = np.flatnonzero((x[1:] > x[:-1]) & (np.arange(1, n) >= least) & (np.arange(n - 1, 0, -1) >= least))
        if not len(at):
            return 0.0, 0.0
        whole = impurity(ones[-1:], np.array([n]))[0]
        gain = whole - impurity(ones[at], at + 1) - impurity(ones[-1] - ones[at], n - at - 1)
        best = int(np.argmax(np.round(gain, 9)))
        return float(round(gain[best], 9)), float((x[at[best]] + x[at[best] + 1]) / 2)

    def add(at: np.ndarray, left: int) -> int:
        node, y = len(tree.feature), labels[at]
        for values, value in ((tree.feature, -1), (tree.cut, 0.0), (tree.low, 0), (tree.high, 0), (tree.share, float(y.mean()))):
            values.append(value)
        if not left or y.min() == y.max():
            return node
        found = [split(rows[at, j], y.astype(np.int64)) for j in range(rows.shape[1])]
        best = int(np.argmax([gain for gain, _ in found]))
        if found[best][0] > 0:
            under = rows[at, best] <= found[best][1]
            tree.feature[node], tree.cut[node] = best, found[best][1]
            tree.low[node] = add(at[under], left - 1)
            tree.high[node] = add(at[~under], left - 1)
        return node

    add(np.arange(len(labels)), depth)
    return tree


# The labelled table. Each layout is a list of blocks: what opens
# before it, its element, its words (a number, or the text itself), whether it is
# a link, its label, what closes.
_M, _X = True, False
LAYOUTS = [
    [("<nav><ul>", "li", 1, 1, _X, ""), ("", "li", 2, 1, _X, ""), ("", "li", 1, 1, _X, "</ul></nav>"), ('<div class="ad">', "", 9, 0, _X, "</div>"), ("<article>", "h1", 8, 0, _M, ""), ("", "p", 60, 0, _M, ""), ("", "p", 2, 0, _M, ""), ("", "p", 120, 0, _M, "</article>"), ("<footer>", "", 14, 0, _X, "</footer>")],
    [('<div id="header">', "h2", 3, 0, _X, ""), ("", "p", 12, 0, _X, "</div>"), ('<div class="content">', "h1", 6, 0, _M, ""), ("", "p", 40, 0, _M, ""), ("", "p", 75, 0, _M, ""), ("<ul>", "li", 9, 0, _M, ""), ("", "li", 7, 0, _M, "</ul>"), ("", "p", 35, 0, _M, "</div>"), ('<div class="comments">', "h3", 1, 0, _X, ""), ("", "p", 45, 0, _X, ""), ("", "p", 22, 0, _X, "</div>")],
    [("<div>", "", 2, 1, _X, ""), ("<div></div>", "", 3, 1, _X, ""), ("<div></div>", "", 1, 1, _X, "</div>"), ("<div>", "p", 55, 0, _M, ""), ("", "p", 80, 0, _M, ""), ("", "p", 30, 0, _M, "</div>"), ("<div>", "", 4, 1, _X, ""), ("<div></div>", "", 5, 1, _X, "</div>"), ("<div>", "", 6, 0, _X, "</div>")],
    [('<div role="banner">', "", 5, 0, _X, "</div>"), ("<main>", "h1", 7, 0, _M, ""), ("", "p", 20, 0, _M, ""), ("<blockquote>", "p", 33, 0, _M, "</blockquote>"), ("", "h2", 4, 0, _M, ""), ("", "p", 90, 0, _M, ""), ("<table><tr>", "td", 3, 0, _M, ""), ("", "td", 2, 0, _M, "</tr></table>"), ("<pre>", "", 18, 0, _M, "</pre></main>"), ("<aside>", "h3", 2, 0, _X, ""), ("", "p", 50, 0, _X, ""), ("<ul>", "li", 4, 1, _X, "</ul></aside>")],
    [('<div class="cookie-notice">', "p", 30, 0, _X, ""), ("", "", 2, 1, _X, "</div>"), ("<article>", "h1", 9, 0, _M, ""), ("", "p", 11, 0, _M, ""), ("", "p", 4, 1, _M, ""), ("", "p", 70, 0, _M, ""), ('<div class="related">', "h3", 2, 0, _X, ""), ("<ul>", "li", 8, 1, _X, ""), ("", "li", 7, 1, _X, "</ul></div>"), ("", "p", 25, 0, _M, "</article>"), ("<form>", "p", 10, 0, _X, ""), ("", "label", 2, 0, _X, "</form>")],
    [("<header>", "h1", 4, 1, _X, ""), ("", "p", 6, 0, _X, "</header>"), ('<div class="sidebar">', "p", 40, 0, _X, "</div>"), ('<div class="post">', "h2", 5, 0, _M, ""), ("", "p", 3, 0, _M, ""), ("", "p", 100, 0, _M, "</div>"), ('<div class="share">', "", 3, 1, _X, "</div>"), ("<footer>", "p", 30, 0, _X, ""), ("", "p", 4, 1, _X, "</footer>")],
    [("<article><header>", "h1", 10, 0, _M, "</header>"), ("", "p", 15, 0, _M, ""), ("", "p", 1, 0, _M, ""), ("", "p", 1, 0, _M, ""), ('<div class="advert">', "p", 35, 0, _X, "</div>"), ("", "p", 44, 0, _M, ""), ("<section class=\"comments\">", "p", 60, 0, _X, "</section></article>"), ("<div>", "", 3, 1, _X, "</div>")],
    [("<table><tr>", "td", 2, 1, _X, ""), ("", "td", 3, 1, _X, "</tr></table>"), ("<div>", "h1", 6, 0, _M, ""), ("", "p", 65, 0, _M, ""), ("", "p", 12, 0, _M, ""), ("", "p", 58, 0, _M, "</div>"), ("<div>", "p", 5, 0, _X, "</div>")],
    [("<article>", "", 1, 0, _M, "</article>"), ("<footer>", "", 2, 0, _X, "</footer>")],
    [("<nav>", "", 3, 1, _X, "</nav>"), ("<article>", "h1", 9, 0, _M, ""), ("", "p", 30, 0, _M, ""), ("", "p", 2, 0, _M, "")],
    [('<div class="menu">', "", 8, 1, _X, "</div>"), ("<article>", "", 3, 0, _M, "")],
    [("<nav>", "", 3, 1, _X, "</nav>"), ("<main>", "p", 4, 0, _M, ""), ("", "p", 6, 1, _M, "</main>")],
    [("", "h1", 5, 0, _M, ""), ("", "p", 42, 0, _M, ""), ("", "p", 6, 0, _M, ""), ("", "p", 77, 0, _M, ""), ("", "p", 5, 0, _M, "")],
    [("", "p", 28, 0, _M, "")],
    [("", "p", 3, 0, _M, ""), ("", "p", 90, 0, _M, "")],
    [("<div>", "", 2, 1, _X, "</div>"), ("<div>", "", 70, 0, _M, "</div>"), ("<div>", "", 55, 0, _M, "</div>"), ("<div>", "", 5, 0, _X, "</div>")],
    [("<nav>", "", 3, 1, _X, "</nav>"), ("<article>", "h1", 1, 0, _M, ""), ("", "p", 400, 0, _M, ""), ("", "p", 250, 0, _M, "</article>"), ("<aside>", "", 90, 0, _X, "</aside>"), ("<footer>", "", 120, 0, _X, "</footer>")],
    [("<nav>", "", 5, 1, _X, "</nav>"), ('<div class="content"><section>', "h2", 4, 0, _M, ""), ("", "p", 70, 0, _M, ""), ("", "p", 45, 0, _M, "</section>"), ("<section>", "h2", 3, 0, _M, ""), ("", "p", 90, 0, _M, ""), ("", "p", 30, 0, _M, "</section>"), ("<section>", "h2", 5, 0, _M, ""), ("", "p", 60, 0, _M, ""), ("<ol>", "li", 12, 0, _M, ""), ("", "li", 18, 0, _M, "</ol></section>"), ("<section>", "h2", 2, 0, _M, ""), ("", "p", 85, 0, _M, "</section></div>"), ("<footer>", "", 25, 0, _X, "</footer>")],
    [('<div class="menu">', "", 6, 1, _X, "</div>"), ("<div><div>", "", 80, 0, _M, "</div></div>"), ("<div><div>", "", 45, 0, _M, "</div></div>"), ("<div><div>", "", 110, 0, _M, "</div></div>"), ("<div><div>", "", 65, 0, _M, "</div></div>"), ("<div><div>", "", 8, 0, _X, "</div></div>")],
    [("<nav>", "", 4, 1, _X, "</nav>"), ("<article>", "h1", 7, 0, _M, ""), ("", "p", 80, 0, _M, ""), ("", "p", 60, 0, _M, "</article>"), ('<div class="comments">', "h3", 2, 0, _X, ""), ('<div class="comment">', "p", 40, 0, _X, "</div>"), ('<div class="comment">', "p", 70, 0, _X, "</div>"), ('<div class="comment">', "p", 30, 0, _X, "</div>"), ('<div class="comment">', "p", 55, 0, _X, "</div></div>"), ("<footer>", "", 9, 0, _X, "</footer>")],
    [("<article>", "h1", 6, 0, _M, ""), ("", "p", 50, 0, _M, ""), ("", "p", 35, 0, _M, "</article>"), ('<ul class="comments">', "li", 25, 0, _X, ""), ("", "li", 40, 0, _X, ""), ("", "li", 18, 0, _X, "</ul>"), ("<footer><div>", "h4", 2, 0, _X, ""), ("<ul>", "li", 2, 1, _X, ""), ("", "li", 3, 1, _X, "</ul></div>"), ("<div>", "p", 12, 0, _X, "</div></footer>")],
    [("<header>", "", 5, 1, _X, "</header>"), ("<main>", "h1", 8, 0, _M, ""), ("", "p", 55, 0, _M, ""), ('<div class="related"><div>', "h3", 7, 1, _X, ""), ("", "p", 22, 0, _X, "</div>"), ("<div>", "h3", 6, 1, _X, ""), ("", "p", 26, 0, _X, "</div></div>"), ("", "p", 75, 0, _M, "</main>"), ('<div class="newsletter">', "h3", 4, 0, _X, ""), ("", "p", 15, 0, _X, ""), ("<form>", "label", 2, 0, _X, "</form></div>")],
    [("<nav>", "", 6, 1, _X, "</nav>"), ('<div class="ad">', "", 20, 0, _X, "</div>"), ("<article>", "h1", 5, 0, _M, ""), ("", "p", 14, 0, _M, "</article>"), ("<footer>", "", 40, 0, _X, "</footer>")],
    [("<nav>", "", 6, 1, _X, "</nav>"), ('<div class="ad">', "", 5, 0, _X, "</div>"), ("<article>", "h1", 9, 0, _M, ""), ("", "p", 9, 0, _M, ""), ("", "p", 30, 0, _M, ""), ('<div class="ad">', "p", 20, 0, _X, "</div>"), ("", "p", 60, 0, _M, "</article>"), ("<footer>", "", 18, 0, _X, "</footer>")],
    [('<div class="sidebar">', "h3", 2, 0, _X, ""), ("", "p", 45, 0, _X, ""), ("", "p", 30, 0, _X, "</div>"), ("<article>", "h1", 7, 0, _M, ""), ("", "p", 95, 0, _M, ""), ("<dl>", "dt", 2, 0, _M, ""), ("", "dd", 16, 0, _M, ""), ("", "dt", 3, 0, _M, ""), ("", "dd", 20, 0, _M, "</dl>"), ("", "p", 50, 0, _M, "</article>"), ('<div class="legal">', "p", 50, 0, _X, "</div>")],
    [("<header>", "h1", 4, 0, _X, ""), ("", "p", 9, 0, _X, "</header>"), ("<article>", "h2", 6, 0, _M, ""), ("", "p", 65, 0, _M, ""), ("<ul>", "li", 22, 0, _M, ""), ("", "li", 30, 0, _M, ""), ("", "li", 14, 0, _M, "</ul>"), ("", "p", 40, 0, _M, "</article>"), ("<article>", "h2", 5, 0, _M, ""), ("", "p", 70, 0, _M, ""), ("", "p", 20, 0, _M, "</article>"), ("<footer>", "p", 8, 0, _X, "</footer>")],
    [("<nav><ul>", "li", 1, 1, _X, ""), ("", "li", 1, 1, _X, ""), ("", "li", 2, 1, _X, "</ul></nav>"), ("<article>", "", 12, 0, _M, ""), ("", "p", 40, 0, _M, ""), ("<div>", "", 30, 0, _M, "</div>"), ("", "p", 22, 0, _M, "</article>"), ("<aside>", "", 15, 0, _X, "</aside>"), ("<footer>", "", 10, 0, _X, "</footer>")],
    [("<nav>", "", 4, 1, _X, "</nav>"), ("<article>", "h1", 6, 0, _M, ""), ("<p>", "", 3, 1, _M, "</p>"), ("<table><tr>", "td", 25, 0, _M, ""), ("", "td", 40, 0, _M, "</tr>"), ("<tr>", "td", 30, 0, _M, ""), ("", "td", 12, 0, _M, "</tr></table>"), ("", "p", 33, 0, _M, "</article>"), ("<footer>", "", 10, 1, _X, "</footer>")],
    [("<nav><ul>", "li", 1, 1, _X, ""), ("", "li", 1, 1, _X, ""), ("", "li", 1, 1, _X, "</ul></nav>"), ('<div class="ad">', "", 12, 0, _X, "</div>"), ("<article>", "h1", 2, 0, _M, ""), ("", "p", 2, 0, _M, ""), ("", "p", 10, 0, _M, "</article>"), ("<footer>", "", 16, 0, _X, "</footer>")],
    [("<nav><ul>", "li", 1, 1, _X, ""), ("", "li", 2, 1, _X, ""), ("", "li", 1, 1, _X, "</ul></nav>"), ('<div class="ad">', "", 6, 0, _X, "</div>"), ("<article>", "h1", 1, 0, _M, ""), ("", "p", 3, 0, _M, "</article>"), ("<footer>", "", 12, 0, _X, "</footer>")],
    [("<nav>", "", 6, 1, _X, "</nav>"), ('<div class="ad">', "", 25, 0, _X, "</div>"), ("<article>", "h1", 2, 0, _M, ""), ("", "p", 2, 0, _M, ""), ("", "p", 14, 0, _M, ""), ("", "p", 6, 0, _M, "</article>"), ("<footer>", "", 30, 0, _X, "</footer>")],
    [("<nav>", "", 4, 1, _X, "</nav>"), ("<main>", "h1", 5, 0, _M, ""), ("", "p", 60, 0, _M, ""), ("", "p", 40, 0, _M, "</main>"), ('<section class="comments">', "h2", 1, 0, _X, ""), ('<div class="comment">', "p", 60, 0, _X, "</div>"), ('<div class="comment">', "p", 45, 0, _X, "</div>"), ('<div class="comment">', "p", 80, 0, _X, "</div>"), ('<div class="comment">', "p", 25, 0, _X, "</div></section>")],
    [("", "", 30, 0, _M, "")],
    [("", "", 90, 0, _M, "")],
    [("", "", 40, 0, _M, "<hr>"), ("", "", 60, 0, _M, "")],
    [("", "", 5, 0, _M, "<hr>"), ("", "", 25, 0, _M, "<hr>"), ("", "", 45, 0, _M, "<hr>"), ("", "", 12, 0, _M, "")],
    [("<nav><ul>", "li", 1, 1, _X, ""), ("", "li", 1, 1, _X, ""), ("", "li", 2, 1, _X, "</ul></nav>"), ("<div>", "", 8, 0, _X, "</div>"), ("<article>", "h1", 9, 0, _M, ""), ("", "p", 30, 0, _M, ""), ("", "p", 12, 0, _M, ""), ("", "p", 60, 0, _M, "</article>"), ("<footer>", "", 12, 0, _X, "</footer>")],
    [("<nav><ul>", "li", 1, 1, _X, ""), ("", "li", 1, 1, _X, ""), ("", "li", 2, 1, _X, "</ul></nav>"), ("<div>", "", 11, 0, _X, "</div>"), ("<div>", "h1", 8, 0, _M, ""), ("", "p", 75, 0, _M, ""), ("", "p", 40, 0, _M, "</div>"), ("<div>", "", 10, 0, _X, "</div>")],
    [("<nav><ul>", "li", 1, 1, _X, ""), ("", "li", 1, 1, _X, "</ul></nav>"), ("<div>", "", 9, 0, _X, "</div>"), ("<article>", "h1", 9, 0, _M, ""), ("", "p", 9, 0, _M, ""), ("", "p", 12, 0, _M, "</article>"), ("<footer>", "", 12, 0, _X, "</footer>")],
    [("<div>", "", 50, 0, _M, "</div>")],
    [("<article>", "h1", 7, 0, _M, ""), ("", "p", 60, 0, _M, ""), ("", "p", 45, 0, _M, ""), ("", "p", 80, 0, _M, "</article>"), ("<section>", "h2", "Comments", 0, _X, ""), ("<div>", "p", 30, 0, _X, "</div>"), ("<div>", "p", 45, 0, _X, "</div>"), ("<div>", "p", 25, 0, _X, "</div>"), ("<div>", "p", 60, 0, _X, "</div></section>"), ("<footer>", "", 12, 0, _X, "</footer>")],
    [("<div>", "h1", 7, 0, _M, ""), ("", "p", 60, 0, _M, ""), ("", "p", 45, 0, _M, "</div>"), ("<div>", "h3", "12 Comments", 0, _X, ""), ("<ul>", "li", 30, 0, _X, ""), ("", "li", 22, 0, _X, ""), ("", "li", 50, 0, _X, "</ul></div>"), ("<div>", "", 9, 0, _X, "</div>")],
    [("<nav>", "", 4, 1, _X, "</nav>"), ("<article>", "h1", 6, 0, _M, ""), ("", "p", 90, 0, _M, ""), ("", "p", 50, 0, _M, "</article>"), ("<div>", "h3", "About us", 0, _X, ""), ("", "p", 40, 0, _X, "</div>"), ("<footer>", "", 15, 0, _X, "</footer>")],
    [("<nav>", "", 4, 1, _X, "</nav>"), ("<article>", "h1", 6, 0, _M, ""), ("", "p", 90, 0, _M, ""), ("", "p", 50, 0, _M, "</article>"), ("<div>", "h3", 3, 0, _X, ""), ("", "", 40, 0, _X, "</div>"), ("<footer>", "", 15, 0, _X, "</footer>")],
    [("<div>", "h4", "Recent posts", 0, _X, ""), ("<ul>", "li", 5, 1, _X, ""), ("", "li", 6, 1, _X, "</ul></div>"), ("<div>", "h1", 6, 0, _M, ""), ("", "p", 70, 0, _M, ""), ("", "p", 40, 0, _M, "</div>"), ("<form>", "h4", "Subscribe to our newsletter", 0, _X, ""), ("", "label", 5, 0, _X, ""), ("", "p", 16, 0, _X, "</form>")],
    [("<article>", "h1", 8, 0, _M, ""), ("", "p", 70, 0, _M, ""), ("", "p", 30, 0, _M, "</article>"), ("<form>", "label", 5, 0, _X, ""), ("<div></div>", "label", 4, 0, _X, ""), ("", "p", 9, 0, _X, "</form>"), ("<footer>", "", 8, 0, _X, "</footer>")],
    [("<form>", "label", 5, 0, _X, ""), ("<div></div>", "label", 2, 0, _X, "</form>"), ("<article>", "h1", 8, 0, _M, ""), ("", "p", 70, 0, _M, ""), ("", "p", 30, 0, _M, "</article>"), ("<form>", "p", 12, 0, _X, "</form>")],
    [("<nav><ul>", "li", 2, 1, _X, ""), ("", "li", 1, 1, _X, "</ul></nav>"), ("<article>", "h1", 7, 0, _M, ""), ("", "p", 60, 0, _M, ""), ("<ul>", "li", 4, 1, _M, ""), ("", "li", 6, 1, _M, ""), ("", "li", 3, 1, _M, "</ul>"), ("", "p", 50, 0, _M, "</article>"), ("<footer>", "", 9, 0, _X, "</footer>")],
    [("<header>", "", 3, 1, _X, "</header>"), ("<main>", "h1", 5, 0, _M, ""), ("", "p", 80, 0, _M, ""), ("", "h2", 2, 0, _M, ""), ("<ol>", "li", 8, 1, _M, ""), ("", "li", 10, 0, _M, ""), ("", "li", 5, 1, _M, "</ol></main>"), ("<footer><ul>", "li", 2, 1, _X, ""), ("", "li", 3, 1, _X, "</ul></footer>")],
]


#: Class words of a layout with wrong names: of containers of main text, and of others.
_WRONG_MAIN = ("page-header-layout", "content post widget", "form-page", "social-article", "entry related-posts", "search-body")
_WRONG_OTHER = ("content", "text", "post", "entry body", "main-block", "story")
_STARTS = re.compile(r"<(nav|footer|aside|form|header|article|main|section|div)\b([^>]*)>")
_ENDS = re.compile(r"</(?:nav|footer|aside|form|header|article|main|section)>")
NAMINGS = ("given", "given", "given", "classes", "none", "wrong", "framed", "notice")


def renamed(layout: list[tuple], naming: str, turn: int) -> list[tuple]:
    """A layout whose containers keep their tags and class words, or have other, wrong or no ones."""

    def start(m: re.Match, label: bool) -> str:
        if naming == "none":
            return "<div>"
        if naming == "classes":
            return f"<div{m[2]}>" if m[1] == "div" or "class" in m[2] else f'<div class="{m[1]}">'
        wrong = _WRONG_MAIN if label else _WRONG_OTHER
        return f'<div class="{wrong[turn % len(wrong)]}">'

    rows = list(layout)
    if naming in ("none", "classes", "wrong"):
        rows = [(_STARTS.sub(lambda m, label=row[4]: start(m, label), row[0]), *row[1:5], _ENDS.sub("</div>", row[5])) for row in rows]
    if naming == "framed":  # all of the page in one form or layout element
        frame = ('<form id="aspnetForm">', '<div class="page-header-layout">', '<div id="social-site">')[turn % 3]
        rows[0] = (frame + rows[0][0], *rows[0][1:])
    if naming == "notice":  # a notice in a plain element, first or last
        plain = ("<div>", "", 14 + 5 * (turn % 4), 0, False, "</div>")
        rows = [plain, *rows] if turn % 2 else [*rows, plain]
    return rows


def drawn(layout: list[tuple], naming: str, turn: int, draws: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features (draws x blocks), words of each block and draw, and the page of the first draw.

    Word counts are drawn around those of the layout; what does not depend on
    them is taken from one parsed page.
    """
    rows = renamed(layout, naming, turn)
    given = np.array([x[2].count(" ") + 1 if isinstance(x[2], str) else x[2] for x in rows])
    fixed, label, link = (np.array([f(x) for x in rows]) for f in (lambda x: isinstance(x[2], str), lambda x: x[4], lambda x: x[3] == 1))
    whole = random.normal(0, 0.6, (draws, 1))  # some articles are long, some short
    spread = np.where(given < 8, random.normal(0, 0.25, (draws, len(rows))), random.normal(0, 0.6, (draws, len(rows))) + whole * label)
    words = np.where(fixed, given, np.maximum(np.rint(given * np.exp(spread)), 1)).astype(int)
    page = ["<html><body>"]
    for (before, tag, said, _, _, after), n, linked in zip(rows, words[0].tolist(), link):
        text = said if isinstance(said, str) else " ".join(["word"] * n)
        text = f"<a href='#'>{text}</a>" if linked else text
        page.append(before + (f"<{tag}>{text}</{tag}>" if tag else text) + after)
    page.append("</body></html>")
    state = _parsed("".join(page))
    found, parents = state.blocks, state.parents
    if len(found) != len(rows):
        raise ValueError("a layout's blocks run together")

    def above(place: int) -> set[int]:
        out = {place}
        while place:
            place = parents[place]
            out.add(place)
        return out

    same = np.array([[a.parent == b.parent for b in found] for a in found], dtype=float)
    inside = np.array([[bool(a.region and b.region and a.region in above(b.region)) for b in found] for a in found], dtype=float)
    count, linked = words.astype(float), words * link
    total, siblings = count.sum(axis=1, keepdims=True), count @ same
    shift = lambda x, k: np.pad(x, ((0, 0), (1, 0) if k < 0 else (0, 1)))[:, : x.shape[1]] if k < 0 else np.pad(x, ((0, 0), (0, 1)))[:, 1:]
    density = linked / count
    flags = [[b.kind in HEADINGS, b.kind in ("p", "blockquote", "pre"), b.kind in ("li", "td", "th", "dd", "dt"), b.named, b.loose, b.tagged] for b in found]
    still = [np.broadcast_to(np.array(x, dtype=float), count.shape) for x in zip(*flags)]
    last = [np.broadcast_to(np.array(x, dtype=float), count.shape) for x in zip(*((b.main, b.hint, b.headed) for b in found))]
    columns = [count, density, shift(count, -1), shift(density, -1), shift(count, 1), shift(density, 1), siblings, (linked @ same) / siblings, siblings / total, *still, (count @ inside.T) / total, *last]
    return np.stack(columns, axis=2), words, page


def labelled_table(draws: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of every layout, under each naming and at several text lengths, drawn with a fixed seed."""
    random, table, labels = np.random.default_rng(17), [], []
    for turn, (layout, naming) in enumerate(itertools.product(LAYOUTS, NAMINGS)):
        rows = drawn(layout, naming, turn, draws, random)[0]
        table.append(rows.reshape(-1, len(FEATURES)))
        labels += [x[4] for x in renamed(layout, naming, turn)] * draws
    return np.concatenate(table), np.array(labels)


@functools.lru_cache(maxsize=1)
def default_tree() -> Tree:
    return grow(*labelled_table())


def main_blocks(page: str | None, tree: Tree) -> list[str]:
    if not page:
        return []
    found, rows = described(page)
    return [b.text for b, keep in zip(found, tree.keep(rows)) if keep]


def extract(pages: DataFrame, tree: Tree | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, n_blocks) of every page."""
    ship(pages.sparkSession)
    tree = tree or default_tree()

    def run(batches):
        for batch in batches:
            kept = [main_blocks(page, tree) for page in batch.column(2).to_pylist()]
            texts = ["\n\n".join(x) for x in kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array([len(x) for x in kept], pa.int64())],
                names=[id_col, url_col, "text", "n_chars", "n_blocks"],
            )

    kinds = dict(pages.dtypes)
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long, n_blocks long")
