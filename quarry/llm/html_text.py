"""Main text of web pages from flat text blocks and a decision tree.

* **Blocks.**  A single pass over the tags of a page cuts its text at block-level tags.  Scripts, styles,
  titles, form controls and comments give no text.  Each block knows its words, the words inside links, whether
  it is a heading, the strongest content element around it (``article``, ``main``, a content class) and whether
  an element around it is marked as something else (``nav``, ``aside``, ``form``, a class such as ``sidebar``).
* **Features.**  Word count and link density of the block and of its two neighbours, heading, marked, and the
  place: inside the page's strongest content element, outside it, or on a page without any.
* **Tree.**  A Gini decision tree over these features, grown in numpy on a labelled table of ``LABELLED_PAGES``
  pages drawn by ``labelled_blocks`` from kinds of blocks (word and link ranges, labels).  The table is the same
  each time; the tree is a few dozen nodes and is grown once on the driver.
* **Text.**  The blocks that the tree calls main text, in page order; nothing else is dropped and nothing capped.

Pages are scored in one map stage in bounded slices, so a lost executor costs its own tasks only.

Defined results: null or empty html gives an empty text; a null page_id or url is passed on; repeated pages are
pages of their own; an empty table gives no rows; other columns are ignored.  Character references are decoded
once, unknown ones stay as written.  An unclosed comment, script or tag runs to the end of the page.
"""

from __future__ import annotations

import functools
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, slices

LABELLED_PAGES = 600
DEPTH, LEAF = 8, 5

# Element names and the words of class, id and role that mark a part of a page.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("template svg select button object canvas audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
                    "span strike strong sub sup time tt u var").split())
MARKED = frozenset("nav header footer aside form menu dialog label fieldset".split())
TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
CELLS = frozenset("td th caption".split())
IMPLIED_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OTHER_PARTS = frozenset((
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion "
    "nav navbar navigation navi menu submenu breadcrumb breadcrumbs pager pagination toolbar skip "
    "masthead topbar header footer bottombar copyright contentinfo "
    "sidebar aside widget complementary related recommended recommendations trending popular "
    "cookie cookies consent gdpr notice notification alert popup modal overlay dialog disclaimer "
    "newsletter subscribe subscription signup login paywall share sharing social "
    "comment comments commentlist reply replies respond disqus discussion form search hidden").split())
CONTENT = frozenset("article content main post entry story articlebody maintext bodytext".split())
AROUND = frozenset("wrap wrapper container layout page site with has no row col grid".split())  # such a class is no mark

_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=]+|=)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}
_COMMENT_END = re.compile(r"--!?>")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_READ = frozenset("class id role href hidden aria-hidden style".split())


def _tag(html: str, at: int):
    """(name, wanted attributes, end) of the tag whose name starts at ``at``; the end is -1 if it never closes."""
    name = _NAME.match(html, at)
    at, attributes = name.end(), {}
    while True:
        m = _ATTRIBUTE.match(html, at)
        if not m:
            break
        at = m.end()
        key = m[1].lower()
        if key in _READ and key not in attributes:
            attributes[key] = (m[2] or "").strip("\"'")
    end = html.find(">", at)
    return name[0].lower(), attributes, end


def _markup(html: str):
    """Events of a page: (text, None, None), (name, attributes, True) for start tags, (name, None, False) for end tags."""
    at, size, text_from = 0, len(html), 0
    while at < size:
        lt = html.find("<", at)
        if lt < 0 or lt + 1 >= size:
            break
        c = html[lt + 1]
        closing = c == "/" and lt + 2 < size and html[lt + 2].isascii() and html[lt + 2].isalpha()
        opening = c.isascii() and c.isalpha()
        if not (opening or c in "!?/"):
            at = lt + 1  # a plain "<"
            continue
        if lt > text_from:
            yield html[text_from:lt], None, None
        text_from = size
        if opening or closing:
            name, attributes, end = _tag(html, lt + (1 if opening else 2))
            if end < 0:
                return
            at = end + 1
            if closing:
                yield name, None, False
            else:
                yield name, attributes, True
                if name in RAW:
                    m = _RAW_END[name].search(html, at)
                    if not m:
                        return
                    at = m.start()
        elif html.startswith("<!--", lt):
            if html.startswith((">", "->"), lt + 4):
                at = html.index(">", lt) + 1
            else:
                m = _COMMENT_END.search(html, lt + 4)
                if not m:
                    return
                at = m.end()
        else:
            end = html.find(">", lt)
            if end < 0:
                return
            at = end + 1
        text_from = at
    if text_from < size:
        yield html[text_from:], None, None


@functools.lru_cache(maxsize=4096)
def _marks(value: str) -> tuple[bool, bool]:
    """(marks another part of a page, marks content) of a class, id or role."""
    other = content = False
    for word in value.split():
        parts = {p.lower() for p in _PART.findall(word)} | {word.lower()}
        if not parts & AROUND:
            titled = {"header"} if parts & CONTENT else set()  # the header of an entry holds its title
            other |= bool(parts & OTHER_PARTS - titled)
            content |= bool(parts & CONTENT)
    return other, content and not other


def _context(name: str, attributes: dict, context):
    """The (hidden, marked, loosely marked, content level) inside an element.

    A form or a page header around an ``article`` or ``main`` doesn't mark what is inside it.
    """
    hidden, marked, loose, level = context
    if name in HIDDEN:
        hidden = True
    if name in ("html", "body"):
        return hidden, marked, loose, level
    if name in ("article", "main"):
        loose = False
        level = max(level, 3 if name == "article" else 2)
    other = content = False
    for key in ("class", "id", "role"):
        if attributes.get(key):
            o, c = _marks(attributes[key])
            other, content = other or o, content or c
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        other = True
    if name == "header":
        loose = loose or level < 2  # an article's own header holds its title
    elif name == "form" and not other:
        loose = True
    elif name in MARKED or other:
        marked = True
    elif content:
        level = max(level, 1)
    return hidden, marked, loose, level


class Frame:
    """An open block-level element, the inline elements opened in it and counts of the elements an end tag may reach from it."""
    __slots__ = ("name", "context", "inline", "owner", "scope")

    def __init__(self, name, context, owner, scope):
        self.name, self.context, self.inline, self.owner, self.scope = name, context, [], owner, scope


def blocks(html: str) -> list[tuple[str, int, int, bool, bool, int]]:
    """(text, words, linked words, heading, marked, content level) of the blocks of a page, in order."""
    out, pieces, linked, at = [], [], 0, None
    start = (False, False, False, 0)
    stack = [Frame("", start, {}, {})]
    open_all: dict[str, int] = {}
    context, link = start, 0  # of the innermost element; depth of the link around

    def flush():
        nonlocal linked
        words = "".join(pieces).split()
        if words:
            (_, marked, loose, level), heading = at
            out.append((" ".join(words), len(words), min(linked, len(words)), heading, marked or loose, level))
        pieces.clear()
        linked = 0

    def pop():
        nonlocal context, link
        frame = stack.pop()
        open_all[frame.name] -= 1
        frame.owner[frame.name] -= 1
        if link > len(stack):
            link = 0
        top = stack[-1]
        context = top.inline[-1][1] if top.inline else top.context

    for name, attributes, begins in _markup(html):
        if begins is None:
            if context[0]:
                continue
            here = (context, stack[-1].name in HEADINGS)
            if here != at:
                flush()
                at = here
            text = unescape(name)
            pieces.append(text)
            if link:
                linked += len(text.split())
        elif name in INLINE:
            top = stack[-1]
            if begins:
                if name == "a":
                    link = len(stack) if "href" in attributes else 0
                context = _context(name, attributes, context)
                top.inline.append((name, context))
            else:
                if name == "a":
                    link = 0
                # those opened after it end too; an end tag reaches 64 elements back and never out of its block
                if any(n == name for n, _ in top.inline[-64:]):
                    while top.inline.pop()[0] != name:
                        pass
                    context = top.inline[-1][1] if top.inline else top.context
        elif name in VOID:
            if name == "br":
                pieces.append(" ")
            elif name == "hr":
                flush()
        elif name in RAW:
            pass
        elif begins:
            flush()
            if stack[-1].name == "p" or (stack[-1].name in HEADINGS and name in HEADINGS):
                pop()
            while stack[-1].name in IMPLIED_END.get(name, ()):
                pop()
            context = _context(name, attributes, context)
            owner = stack[-1].scope
            owner[name] = owner.get(name, 0) + 1
            stack.append(Frame(name, context, owner, {} if name in CELLS else owner))
            open_all[name] = open_all.get(name, 0) + 1
        else:
            flush()
            if (open_all if name in TABLE else stack[-1].scope).get(name, 0) > 0:
                while stack[-1].name != name:
                    pop()
                pop()
    flush()
    return out


def features(rows) -> np.ndarray:
    """One row of numbers per block (words, linked words, heading, marked, content level) of a page."""
    x = np.array([r[-5:] for r in rows], np.float64).reshape(len(rows), 5)
    words, linked, heading, marked, level = x.T
    density = linked / np.maximum(words, 1)
    own = np.column_stack([words, density])
    edge = np.zeros((1, 2))
    strongest = level[marked == 0].max(initial=0)
    place = np.where(strongest == 0, 0, np.where(level >= strongest, 1, -1))
    return np.column_stack([own, np.vstack([edge, own])[:-1], np.vstack([own, edge])[1:], heading, marked, place])


# The kinds of blocks of the labelled table: main text or not, most words, least and most link density, share of headings.
KINDS = {
    "title": (1, 14, 0.0, 0.0, 1.0), "linked title": (1, 14, 1.0, 1.0, 1.0), "paragraph": (1, 300, 0.0, 0.2, 0.0),
    "short paragraph": (1, 8, 0.0, 0.0, 0.0), "point": (1, 30, 0.0, 0.6, 0.0), "subtitle": (1, 10, 0.0, 0.0, 1.0),
    "site name": (0, 5, 0.0, 1.0, 0.4), "menu item": (0, 4, 1.0, 1.0, 0.0), "advert": (0, 40, 0.0, 1.0, 0.1),
    "notice": (0, 60, 0.0, 0.3, 0.1), "teaser": (0, 30, 0.7, 1.0, 0.2), "comment": (0, 150, 0.0, 0.1, 0.0),
    "form label": (0, 6, 0.0, 0.0, 0.1), "footer line": (0, 25, 0.0, 1.0, 0.0),
}


def labelled_blocks(pages: int = LABELLED_PAGES, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: features and labels of the blocks of ``pages`` drawn pages.

    Half of the pages have a content element, some hold their text alone.  On most pages the other parts are marked; where they are not,
    a page without a content element holds only parts that words and links can tell apart.
    """
    r = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        level, marked = (r.integers(1, 4) if r.random() < 0.5 else 0), r.random() < 0.7
        rows, labels = [], []

        def add(kind, inside, times=1):
            main, most, low, high, heading = KINDS[kind]
            for _ in range(times):
                words = int(np.ceil(most ** r.random())) if main else int(r.integers(1, most + 1))
                if main and level == 0 and not marked and kind == "paragraph":
                    words += 12  # else nothing tells it from a line of a footer
                is_marked = not main and (marked or (inside and kind != "menu item"))
                rows.append((words, round(words * r.uniform(low, high)), r.random() < heading, is_marked, level if inside else 0))
                labels.append(main)

        if r.random() < 0.15:  # a page of its text alone
            if r.random() < 0.5:
                add("title", True)
            add("paragraph" if r.random() < 0.8 else "short paragraph", True, r.integers(1, 6))
            xs.append(features(rows))
            ys += labels
            continue
        plain = level == 0 and not marked
        add("site name", False, r.integers(0, 2))
        add("menu item", False, r.integers(2, 12))
        if not plain:
            add("advert", False, r.integers(0, 2))
            add("notice", False, r.integers(0, 2))
        add("linked title" if r.random() < 0.2 and not plain else "title", True)
        for _ in range(r.integers(1, 15)):
            kind = r.choice(["paragraph", "short paragraph", "point", "subtitle", "advert", "menu item"], p=[0.6, 0.12, 0.1, 0.1, 0.04, 0.04])
            if KINDS[kind][0] or not plain:
                add(kind, True, r.integers(3, 6) if kind in ("point", "menu item") else 1)
        if not plain:
            add("comment", False, r.integers(0, 5))
            add("form label", False, r.integers(0, 4))
        add("teaser", False, r.integers(0, 6))
        add("menu item", False, r.integers(0, 6))
        add("footer line", False, r.integers(1, 3))
        xs.append(features(rows))
        ys += labels
    return np.vstack(xs), np.array(ys)


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, leaf: int = LEAF) -> list[tuple[int, float, int, int, float]]:
    """A tree as rows (feature or -1, threshold, left, right, share of main text); ties go to the first best split."""
    nodes = []

    def node(rows, left_depth):
        k = len(nodes)
        share = float(y[rows].mean())
        nodes.append((-1, 0.0, 0, 0, share))
        best = (2 * share * (1 - share) * len(rows) - 1e-9, -1, 0.0)
        if left_depth and 0 < share < 1:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, ones = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(order))
                a, b = ones[:-1], ones[-1] - ones[:-1]
                m = len(order) - n
                impurity = 2 * a * (n - a) / n + 2 * b * (m - b) / m
                impurity[(v[1:] == v[:-1]) | (n < leaf) | (m < leaf)] = np.inf
                if len(impurity) and impurity.min() < best[0]:
                    i = int(impurity.argmin())
                    best = (impurity[i], f, (v[i] + v[i + 1]) / 2)
        if best[1] >= 0:
            _, f, cut = best
            low = x[rows, f] <= cut
            left, right = node(rows[low], left_depth - 1), node(rows[~low], left_depth - 1)
            nodes[k] = (f, cut, left, right, share)
        return k

    node(np.arange(len(y)), depth)
    return nodes


def is_main(tree, x: np.ndarray) -> np.ndarray:
    """Which rows of features the tree calls main text."""
    f, cut, left, right, share = (np.array(c) for c in zip(*tree))
    at = np.zeros(len(x), np.int64)
    while (inner := f[at] >= 0).any():
        go = np.where(x[np.arange(len(x)), f[at]] <= cut[at], left[at], right[at])
        at = np.where(inner, go, at)
    return share[at] >= 0.5


def main_text(html: str, tree) -> str:
    found = blocks(html)
    if not found:
        return ""
    return " ".join(b[0] for b, keep in zip(found, is_main(tree, features(found))) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    tree = grow(*labelled_blocks())

    def run(batches):
        for batch in slices(batches, column="html"):
            texts = [main_text(h, tree) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    types = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return map_arrow(pages.select("page_id", "url", "html"), run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")


def query(pages: DataFrame) -> DataFrame:
    return extract(pages)
