"""Main text of pages against planted layouts and an independent reading of the article elements."""

import time
from html.parser import HTMLParser

import numpy as np
import pytest

from quarry.llm import html_text

TREE = html_text.grow(*html_text.labelled_blocks())
LONG = " ".join(f"word{k}, and more of it" for k in range(12))
LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "About us", "Contact", "Sport", "Shop"))


def _text(page):
    return html_text.main_text(page, TREE)


class Article(HTMLParser):
    """The white-space normalised text inside article elements, read by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("p", "br", "h1", "li", "div"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in ("p", "h1", "li", "div"):
            self.out.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.out.append(data)


def test_every_page_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.query(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        reader = Article()
        reader.feed(r.html)
        reader.close()
        want = " ".join("".join(reader.out).split())
        assert got[r.page_id] == (r.url, want, len(want))


PLANTED = {
    "semantic": f"""<html><body><header><h1>The Daily</h1><p>All the news</p></header><nav><ul>{LINKS}</ul></nav>
        <main><article><header><h1>A title</h1></header><p>{LONG}</p><aside><p>See also {LONG}</p></aside><ul><li>one point<li>two points</ul>
        <form><label>Your mail</label><input><button>Send now</button></form><p>Short end.</p></article>
        <section id="comments"><article class="comment"><p>{LONG}</p></article></section></main>
        <footer><p>&copy; The Daily</p></footer></body></html>""",
    "classes": f"""<body class="has-sidebar"><div id="masthead">The Daily</div><div class="main-nav"><ul>{LINKS}</ul></div><div class="cookie-notice">
        We use {LONG}</div><div class="page-wrap sidebar-wrap"><div class="entry-content"><div class="entry-header"><h1>A title</h1></div><p>{LONG}</p>
        <div class="adSlot">Buy it now</div><ul><li>one point</li><li>two points</li></ul><div class="social share">Share this</div><p>Short end.</p></div>
        <div id="sidebar"><p>{LONG}</p></div><div class="reader-comments"><p>{LONG}</p></div></div><div class="site-footer">About</div>""",
    "form around the page": f"""<form id="aspnet"><div class="menu"><ul>{LINKS}</ul></div><main><h1>A title</h1><p>{LONG}</p><ul><li>one point
        </li><li>two points</ul><p>Short end.</p></main><div role="contentinfo">All rights</div></form>""",
    "hidden parts": f"""<article><h1>A title</h1><p>{LONG}<script>if (a < b) document.write("<p>no</p>")</script></p><style>p > b {{}}</style>
        <div hidden>secret words</div><div style="display: none">{LONG}</div><ul><li>one point<li>two points</ul><!-- <p>never</p> --><select>
        <option>One<option>Two</select><p>Short end.</p><noscript>Turn it on</noscript></article>""",
}


@pytest.mark.parametrize("layout", sorted(PLANTED))
def test_planted_layouts(layout):
    assert _text(PLANTED[layout]) == f"A title {LONG} one point two points Short end."


def test_unmarked_page_is_told_by_words_and_links():
    page = f"<div><ul>{LINKS}</ul></div><div><h1>A title</h1><p>{LONG}</p><p>{LONG}</p></div><div><ul>{LINKS}</ul></div>"
    assert _text(page) == f"A title {LONG} {LONG}"


def test_references_and_white_space():
    page = "<article><p> a&nbsp;b\n\t c&amp;amp; &lt;i&gt; &#233;&#x1F600; 5 < 6 &unknown; x<b>y</b>z<br>w </p></article>"
    assert _text(page) == "a b c&amp; <i> é😀 5 < 6 &unknown; xyz w"


def test_broken_markup():
    assert _text("") == "" and _text("<article>") == "" and _text("<p") == ""
    assert _text(f"<article><p>{LONG}<!-- open <p>{LONG}</p>") == LONG
    assert _text(f"<article><p>{LONG}<script>var x = 1; </p>") == LONG
    assert _text(f"<article><p title='a > b' class=\"x>y\">{LONG}<p><b>two</b></i></div></p></section> three<a href=\"") == f"{LONG} two three"
    assert _text(f"<article><table><tr><td>{LONG}</div><td>next cell</table><p>end</p></article>") == f"{LONG} next cell end"
    assert _text(f"<article><!--><p>{LONG}</p></></article>") == LONG


def test_hostile_and_very_long_pages_take_linear_time():
    begin = time.time()
    for page in ("<b>" * 200_000 + "</u>" * 200_000, "<div>" * 100_000 + "</p>" * 100_000, "<" * 500_000, "<a " * 200_000, "<!--" * 200_000,
                 "<p>" + "</a <b " * 100_000, "&" * 500_000):
        _text(page)
    whole = " ".join(f"w{k}" for k in range(400_000))
    assert _text(f"<article><p>{whole}</p></article>") == whole
    assert time.time() - begin < 60


def test_tree_holds_on_other_pages_of_the_same_kinds():
    x, y = html_text.labelled_blocks(300, seed=5)
    assert (html_text.is_main(TREE, x) == y).mean() > 0.99
    assert TREE == html_text.grow(*html_text.labelled_blocks())


def test_walk_equals_a_plain_walk():
    x, _ = html_text.labelled_blocks(40, seed=6)

    def walk(row, k=0):
        f, cut, left, right, share = TREE[k]
        return share >= 0.5 if f < 0 else walk(row, left if row[f] <= cut else right)

    assert html_text.is_main(TREE, x).tolist() == [walk(row) for row in x]


def test_first_split_is_the_best_of_all():
    r = np.random.default_rng(3)
    x, y = r.integers(0, 9, (60, 3)).astype(float), r.random(60) < 0.4

    def cost(f, cut):
        parts = [y[x[:, f] <= cut], y[x[:, f] > cut]]
        return sum(2 * p.mean() * (1 - p.mean()) * len(p) for p in parts) if min(map(len, parts)) >= 5 else np.inf

    f, cut, *_ = html_text.grow(x, y, depth=1)[0]
    assert cost(f, cut) == pytest.approx(min(cost(g, c + 0.5) for g in range(3) for c in range(8)))


def test_nulls_repeats_and_clashing_columns(spark):
    page = f"<article><p>{LONG}</p></article>"
    rows = [(1, "u", page, "x", 9, "y"), (1, "u", page, "x", 9, "y"), (None, None, page, None, None, None), (2, "u", None, "x", 1, "y"), (3, "u", "", "x", 1, "y"),
            (4, "u", "plain words only", "x", 1, "y"), (5, "u", f"<nav>{LINKS}</nav>", "x", 1, "y")]
    schema = "page_id long, url string, html string, text string, n_chars int, `a.b` string"
    got = sorted((tuple(r) for r in html_text.query(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got[:2] == [(1, "u", LONG, len(LONG))] * 2
    assert (None, None, LONG, len(LONG)) in got
    assert {r[0]: r[2:] for r in got if r[0] in (2, 3, 5)} == {k: ("", 0) for k in (2, 3, 5)}
    empty = html_text.query(spark.createDataFrame([], schema))
    assert empty.collect() == [] and empty.columns == ["page_id", "url", "text", "n_chars"]
