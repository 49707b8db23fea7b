"""Main text of pages: cuts against all labellings, the parser on broken pages, pages of all kinds, the table's pages against their own markup."""

import html
import itertools
import re

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from framewise.llm import main_text

SMALL = "/root/testdata/sf0.001"
PRIOR = main_text.fit([])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-6, 6), min_size=1, max_size=8), st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.integers(0, 4)), max_size=14))
def test_cut_is_the_best_of_all_labellings(gain, edges):
    edges = [(a, b, w) for a, b, w in edges if max(a, b) < len(gain)]
    value = lambda s: sum(g for g, k in zip(gain, s) if k) - sum(w for a, b, w in edges if s[a] != s[b])
    best = min(itertools.product([False, True], repeat=len(gain)), key=lambda s: (-value(s), sum(s)))
    assert main_text.min_cut(gain, edges) == list(best)


def test_broken_pages():
    texts = lambda page: [b.text for b in main_text.blocks(page)]
    for page in ("", "<", "<p", "<!--", "<!-- x", "<script>x", "</", "<!doctype", "<p class='x"):
        assert texts(page) in ([], ["<"])
    assert texts("a &lt; b<br>c&nbsp;&amp;&#65;&bogus;") == ["a < b c &A&bogus;"]
    assert texts("1 < 2 <b>x</b>y <!-- <p>no</p> --> z") == ["1 < 2 xy z"]
    assert texts("<p title='a > b'>x<p>y</i></p>z") == ["x", "y", "z"]
    assert texts("<title>t</title><style>p{}</style><SCRIPT>var a='</p>'</SCRIPT><noscript><p>n</p></noscript>ok") == ["ok"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-ap =\"'&;b\n", max_size=60))
def test_any_page_is_read(page):
    found = main_text.blocks(page)
    assert len(main_text.label(found, PRIOR)) == len(found)


def test_deep_and_long_pages_take_linear_time():
    assert len(main_text.blocks("<div>" * 50_000 + "x")) == 1
    assert main_text.blocks("<a " * 100_000) == []
    found = main_text.blocks("".join("<div><p>w w w w w w</p></div><p><a>x</a></p>" for _ in range(5000)))
    assert len(main_text.label(found, PRIOR)) == 10_000


PAGE = """<html><body class="has-sidebar"><header><a href=/>Home</a> <h2>My Site</h2></header><div id="cookie-notice"><p>We use cookies to improve your visit. Accept?</p></div>
<form><label>Name</label><input><p>Please fill in all of the fields below and press the button.</p><button>Go</button></form>
<div class="wrap"><div class=post-content><h1>The &quot;Title&quot;</h1><p>First one with <a href=x>a link</a>, and more text that
 is long.<p>Second&nbsp;one &lt;b&gt;.</p><div class="ad">Buy now! This is a very good product and you should get it today.</div><p>Third.</p>
<ul><li>item one</li><li>item two</ul><aside>Related: something else here which is good.</aside></div>
<section id=comments><h3>Comments</h3><article class="comment"><p>I think this is a wonderful text, thanks a lot!</p></article></section></div>
<footer>(c) 2020</footer></body></html>"""
PLAIN = "<div><a href=a>Home</a> <a href=b>News</a></div><div><h1>Some title</h1><p>{0}</p><p>Short.</p><p>{0}</p></div><div><a href=q>Terms</a> <a>Privacy</a></div>"


def test_content_is_told_from_boilerplate():
    def of(page):
        found = main_text.blocks(page)
        return " ".join(b.text for b, k in zip(found, main_text.label(found, PRIOR)) if k)

    assert of(PAGE) == 'The "Title" First one with a link, and more text that is long. Second one <b>. Third. item one item two'
    long = "It goes on like this. " * 30
    assert of(PLAIN.format(long)) == f"Some title {long}Short. {long}".strip()


def test_edges_decide_where_costs_are_even():
    odds = np.zeros(main_text.PATTERNS)
    found = main_text.blocks("<article><p>a b.</p></article>")
    assert main_text.label(found, odds) == [True]
    assert main_text.min_cut([5, -1, 5], [(0, 1, 1), (1, 2, 1)]) == [True, True, True]
    assert main_text.min_cut([5, -3, 5], [(0, 1, 1), (1, 2, 1)]) == [True, False, True]


def test_fit_moves_from_its_prior_to_the_examples():
    pattern = 4
    assert main_text.fit([(pattern, 1, 5000)])[pattern] > PRIOR[pattern] > main_text.fit([(pattern, 0, 5000)])[pattern]
    assert np.abs(main_text.fit([(p, p % 2, 10**12) for p in range(main_text.PATTERNS)])).max() <= main_text.TEXT_BOUND


def test_awkward_rows(spark):
    rows = [(1, None, "u"), (2, "", "u"), (3, PAGE, None), (3, PAGE, None), (None, "<p>plain", "u")]
    df = spark.createDataFrame(rows, "page_id long, html string, Text string").repartition(2)
    got = main_text.extract(df).collect()
    assert len(got) == 5 and sorted(c.lower() for c in got[0].asDict()) == ["blocks", "html", "page_id", "text"]
    assert [r["text"] for r in got if r["page_id"] in (1, 2)] == ["", ""]
    assert len({r["text"] for r in got if r["page_id"] == 3}) == 1
    assert main_text.extract(df.limit(0)).count() == 0


def test_query_returns_the_articles(spark):
    def article(page):
        page = re.sub(r"<(script|style|title)>.*?</\1>", "", page, flags=re.S)
        inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
        return " ".join(html.unescape(re.sub(r"<[^>]*>?", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())

    pages = duckdb.connect().execute(f"SELECT page_id, url, html FROM '{SMALL}/pages.parquet'").fetchall()
    want = sorted((p, u, article(h), len(article(h))) for p, u, h in pages)
    assert sorted((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in main_text.query(spark, SMALL).collect()) == want
