"""Main text: pages with known articles, and rules one by one."""

import html as entities
import re
from collections import Counter

import pytest

from nbquarry.llm import html
from nbquarry.llm.queries import QUERIES

LONG = "The cat is on the mat and the dog was in the house with all of the food that they had for the day. " * 3
TABLE = "Oslo 12 13 | Bergen 14 15 | Narvik 9 11 | " * 8
OTHER = "Products services imprint contact " * 8


@pytest.mark.parametrize("page, expected", [
    (None, []),
    ("", []),
    ("<html><body></body></html>", []),
    (f"<p>{LONG}</p>", [LONG.strip()]),
    (f"<p>{OTHER}</p>", []),
    (f"<article><p>{TABLE}", [TABLE.strip()]),
    ("<article><h1>Title</h1><p>Short.</p></article>", ["Title", "Short."]),
    ("<article><p>a &amp; b &lt;c&gt; &eacute;&#233; 1 < 2<br>x\n\t y</p></article>", ["a & b <c> éé 1 < 2 x y"]),
    ("<article>one <b>two</b>three<p>four<div>five</div></article>", ["one twothree", "four", "five"]),
    ('<header><p>Site</p></header><main><header><h1>Head</h1></header><p>Text</p></main>', ["Head", "Text"]),
    ('<article><p>x</p><div class="post-comments"><p>' + LONG + "</p></div><form>y</form><aside>z</aside></article>", ["x"]),
    ('<article><p>x</p><div style="display: none">y</div><div hidden>z</div></article>', ["x"]),
    ('<article><script>var t="</p>";</script><style>p{}</style><!-- no <p> --><p>x</p><noscript>n</noscript></article>', ["x"]),
    ('<article><p>x</p><p><a href="/a>b">many links here</a> and</p></article>', ["x"]),
    ('<nav><a href="/">Home</a></nav><div class="cookie-notice">' + LONG + "</div><p>" + LONG + "</p><footer>f</footer>", [LONG.strip()]),
    (f"<p>Near</p><p>{LONG}</p><p>{OTHER}</p><p>Far</p>", ["Near", LONG.strip()]),
    ("<article><p>unclosed <b>tag <!-- comment", ["unclosed tag"]),
    ("<article><p>x<script>never closed <p>y", ["x"]),
    ('<article><p title="a > b">x</p><p title=">y', ["x", "y"]),
    ("<ARTICLE><P>Upper</P></ARTICLE>", ["Upper"]),
    ("<article><ul><li>a<li>b<ul><li>c</ul></ul></article>", ["a", "b", "c"]),
    ("plain text only", ["plain text only"][:0]),
    # A teaser is marked as an article, the main text is not.
    (f'<article><a href="/x">Read on here</a></article><div><p>{LONG}</p><p>Next.</p><p>{LONG}</p></div>', [LONG.strip(), "Next.", LONG.strip()]),
    (f"<div><p>{LONG}</p></div><article><p>More of this.</p></article>", [LONG.strip(), "More of this."]),
    # Notices inside an article.
    (f"<article><p>{LONG}</p><p>Subscribe to our newsletter today</p><p>Share this Tweet Print</p><p>Head</p><p>{LONG}</p><p>Products services imprint contact 2020</p></article>",
     [LONG.strip(), "Head", LONG.strip()]),
    (f"<article><p>{LONG}</p><p>{TABLE}</p><p>We share what we know, and print it.</p></article>", [LONG.strip(), TABLE.strip(), "We share what we know, and print it."]),
    # What is not closed swallows nothing.
    ("<article><p>x</p><button>Go<p>y</p><object data=1><p>z</p></article>", ["x", "Go", "y", "z"]),
    ("<article><p>x</p><button>a<p>y</p><button>b</button><svg><text>t</text></svg><select><option>o</select><p>z</p></article>", ["x", "a", "y", "z"]),
    ("<article><p>x</p><template>a<template>b</template>c</template><p>z</p></article>", ["x", "z"]),
])
def test_rules(page, expected):
    assert html.main_blocks(page) == expected


def test_long_and_broken_pages_take_linear_time():
    for part in ("<", "<a ", '<a b="', "<!--", "</", "<p", "&", "<script>", "<div>", '<p class="', "<button>", "<svg></svg>", "</object>"):
        html.main_blocks(part * 50_000)


def test_query_finds_the_articles(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = QUERIES["op4_html"](spark, sf).collect()
    assert len(found) == len(pages)
    for r in found:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        parts = re.sub(r"<(?!br)[^>]*>", "\0", article).replace("<br>", " ").split("\0")
        words = [w for p in parts for w in entities.unescape(p).split()]
        assert r.text.split() == words and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_pages_without_article_tags():
    """The same pages with their tags renamed: stop words, lengths and neighbours find the text alone."""
    import pandas as pd

    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    wanted = got = right = 0
    for page in pages:
        expected = " ".join(html.main_blocks(page)).split()
        found = " ".join(html.main_blocks(re.sub(r"<(/?)(article|main)\b", r"<\1div", page))).split()
        wanted, got = wanted + len(expected), got + len(found)
        right += sum((Counter(expected) & Counter(found)).values())
    assert right >= 0.85 * wanted and right == got


def test_table(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "<article><p>x</p></article>", "b")]
    found = html.extract(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert sorted((r.page_id is None, r.text, r.n_chars) for r in found.collect()) == [(False, "", 0), (False, "", 0), (True, "x", 1)]
    assert html.extract(spark.createDataFrame([], "html string")).count() == 0
