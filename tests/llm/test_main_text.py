"""Main text of pages: blocks against plain rules, the tree against Spark's own, whole pages against what they were made of."""

from __future__ import annotations

import random
import re
from html import unescape

import numpy as np
import pytest

from lexloom.llm import main_text
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def tree(spark):
    return main_text.train(main_text.example_blocks(spark))


def _texts(tree, html):
    blocks = main_text.flat_blocks(html)
    keep = tree.keep(main_text.block_features([blocks]))
    return [b.text for b, k in zip(blocks, keep, strict=True) if k]


def _article(html: str) -> str:
    """The article of a page of the test tables: it holds nothing but h1, p, b and br."""
    inner = html[html.index("<article>") : html.index("</article>")]
    blocks = (" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:article|h1|p)>", inner))
    return "\n".join(b for b in blocks if b)


def test_pages_of_the_tables(spark, tree):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = sorted((r["page_id"], r["url"], _article(r["html"]), len(_article(r["html"]))) for r in pages.collect())
    assert sorted(tuple(r) for r in main_text.extract_main_text(pages, tree).collect()) == want


def test_a_page_with_every_other_part(tree):
    page = """<!doctype html><html><head><title>No</title><style>p{}</style><script>if (a<b) document.write("<p>no</p>")</script></head>
    <body class="has-sidebar"><header><h1>Daily News of the whole wide world and more of it</h1><nav><ul><li><a href=/>Home</a><li><a href=/b>World</a></ul></nav></header>
    <div class="cookie-notice"><p>We use cookies to make this site better for you and for all of our many partners, please agree to it now.</p><button>Agree</button></div>
    <div role=alert>Breaking: a long line on something that happened a moment ago somewhere else entirely, more soon.</div>
    <main><article class=post><header><h1>The  title\n here</h1><p>By A. Writer</p></header>
    <p>First &amp; <b>bold</b> words<br>go on &lt;here&gt; with <a href=x>a link</a>.</p><p>Oh.</p>
    <div class="ad-slot">Buy these fine things today for less money than ever before, an offer for all of our dear readers.</div>
    <aside>A pulled quote that tells again what was said before in the article.</aside>
    <form><label>Mail</label><input name=q><select><option>one</select><p>Sign up for our letter with all of the news of the week.</p></form>
    <blockquote>Quoted words of some length that belong to it.</blockquote><ul><li>one point<li>two points</ul>
    <table><tr><td>cell a<td>cell b</table><figure><img src=x><figcaption>What is seen.</figcaption></figure>
    <!-- <p>no</p> --><noscript>Please turn on scripts</noscript><svg><text>no</text></svg><p>Last words</p>
    <section id=comments><h2>Comments</h2><article><p>I think that this is quite a wonderful article with many good things in it, thank you so much.</p></article></section>
    </article></main><aside class=sidebar><h3>Read on</h3><p>A teaser of quite some length that is about another article on this very site, with all that it has.</p></aside>
    <div id="comment-list"><p>Another reader has a very long opinion on this and shares it here with all of the others, as people do.</p></div>
    <footer><p>&copy; 2024 All rights reserved by all of those who hold them, in this country and in others.</p></footer></body></html>"""
    assert _texts(tree, page) == ["The title here", "By A. Writer", "First & bold words go on <here> with a link.", "Oh.", "Quoted words of some length that belong to it.", "one point", "two points", "cell a", "cell b", "What is seen.", "Last words"]


def test_a_page_that_marks_nothing(tree):
    long = "This sentence has a number of words in it, enough to be taken for text of an article by those who count. " * 2
    page = "<div>" + "".join(f"<div><a href=/{i}>Part {i}</a></div>" for i in range(6)) + f"</div><div><h1>On the words of pages</h1><div>{long}</div><div>{long}</div></div><div><a href=/a>About us</a> <a href=/b>Imprint</a></div>"
    assert _texts(tree, page) == ["On the words of pages", long.strip(), long.strip()]


def test_articles_are_kept_whatever_their_blocks(tree):
    """Blocks of an article of any length and with few links are kept, whatever stands around them; marked others never."""
    rng = random.Random(2)
    rows = []
    for _ in range(20_000):
        words = [rng.choice((1, 2, 5, 10, 30, 100, 5000)) for _ in range(3)]
        rows.append((words[0], rng.choice((0, 0.1, 0.2)), words[1], rng.random(), words[2], rng.random(), 2, 2, 0, rng.randint(0, 1)))
    x = np.array(rows)
    assert tree.keep(x).all()
    for apart in (1, 2):
        x[:, 8], x[:, 1] = apart, np.random.default_rng(1).random(len(x))
        assert not tree.keep(x).any()


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", []),
        (" \n\t ", []),
        ("plain", ["plain"]),
        ("a<b", ["a"]),
        ("a < b", ["a < b"]),
        ("a<p>b</p>c", ["a", "b", "c"]),
        ("<p>a<p>b</div>c", ["a", "b", "c"]),
        ("<p>a</p></p></article>b", ["a", "b"]),
        ("a<!--x--!>b<!-->c<!---->d<!-- e", ["abcd"]),
        ("<p title='a>b' x=\"<p>\">c</p>", ["c"]),
        ("<p a=\">b</p>", ["b"]),
        ("x<p a=\">b</p>y", ["x", "b", "y"]),
        ("<script>a</scriptx></script >b", ["b"]),
        ("<ScRiPt>a", []),
        ("<p>a<script>b", ["a"]),
        ("&amp;amp; &#65;&#x42; &nbsp;&copy &am &quo;", ["&amp; AB © &am &quo;"]),
        ("<b>a</b>b <i>c</i><br>d<wbr>e", ["ab c de"]),
        ("<?php a ?>b</ c>d<![CDATA[e]]>f", ["bdf"]),
        ("<textarea><p>a</textarea>b", ["b"]),
        ("<button>a</button>b<select><option>c", ["b"]),
        ("<div><button>a</div>b", ["b"]),
        ("a\x00b\u2028c", ["a\x00b c"]),
        ("<P>É́ \U0001f600</P>", ["É́ \U0001f600"]),
    ],
)
def test_blocks_of_awkward_markup(html, want):
    assert [b.text for b in main_text.flat_blocks(html)] == want


def test_words_and_links_of_blocks():
    blocks = main_text.flat_blocks("<p>one <a href=x>two three</a> four</p><p><a>five<p>six</a> seven</p><div><a>eight</div>nine<h2>ten</h2>")
    assert [(b.words, b.linked, b.heading) for b in blocks] == [(4, 2, 0), (1, 1, 0), (2, 0, 0), (1, 1, 0), (1, 0, 0), (1, 0, 1)]
    inside = main_text.flat_blocks("<nav>a<article>b</article></nav><form><main>c<article>d<article>e</article></article></main></form><div class=content>f<div class='no-ads'>g</div></div>")
    assert [(b.text, b.inside, b.apart) for b in inside] == [("a", 0, 2), ("b", 0, 2), ("c", 1, 0), ("d", 2, 0), ("e", 2, 2), ("f", 1, 0), ("g", 1, 0)]


def test_neighbours_end_at_the_page():
    pages = [main_text.flat_blocks(h) for h in ("<p>a b<p>c", "", "<p><a>d e f</a><p>g")]
    got = main_text.block_features(pages)[:, [0, 2, 4, 3]]
    assert got.tolist() == [[2, 0, 1, 0], [1, 2, 0, 0], [3, 0, 1, 0], [1, 3, 0, 1]]
    assert main_text.block_features([]).shape == (0, len(main_text.FEATURES))


def test_tree_is_the_trained_one(spark, tree):
    """On the labelled blocks the table of nodes is right where a tree of this size can be; nulls are left out."""
    rows = main_text.examples()
    blocks: dict[int, list] = {}
    for page, _, words, linked, inside, apart, heading, _ in rows:
        blocks.setdefault(page, []).append(main_text.Block("", words, linked, inside, apart, heading))
    keep = tree.keep(main_text.block_features(list(blocks.values())))
    assert np.mean(keep == np.array([r[-1] for r in rows], bool)) > 0.97
    held_out = main_text.examples(400, seed=77)
    blocks = {}
    for page, _, words, linked, inside, apart, heading, _ in held_out:
        blocks.setdefault(page, []).append(main_text.Block("", words, linked, inside, apart, heading))
    keep = tree.keep(main_text.block_features(list(blocks.values())))
    assert np.mean(keep == np.array([r[-1] for r in held_out], bool)) > 0.95
    one = spark.createDataFrame([(1, 0, 5, 0, 2, 0, 0, 1), (1, 1, None, 0, 2, 0, 0, 0)], "page int, block int, words int, linked int, inside int, apart int, heading int, kept int")
    assert main_text.train(one).keep(np.zeros((3, len(main_text.FEATURES)))).all()


def test_rows_without_text_and_further_columns(spark, tree):
    rows = [(1, "u", "<article>a</article>", "x", 1), (1, "u", None, "x", 2), (None, None, "", "y", 3), (2, "v", "<nav>b</nav>", None, None), (3, "w", "<article>" + "<div>" * 3000 + "deep " * 100_000 + "</article>z", "x", 4)]
    got = main_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"), tree).collect()
    deep = " ".join(["deep"] * 100_000)
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([(1, "u", "a", 1), (1, "u", "", 0), (None, None, "", 0), (2, "v", "", 0), (3, "w", deep, len(deep))], "page_id long, url string, text string, n_chars long").collect()))
    assert main_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string"), tree).count() == 0


def test_time_is_in_proportion_to_length():
    import time

    for bad in ("<p", "<p ", "<a href='", "<p a=\"b' ", "<p =",  "<!-", "</", "<div>", "&#", "<p>", '="', "<script", "</div>"):
        began = time.perf_counter()
        main_text.flat_blocks("<div>" + bad * 100_000)
        assert time.perf_counter() - began < 10, bad
