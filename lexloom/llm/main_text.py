"""Main text of web pages: flat blocks of text, judged by a decision tree that sees each block's words and links and its neighbours'.

A page is cut into blocks at its block elements; inline markup, scripts and styles fall away. Of each block the tree sees
the words and the share of them in links, those two numbers of the blocks before and after, whether it is a heading, how
far inside an article it is (2: article, 1: main part, 0: neither), the most of that on the page, and whether it is in a
menu, footer, form, comment and the like (0 to 2, by elements, roles and names). The tree is Spark's, trained on a small
table of labelled blocks. It goes to the tasks as a table of nodes; whole pages are cut and judged there, in one pass
without a shuffle.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import whole

# HTML's elements that begin a block of their own.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements whose content is no markup, up to their end tag.
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
#: Elements whose content is not text of the page.
SILENT = frozenset("audio button canvas datalist object select svg template video".split())
#: An element of the first set ends an open one of the second, if that is innermost.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
APART = frozenset("aside dialog footer menu nav search".split())
# Words in class names and ids by which pages tell their parts.
COMMENT_NAMES = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
APART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsbygoogle alert alerts aside banner banners bottombar breadcrumb breadcrumbs colophon consent cookie cookies"
    " copyright footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos promoted promotion recommended"
    " related register search share sharing sidebar sidenav signin signup skip social sponsor sponsored sponsors submenu subscribe subscription toolbar topbar topnav trending widget widgets".split()
)
ARTICLE_NAMES = frozenset("article articlebody entry hentry post story".split())
MAIN_NAMES = frozenset("content main maincontent".split())
#: With one of these a class name speaks of another part of the page.
ELSEWHERE = frozenset("has no with without".split())
APART_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status".split())

_VALUES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))*+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)({_VALUES})>|<(/?)([a-zA-Z][^\s/>]*+)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "inside", "most_inside", "apart", "heading")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    inside: int
    apart: int
    heading: int


class _Open(NamedTuple):
    """An open element: what holds for the text in it."""

    tag: str
    inside: int = 0
    apart: int = 0
    heading: int = 0
    silent: bool = False


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'").lower() for k, v in reversed(_ATTRIBUTE.findall(raw))} if raw.strip(" /") else {}


def _names(attributes: dict[str, str]) -> set[str]:
    out: set[str] = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = set(re.findall("[a-z]+", name))
        if not words & ELSEWHERE:
            out |= words
    return out


def _enter(tag: str, attributes: dict[str, str], around: _Open, in_article: bool) -> _Open:
    """What holds in an element, by its name, role and names. An article within an article is a reader's, as HTML has it."""
    inside, apart, role, names = around.inside, around.apart, attributes.get("role", ""), _names(attributes)
    is_article, is_main = tag == "article" or role == "article", tag == "main" or role == "main"
    if tag in APART or role in APART_ROLES or names & COMMENT_NAMES and tag not in ("html", "body") or is_article and in_article:
        apart = 2
    elif is_article or is_main:
        inside, apart = (max(inside, 1 + is_article), 0) if apart < 2 else (inside, apart)
    elif tag in ("form", "fieldset") or tag == "header" and not inside or "header" in names and not inside and tag not in HEADINGS:
        apart = max(apart, 1)
    elif tag not in ("html", "body"):
        if names & APART_NAMES:
            apart = max(apart, 1)
        elif not apart:
            inside = max(inside, 2 * bool(names & ARTICLE_NAMES), bool(names & MAIN_NAMES))
    return _Open(tag, inside, apart, around.heading or int(tag in HEADINGS), around.silent or tag in SILENT)


def flat_blocks(html: str) -> list[Block]:
    """The blocks of a page that have text, in order; character references decoded, white space made one space."""
    out: list[Block] = []
    stack, counts = [_Open("")], Counter()
    parts: list[str] = []
    linked, link, pos = 0, 0, 0  # link: the depth of the stack where the open link began

    def end_block() -> None:
        nonlocal linked
        words = "".join(parts).split()
        if words:
            now = stack[-1]
            out.append(Block(" ".join(words), len(words), min(linked, len(words)), now.inside, now.apart, now.heading))
        parts.clear()
        linked = 0

    def leave() -> None:
        nonlocal link
        counts[stack.pop().tag] -= 1
        link = link if link <= len(stack) else 0

    while token := _TOKEN.match(html, pos):
        pos = token.end()
        text = token[6]
        if text is not None:
            if not stack[-1].silent:
                parts.append(unescape(text))
                linked += len(parts[-1].split()) if link else 0
            continue
        tag, ends, raw = (token[2] or token[5] or "").lower(), bool(token[1] or token[4]), token[3] or ""
        if tag in RAW and not ends:
            end = _END[tag].search(html, pos)
            pos = end.start() if end else len(html)
        elif tag == "a":
            link = 0 if ends else len(stack)
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS or tag in SILENT:
            if tag in BLOCKS:
                end_block()
            if tag in ("html", "head", "hr") or ends and tag == "body":
                continue
            if not ends:
                if tag in BLOCKS and stack[-1].tag == "p":
                    leave()
                while stack[-1].tag in CLOSES.get(tag, ()):
                    leave()
                stack.append(_enter(tag, _attributes(raw), stack[-1], counts["article"] > 0))
                counts[tag] += 1
            elif counts[tag]:
                while stack[-1].tag != tag:
                    leave()
                leave()
    end_block()
    return out


def block_features(pages: list[list[Block]]) -> np.ndarray:
    """A row of FEATURES for each block of the pages, one page after the other."""
    sizes = np.array([len(p) for p in pages], np.int64)
    plain = np.array([b[1:] for p in pages for b in p], np.float64).reshape(-1, 5)
    words, density = plain[:, 0], plain[:, 1] / np.maximum(plain[:, 0], 1)
    first, last = np.zeros(len(words), bool), np.zeros(len(words), bool)
    ends = np.cumsum(sizes)[sizes > 0]
    first[ends - sizes[sizes > 0]], last[ends - 1] = True, True
    before = lambda x: np.where(first, 0, np.roll(x, 1))
    after = lambda x: np.where(last, 0, np.roll(x, -1))
    page = np.repeat(np.arange(len(sizes)), sizes)
    most = np.zeros(len(sizes))
    np.maximum.at(most, page, plain[:, 2])
    return np.stack([words, density, before(words), before(density), after(words), after(density), plain[:, 2], most[page], plain[:, 3], plain[:, 4]], axis=1)


class BlockTree:
    """A decision tree as a table of nodes (feature, threshold, left, right, kept); a feature below 0 marks a leaf."""

    def __init__(self, nodes: list[tuple[int, float, int, int, bool]]) -> None:
        feature, threshold, left, right, kept = zip(*nodes, strict=True)
        self.feature, self.left, self.right = (np.array(x, np.int64) for x in (feature, left, right))
        self.threshold, self.kept = np.array(threshold, np.float64), np.array(kept, bool)

    def keep(self, features: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(features), np.int64), np.arange(len(features))
        while (self.feature[at] >= 0).any():
            value = features[rows, np.maximum(self.feature[at], 0)]
            at = np.where(self.feature[at] < 0, at, np.where(value <= self.threshold[at], self.left[at], self.right[at]))
        return self.kept[at]


def train(labelled: DataFrame, *, depth: int = 8) -> BlockTree:
    """A tree from labelled blocks: page, block (its place), words, linked, inside, apart, heading, kept (0 or 1).

    The table is one that people label: small, and gathered by page for the neighbours. Rows with a null in any column are left out.
    """
    by_place, page = Window.partitionBy("page").orderBy("block"), Window.partitionBy("page")
    rows = labelled.dropna().withColumn("density", F.col("linked") / F.greatest("words", F.lit(1)))
    for column in ("words", "density"):
        rows = rows.withColumn(f"{column}_before", F.lag(column, 1, 0).over(by_place)).withColumn(f"{column}_after", F.lead(column, 1, 0).over(by_place))
    rows = rows.withColumn("most_inside", F.max("inside").over(page))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.select(*FEATURES, F.col("kept").cast("double").alias("label")))
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=128, minInstancesPerNode=3, minInfoGain=1e-4, seed=11).fit(rows.coalesce(1))
    nodes: list[tuple[int, float, int, int, bool]] = []

    def add(node) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0, node.prediction() > 0.5))
        if node.subtreeDepth() > 0:
            split = node.split()
            left, right = add(node.leftChild()), add(node.rightChild())
            nodes[at] = (split.featureIndex(), float(split.threshold()), left, right, False)
        return at

    add(model._java_obj.rootNode())
    return BlockTree(nodes)


def examples(pages: int = 240, seed: int = 5) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """Labelled blocks of pages made up by rule: (page, block, words, linked, inside, apart, heading, kept).

    Every fourth page marks its article, its main part, both, or neither; half of those that mark nothing have their other
    parts in marked elements. Where nothing tells them apart, what is not article is short or linked.
    """
    rng = random.Random(seed)
    out = []
    for page in range(pages):
        core, marked = ((2, True), (1, True), (2, True), (0, page % 8 < 4))[page % 4]
        around = 1 if page % 4 == 2 else 0
        rows: list[tuple[int, int, int, int, int, int]] = []

        def put(words: int, linked: int, inside: int, apart: int, heading: int, kept: int, rows=rows) -> None:
            rows.append((words, linked, inside, apart, heading, kept))

        def links(n: int, apart: int, inside: int = 0) -> None:
            for _ in range(n):
                w = rng.randint(1, 6)
                put(w, w, inside, apart, 0, 0)

        def other(apart: int, most: int, inside: int = 0) -> None:
            w = rng.randint(2, most if apart or core else 7)
            put(w, rng.randint(0, w) if rng.random() < 0.4 else 0, inside, apart, 0, 0)

        apart = 2 if marked else 0
        links(rng.randint(2, 9), apart)
        for _ in range(rng.randint(0, 3)):
            other(rng.choice((1, 1, 0)) if marked else 0, 45)
        if rng.random() < 0.8:
            put(rng.randint(1, 14), 0, around or core if rng.random() < 0.5 else core, 0, 1, 1)
        for n in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.75:
                short = rng.random()
                w = rng.randint(1, 5) if short < (0.3 if core else 0.1) else rng.randint(5, 20) if short < 0.5 and (core or n) else rng.randint(20, 200)
                linked = rng.choice((0, 0, 0, 0, w // 5, w // 5, w // 2, w) if core else (0, 0, 0, w // 5))
                put(w, rng.randint(0, linked), core, 0, 0, 1)
            elif kind < 0.82:
                put(rng.randint(1, 9), 0, core, 0, 1, 1)
                put(rng.randint(15, 120), 0, core, 0, 0, 1)
            elif kind < 0.87 and core:
                w = rng.randint(1, 12)
                put(w, w, core, 0, 0, 1)  # a paragraph that is a link
                put(rng.randint(1, 40), 0, core, 0, 0, 1)
            elif kind < 0.95 and marked:
                other(rng.choice((1, 2)), 60, core)
            elif core:
                links(rng.randint(3, 7), 0, core)  # a list of links within the article
                put(rng.randint(8, 90), 0, core, 0, 0, 1)
        if around:
            for _ in range(rng.randint(0, 2)):
                other(0, 30, around)
        if marked:
            for _ in range(rng.randint(0, 5)):
                other(2, 120, rng.choice((0, core)))
                if rng.random() < 0.3:
                    put(rng.randint(1, 5), 0, 0, 2, 1, 0)
        for _ in range(rng.randint(0, 2)):
            if core:
                other(0, 60)
        links(rng.randint(1, 6), apart)
        for _ in range(rng.randint(1, 3)):
            other(apart, 40)
        out += [(page, i, *r) for i, r in enumerate(rows)]
    return out


def example_blocks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(examples(), "page int, block int, words int, linked int, inside int, apart int, heading int, kept int")


def extract_main_text(pages: DataFrame, tree: BlockTree | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: its id, url, text (kept blocks in order, joined by line ends) and n_chars (code points).

    A null or empty page, or one without text that is kept, has the empty text. Rows with repeated or missing ids are
    judged each by itself. Markup may be cut off or wrong anywhere: a tag that never ends is dropped with what follows,
    an end tag without a beginning ends no more than a block, elements left open end with those around them. Pages of any length are
    taken whole. Further columns are left out. Without a tree one is trained from `example_blocks`.
    """
    tree = tree or train(example_blocks(pages.sparkSession))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), whole(F.col(f"`{html_col}`")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                cut = [flat_blocks(html.as_py()) for html in part.column("html")]
                kept = iter(tree.keep(block_features(cut)).tolist())
                texts = ["\n".join([b.text for b in page if next(kept)]) for page in cut]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
