"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is WINDOW consecutive words of a benchmark item (an item of fewer words is one window). Of the K-word hashes
in a window the smallest is its fingerprint. The fingerprint depends on the window's words alone, so a document that
holds a window holds its fingerprint: no shared span of WINDOW words is missed. Documents whose fingerprints meet one of
the benchmark's are candidates; each candidate window is then extended to its full words and compared as text, so chance
hits of short spans do not count. Items shorter than WINDOW are found by the hash of all their words.

The documents' fingerprints, with their places, and the benchmark's meet in a join. Of the benchmark at most
BROADCAST_PRINTS fingerprints and BROADCAST_WINDOWS windows are broadcast; more are dealt out by key and salt, which
moves (fingerprint, place, key) rows and no texts.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import attach, drop_stored, stored, whole

WINDOW = 10
K = 5
#: Fingerprints of the benchmark that are broadcast at most (8 bytes each).
BROADCAST_PRINTS = 2_000_000
#: Windows of the benchmark that are broadcast at most (about 100 bytes each).
BROADCAST_WINDOWS = 200_000

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x made once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _words(text: Column, lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, GAP), "")


def exact_words(text: Column) -> Column:
    """The words, A-Z lower-cased."""
    return _words(text, F.translate(text, _UPPER, _LOWER))


def loose_words(text: Column) -> Column:
    """The words with every letter lower-cased: as many words, equal wherever exact_words are; cheaper.

    The small sigma alone depends on what stands around it, across gaps too, so its two forms are made one.
    """
    return _words(text, F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3")))


def _grams(words: Column, n: int) -> Column:
    """Hash of every n consecutive words."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, n)]))


def window_prints(words: Column, length: int, window: int = WINDOW, k: int = K) -> Column:
    """Fingerprint of every window of `length` words, by its start. Shorter windows than `window` are hashed whole."""
    if length < window or length <= k:
        return _grams(words, length)
    span = length - k + 1
    least = lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - (span - 1), F.lit(0))), lambda x, i: F.least(x, *[F.get(h, i + j) for j in range(1, span)]))
    return _bind(_grams(words, k), least)


def find_contamination(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, k: int = K, broadcast_prints: int = BROADCAST_PRINTS, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per row of documents: its id, n_words, n_hit, n_items (long), items (array of string, sorted), contaminated.

    A word is hit if it lies in an occurrence of a window; items are those with a window in the document. Null and empty
    texts have no words, and match nothing. Rows that repeat an id, or id and text, have a result each; a null id is an id
    like any other. Items without an id or a word are left out, an empty benchmark hits nothing, an empty table of
    documents gives no row. Other columns are not read.
    """
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), exact_words(whole(benchmark[text_col])).alias("w"), loose_words(whole(benchmark[text_col])).alias("lw"))
    items = stored(items.where((F.size("w") > 0) & F.col("item").isNotNull()).select("item", "w", "lw", F.least(F.size("w"), F.lit(window)).alias("len")), "items")
    lengths = sorted(r[0] for r in items.select("len").distinct().collect())  # at most `window` values
    text = whole(documents[text_col])
    docs = documents.select(documents[id_col].alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    none = F.array().cast("array<string>")
    if not lengths:
        zero = F.lit(0).cast("long")
        return docs.select(F.col("id").alias(id_col), F.size(loose_words(F.col("text"))).cast("long").alias("n_words"), zero.alias("n_hit"), zero.alias("n_items"), none.alias("items"), F.lit(False).alias("contaminated"))

    # fingerprints of both sides, by window, meet in a join
    def prints(n: int) -> Column:
        return F.struct(F.lit(n).alias("len"), window_prints(F.col("lw"), n, window, k).alias("fps"))

    own = items.select(F.explode(functools.reduce(lambda c, n: c.when(F.col("len") == n, prints(n)["fps"]), lengths[1:], F.when(F.col("len") == lengths[0], prints(lengths[0])["fps"]))).alias("fp")).distinct()
    own = stored(own, "prints")
    every = docs.select("id", "th", loose_words(F.col("text")).alias("lw")).select("id", "th", F.explode(F.array(*[prints(n) for n in lengths])).alias("x"))
    every = every.select("id", "th", F.col("x.len").alias("len"), F.posexplode("x.fps").alias("at", "fp"))
    places = attach(every, own, ["fp"], "left_semi", bound=broadcast_prints)
    places = stored(places.groupBy("id", "th").agg(F.collect_set(F.struct("at", "len")).alias("places")), "places")

    # candidates become text and are held against the benchmark's windows; first their keys pick the texts, then the places meet those
    held = attach(docs, stored(places.select("id", "th"), "candidates"), ["id", "th"], "left_semi")
    spans = _bind(exact_words(F.col("text")), lambda w: F.transform("places", lambda x: F.struct(x["at"].alias("at"), x["len"].alias("len"), F.array_join(F.slice(w, x["at"] + 1, x["len"]), " ").alias("span"))))
    hits = attach(held, places, ["id", "th"], "inner").select("id", "th", F.explode(spans).alias("x")).select("id", "th", "x.*")
    starts = F.sequence(F.lit(0), F.size("w") - F.col("len"))
    known = items.select("item", "len", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, F.col("len")), " "))).alias("span"))
    known = stored(known.groupBy("span", "len").agg(F.sort_array(F.collect_set("item")).alias("items")), "windows")
    # rows of equal id and text are one here: their spans are equal
    hits = attach(hits, known, ["span", "len"], "inner", bound=BROADCAST_WINDOWS).groupBy("id", "th", "at", "len").agg(F.first("items").alias("items"))
    hits = hits.groupBy("id", "th").agg(F.collect_list(F.struct("at", "len")).alias("at"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = hits.select("id", "th", "items", F.size(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1))))).cast("long").alias("n_hit"))
    hits = stored(hits, "hits")
    for used in (places, known, items):
        drop_stored(used)
    out = attach(docs.select("id", "th", F.size(loose_words(F.col("text"))).cast("long").alias("n_words")), hits, ["id", "th"])
    n_hit, found = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", none)
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), found.alias("items"), (n_hit > 0).alias("contaminated"))
