"""Awkward documents that every operator must take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, kept string, table int, w string"
LONG = "The quick brown fox jumps over the lazy dog. " * 4000


def awkward(spark, more=()):
    """Nulls, empty texts, white space, repeated rows, ties, a long text; columns whose names the operators use themselves."""
    texts = [None, "", "   \n\t ", "one", "one two three four five six seven eight nine ten eleven twelve.", "Same text here. " * 12, "Same text here. " * 12, LONG, "é́ 日本語 😀 tail@mail.example.com", *more]
    rows = [(i, t, None if i % 2 else "en", None, None, None, "k", None, 1, None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], rows[1]], SCHEMA)


def empty(spark):
    return awkward(spark).where("false")
