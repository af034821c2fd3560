"""Text functions on single values."""

import uuid

import pytest
from pyspark.sql import functions as F

from lexloom import functions as X
from lexloom.functions import text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "line"),
    [("a\tb", "ab"), ("a\u00a0b", "a b"), ("so\u00adft", "soft"), ("a\ufffdb", "a b"), ("ﬁn", "fin"), ("  a   b ", "a b"), ("", ""), (None, None), ("é́\x07", "é́")],
)
def test_lines_are_normalised(spark, raw, line):
    df = spark.createDataFrame([(raw,)], "line string")
    assert X.normalize_lines(df).first()["line"] == line


@pytest.mark.parametrize(("x", "drop"), [("12", True), ("- 12 -", True), ("Halaman 3", True), ("12345", False), ("|¦ ~~", True), ("", True), ("text", False)])
def test_noise(spark, x, drop):
    assert one(spark, x, X.is_noise) is drop


@pytest.mark.parametrize(
    ("q", "normal", "suffix"),
    [("PASAL12A ayat (3)", "Pasal 12A Ayat 3", text.QUESTION_WITH_REFERENCE), ("ayat ( 5 )x", "Ayat 5x", text.QUESTION_WITH_REFERENCE), ("  upah  minimum ", "upah minimum", text.QUESTION_WITHOUT_REFERENCE)],
)
def test_questions(spark, q, normal, suffix):
    assert one(spark, q, X.normalize_query) == normal
    assert one(spark, q, X.rewrite_query) == normal + suffix


@pytest.mark.parametrize(("q", "ok"), [("", False), ("   ", False), ("a", True), ("a" * 2000, True), ("a" * 2001, False), (None, False)])
def test_question_length(spark, q, ok):
    assert one(spark, q, X.question_ok) is ok


@pytest.mark.parametrize(
    ("reply", "answer"),
    [("<think>x</think>yes", "yes"), ("yes<think>never closed", "yes"), ("# **A**\n\n\n\n__b__", "A\n\nb"), ("</think>k", "k")],
)
def test_answers(spark, reply, answer):
    assert one(spark, reply, X.clean_answer) == answer


@pytest.mark.parametrize(("reply", "scope"), [('{"is_labor_law": true}', True), ('```json\n{"is_labor_law": false}\n```', False), ('so {"is_labor_law": true}.', True), ('{"is_labor_law": "true"}', None), ("no", None)])
def test_scope(spark, reply, scope):
    assert one(spark, reply, X.parse_scope) is scope


def test_citations(spark):
    assert one(spark, "a", lambda x: X.append_citations(x, F.lit(2))) == "a\n\nSumber: [1], [2]"
    assert one(spark, "a [1]", lambda x: X.append_citations(x, F.lit(2))) == "a [1]"


def test_identifiers(spark):
    assert one(spark, "UU No. 13/UU 13 (2003).PDF", X.document_id) == "uu_13_2003"
    assert one(spark, "---.pdf", X.document_id) == "document"
    assert one(spark, "i1:c1", X.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_URL, "i1:c1"))
    assert one(spark, "5", lambda x: X.page_label(x.cast("int"), F.lit(7))) == "5-7"
    assert one(spark, None, lambda x: X.page_label(x.cast("int"), x.cast("int"))) == "None"
    assert [one(spark, str(n), lambda x: X.format_size(x.cast("long"))) for n in (1, 1536, 3 * 1048576)] == ["1 KB", "2 KB", "3.0 MB"]
    assert [one(spark, str(n), lambda x: X.percent(x.cast("long"), F.lit(8))) for n in (1, 4, 5)] == [12, 50, 62]
    assert one(spark, "0", lambda x: X.percent(x.cast("long"), F.lit(0))) == 0


def test_broken_text(spark):
    assert one(spark, "a (cid:3) b", X.suspicious_text) is True
    assert one(spark, "##%% ^^&& !!@@ ##%% ^^&& !!@@ ##%% ^^&& !!@@ ##%% ^^&& !!@@", X.suspicious_text) is True
    assert one(spark, "an ordinary sentence that is long enough to be judged by its letters", X.suspicious_text) is False
    assert one(spark, "  ", X.suspicious_text) is False


def test_error_detail(spark):
    assert one(spark, '{"detail": "d", "error": "e"}', X.error_detail) == "d"
    assert one(spark, '{"error": "e"}', X.error_detail) == "e"
    assert len(one(spark, "x" * 900, X.error_detail)) == 500


def test_case_folding_is_full(spark):
    """Every letter that Java and Python put in lower case alike folds as Python does, alone and within words."""
    letters = [chr(c) for c in range(0x20, 0x1F000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    df = spark.createDataFrame([(c, f"A{c}b {c}") for c in letters], "c string, x string")
    rows = df.select("c", "x", F.lower("c").alias("low"), text.casefold(F.col("x")).alias("y")).collect()
    same = [r for r in rows if r["low"] == r["c"].lower()]
    assert len(same) > 0.99 * len(rows)
    final = lambda s: s.replace("\u03c2", "\u03c3")
    assert [r["c"] for r in same if r["y"] != final(r["x"].casefold())] == []
    assert spark.createDataFrame([("Stra\u00dfe  STRASSE \ufb01N",)], "x string").select(text.line_key(F.col("x"))).first()[0] == "strasse strasse fin"
