"""Normalisation and classification of extracted lines and of questions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

__all__ = [
    "HEADINGS", "IGNORED_HEADERS", "casefold", "dropped_by_cleaning", "SPLIT_LINES", "collapsed", "heading", "is_noise", "is_page_marker", "is_structural", "line_key",
    "normalize_ascii", "normalize_lines", "normalize_query", "normalize_questions", "question_ok", "rewrite_query", "split_lines", "stripped", "suspicious_text", "text_length",
]

# Patterns and word lists of the documents' language.
IGNORED_HEADERS = ("PRESIDEN", "REPUBLIK INDONESIA", "PRESIDEN REPUBLIK INDONESIA")
HEADINGS = {
    "BAB": r"(?i)^BAB\s+([IVXLCDM]+)$",
    "BAGIAN": r"(?i)^Bagian\s+(.+)$",
    "PARAGRAF": r"(?i)^Paragraf\s+(\d+)$",
    "PASAL": r"(?i)^Pasal\s+(\d+[A-Za-z]?)(?:\s+(.+))?$",
    "AYAT": r"^\((\d+)\)\s*(.*)$",
}
NOISE_SIGNS = "[|¦~_=*•·….,;:]"
QUESTION_WITH_REFERENCE = " ketentuan dalam peraturan ketenagakerjaan"
QUESTION_WITHOUT_REFERENCE = " menurut peraturan ketenagakerjaan Indonesia"

#: Line ends as Python's splitlines sees them.
SPLIT_LINES = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def split_lines(x: Column) -> Column:
    """The lines of a text, also an empty one after the last line end. Most texts have no other line end than \\n."""
    other = x.rlike("[\r\x0b\x0c\x1c\x1d\x1e\x85]") | F.contains(x, F.lit("\u2028")) | F.contains(x, F.lit("\u2029"))
    return F.when(other, F.split(x, SPLIT_LINES, -1)).otherwise(F.split(x, "\n", -1))


def stripped(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapsed(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return stripped(F.regexp_replace(x, r"(?U)\s+", " "))


def text_length(x: Column) -> Column:
    """Code points after collapsing white space."""
    return F.length(collapsed(x)).cast("long")


def normalize_ascii(x: Column) -> Column:
    """Line normalisation where it needs no Unicode tables: control signs go (a TAB too), white space collapses.

    Most lines have neither control signs nor two blanks together, and finding that out is cheaper than replacing.
    """
    bare = F.when(x.rlike(r"[\x00-\x1F\x7F]"), F.regexp_replace(x, r"[\x00-\x1F\x7F]", "")).otherwise(x)
    return F.trim(F.when(F.contains(bare, F.lit("  ")), F.regexp_replace(bare, " +", " ")).otherwise(bare))


def _nfkc(line: str) -> str:
    line = unicodedata.normalize("NFKC", line).replace("\u00a0", " ").replace("\u00ad", "").replace("\ufffd", " ")
    return " ".join("".join(c for c in line if unicodedata.category(c)[0] != "C").split())


@F.pandas_udf(StringType())
def _normalize_any(lines: pd.Series) -> pd.Series:
    return lines.map(_nfkc, na_action="ignore")


def normalize_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """NFKC, no soft hyphens, no control signs, collapsed white space.

    Spark has no NFKC, so a vectorised UDF does it; it gets null for rows of plain ASCII, which keep to built-in functions.
    """
    other = F.when(F.col(column).rlike(r"[^\x00-\x7F]"), F.col(column))
    rows = lines.withColumn("__other", other).withColumn("__new", _normalize_any(F.col("__other")))
    return rows.withColumn(column, F.when(F.col("__other").isNotNull(), F.col("__new")).otherwise(normalize_ascii(F.col(column)))).drop("__other", "__new")


@F.pandas_udf(StringType())
def _nfkc_any(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalize_questions(questions: DataFrame, column: str = "question") -> DataFrame:
    """Questions in NFKC; those of plain ASCII are as they are and keep to built-in functions."""
    plain = F.coalesce(~F.col(column).rlike(r"[^\x00-\x7F]"), F.lit(True))
    return questions.where(plain).unionByName(questions.where(~plain).withColumn(column, _nfkc_any(F.col(column))))


#: Letters that case folding changes though they are lower case already, by Python's tables.
FOLDED = {c: c.casefold() for c in map(chr, range(0x80, 0x1F000)) if c == c.lower() != c.casefold()}


#: Those that become one letter, in one pass, and those that become several; of these only the sharp s is not rare.
_ONE = {a: b for a, b in FOLDED.items() if len(b) == 1}
_MORE = {a: b for a, b in FOLDED.items() if len(b) > 1 and a != "ß"}


def casefold(x: Column) -> Column:
    """Full case folding: lower case, then the letters that have a folded form of their own, which few lines hold."""
    low = F.lower(x)
    one = F.replace(F.translate(low, "".join(_ONE), "".join(_ONE.values())), F.lit("ß"), F.lit("ss"))
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _MORE.items()))
    fold = F.aggregate(pairs, one, lambda text, p: F.replace(text, p["a"], p["b"]))
    # the class of a hundred letters is slow to test: only lines with letters beyond Latin-1 come to it
    return F.when(~x.rlike(r"[^\x00-\x7F]"), low).when(one.rlike(r"[^\x00-\xFF]") & one.rlike("[" + "".join(_MORE) + "]"), fold).otherwise(one)


def line_key(x: Column) -> Column:
    """Key by which repeated margin lines are found: white space collapsed, case-folded."""
    return casefold(F.when(x.rlike(r"^\s|\s$|\s\s|[^\S ]|[^\x00-\xFF]|[\x85\xA0]"), collapsed(x)).otherwise(x))


def is_page_marker(x: Column) -> Column:
    return x.rlike(r"^(?:[-–—]\s*)?\d{1,4}(?:\s*[-–—])?$") | x.rlike(r"(?i)^(?:halaman|page)\s*\d{1,4}$")


def is_structural(x: Column) -> Column:
    """Lines that may be legal headings, which are never margins."""
    return x.rlike(r"(?i)^(BAB|Bagian|Paragraf|Pasal)\s+") | x.rlike(r"^\(\d+\)") | _is_end(x)


def _is_end(x: Column) -> Column:
    """PENJELASAN in any case; only a short line is upper-cased."""
    return (F.octet_length(x) <= 30) & (F.upper(x) == "PENJELASAN")


def is_noise(x: Column) -> Column:
    """Empty lines, page markers, lines of rules and dots only."""
    return (x == "") | is_page_marker(x) | F.regexp_replace(x, r"\s+", "").rlike(f"^{NOISE_SIGNS}+$")


def dropped_by_cleaning(x: Column) -> Column:
    """Noise, national headers, `- n -` and decree numbers. Most lines begin with nothing that these begin with."""
    may = (x == "") | x.rlike(r"^(?:[-–—\d|¦~_=*•·….,;:\s]|[Hh][Aa]|[Pp][AaRr]|[Rr][Ee]|[Ss][Kk])")
    return F.when(may | x.isNull(), _dropped(x)).otherwise(F.lit(False))


def _dropped(x: Column) -> Column:
    return is_noise(x) | ((F.octet_length(x) <= 60) & F.upper(x).isin(*IGNORED_HEADERS)) | x.rlike(r"^-\s*\d+\s*-\s*$") | x.rlike(r"(?i)^SK\s+No\.?\s*")


def heading(x: Column) -> Column:
    """Kind of heading of a line: PENJELASAN, BAB, BAGIAN, PARAGRAF, PASAL, AYAT, or null."""
    kind = F.when(_is_end(x), "PENJELASAN")
    for name, pattern in HEADINGS.items():
        kind = kind.when(x.rlike(pattern), name)
    return kind


def suspicious_text(x: Column) -> Column:
    """Whether native text looks broken: replacement signs, or 40 characters and more that are mostly not letters or single ones."""
    tight = F.regexp_replace(x, r"(?U)\s+", "")
    letters = F.length(F.regexp_replace(tight, r"[^\p{L}\p{N}]", ""))
    tokens = F.filter(F.transform(F.split(collapsed(x), " "), lambda t: F.regexp_replace(t, r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", "")), lambda t: t != "")
    single = F.size(F.filter(tokens, lambda t: F.length(t) == 1))
    broken = F.contains(x, F.lit("\ufffd")) | F.contains(x, F.lit("\x00")) | F.contains(x, F.lit("(cid:"))
    ratio = (F.length(tight) >= 40) & ((letters / F.length(tight) < 0.45) | ((F.size(tokens) >= 20) & (single / F.greatest(F.size(tokens), F.lit(1)) > 0.45)))
    return (collapsed(x) != "") & (broken | ratio)


def normalize_query(x: Column) -> Column:
    """A question with white space collapsed and article and paragraph references in one form. NFKC is done before, by normalize_questions."""
    spaced = collapsed(F.replace(x, F.lit("\u00a0"), F.lit(" ")))
    article = F.regexp_replace(spaced, r"(?i)\bpasal\s*([0-9]+[a-z]?)\b", "Pasal $1")
    return F.regexp_replace(article, r"(?i)\bayat\s*(?:\(\s*)?([0-9]+)(?:\s*\))?", "Ayat $1")


def rewrite_query(x: Column) -> Column:
    """The question as it is searched for: with the phrase that suits it."""
    q = normalize_query(x)
    return F.when(q.rlike(r"(?i)\bPasal\s+\d+|\bAyat\s+\d+"), F.concat(q, F.lit(QUESTION_WITH_REFERENCE))).otherwise(F.concat(q, F.lit(QUESTION_WITHOUT_REFERENCE)))


def question_ok(x: Column) -> Column:
    """1 to 2000 characters before trimming, not blank after."""
    return F.coalesce(F.length(x).between(1, 2000) & (stripped(x) != ""), F.lit(False))
