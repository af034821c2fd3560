"""Quality rules, line first: lines that fail are removed, documents that lose too much text are rejected.

DataFrame functions only. A line is a `\\n`-separated part of the text with at least one word (`[^\\x20\\x09-\\x0D]+`).

A line fails if
* punctuation: no sentence ends in it (a mark, closing quotes and brackets, then white space or the line's end), or it
  holds three or more runs of two or more `!` or `?`;
* symbols: it has more than one character of `#*$%&|<>` for ten words;
* navigation: it is a menu entry, or has two or more ` | `, ` > `, ` » ` separators;
* boilerplate: it holds a legal or site phrase (cookies, privacy policy, licences, ...).

A document is rejected by the base rules (fewer than 50 words, or more than half of its words in repeated three-word
windows), or if its failing lines hold more than half of its characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import SPACE, named, unused, whole

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50
MAX_SYMBOL_PERCENT = 10

SYMBOLS = "[#*$%&|<>]"
# Only what Java's and RE2's engines read alike: \z for the end, [^\n] for any sign, letters in both cases.
SENTENCE_END = r"""[.!?…][.!?…"'”’»)\]]*([\x20\x09-\x0D]|\z)|[:;][\x20\x09-\x0D]*\z|[。！？｡।॥؟۔]"""
SHOUTING = r"([!?][!?]+[^!?]+){2}[!?][!?]"
SEPARATORS = r"( [|>»] [^\n]*){2}"

# Menu entries and phrases of sites and licences, by language.
MENU_ENTRIES = (
    "home|menu|search|login|log in|sign in|sign up|register|contact|contact us|about|about us|next|previous|read more|more|share|back to top|skip to content"
    "|accueil|recherche|connexion|se connecter|s'inscrire|à propos|suivant|précédent|lire la suite|partager|retour en haut|aller au contenu"
    "|startseite|menü|suche|anmelden|registrieren|kontakt|über uns|weiter|zurück|mehr|mehr lesen|teilen|nach oben|zum inhalt springen"
    "|inicio|menú|buscar|iniciar sesión|registrarse|contacto|sobre nosotros|siguiente|anterior|leer más|compartir|volver arriba|saltar al contenido"
)
PHRASES = (
    "cookies|cookie policy|privacy policy|terms of use|terms of service|all rights reserved|copyright|licensed under|public license|javascript|lorem ipsum|newsletter|powered by|click here"
    "|politique de confidentialité|conditions d'utilisation|mentions légales|tous droits réservés|cliquez ici|propulsé par"
    "|datenschutzerklärung|nutzungsbedingungen|impressum|alle rechte vorbehalten|hier klicken|bereitgestellt von"
    "|política de privacidad|condiciones de uso|términos de uso|aviso legal|todos los derechos reservados|haga clic aquí|desarrollado por"
)


def _both_cases(phrases: str) -> str:
    return "".join("['’]" if c == "'" else f"[{c}{c.upper()}]" if c.isalpha() else c for c in phrases)


MENU = rf"^[\x20\x09-\x0D]*({_both_cases(MENU_ENTRIES)})[.!?:;\x20\x09-\x0D]*\z"
BOILERPLATE = rf"(^|[^A-Za-z])({_both_cases(PHRASES)})(\z|[^A-Za-z])"


def _size(x: Column) -> Column:
    return F.size(x).cast("long")


def line_fails(line: Column) -> Column:
    """Whether a line with words breaks a rule. Rules that need more work come behind a cheap test of what they need."""
    symbols = F.length(line) - F.length(F.regexp_replace(line, SYMBOLS, ""))
    words = F.size(F.array_remove(F.split(line, f"[{SPACE}]+"), ""))
    parted = F.contains(line, F.lit(" | ")) | F.contains(line, F.lit(" > ")) | F.contains(line, F.lit(" » "))
    return ~line.rlike(SENTENCE_END) | (line.rlike("[!?][!?]") & line.rlike(SHOUTING)) | (line.rlike(SYMBOLS) & (symbols * 100 > words * MAX_SYMBOL_PERCENT)) | (parted & line.rlike(SEPARATORS)) | line.rlike(MENU) | line.rlike(BOILERPLATE)


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, the first occurrence included.

    Windows are compared by XXH64 of their words. Most texts have no repeated window, which a hash set shows; only the
    others sort their windows, so that equal ones are neighbours.
    """
    n = F.size(words)
    hashes = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def starts(rows: Column) -> Column:
        same = lambda x, i: (F.get(rows, i - 1)["h"].eqNullSafe(x["h"]) & (i > 0)) | F.get(rows, i + 1)["h"].eqNullSafe(x["h"])
        return F.sort_array(F.transform(F.filter(rows, same), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda s, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - s, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)

    # arrays that are used more than once are bound as one-element arrays, so that they are made once
    bind = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(bind(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda rows: bind(starts(rows), covered))))


def judge(documents: DataFrame, *, text_col: str = "text") -> DataFrame:
    """`documents` with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_chars (long), base_failed, kept (boolean), clean_text (string: the text without failing lines).

    Null texts count as empty and fail. Columns of these names are replaced; all others pass. Each row is judged alone,
    so repeated rows give equal results and an empty table gives an empty one. No shuffle.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_chars", "base_failed", "kept", "clean_text"]
    rest = [named(c) for c in documents.columns if c.lower() not in added]
    text_, words_, lines_, full_, size_ = unused([*documents.columns, *added], "__t", "__w", "__l", "__f", "__n")
    t = F.col(text_)
    rows = documents.select(*rest, whole(named(text_col)).alias(text_))
    rows = rows.select("*", F.array_remove(F.split(t, f"[{SPACE}]+"), "").alias(words_), F.split(t, "\n", -1).alias(lines_))
    blank = lambda x: ~x.rlike(f"[^{SPACE}]")
    rows = rows.select(
        "*",
        F.filter(lines_, lambda x: ~blank(x)).alias(full_),
        F.array_join(F.filter(lines_, lambda x: F.when(blank(x), F.lit(True)).otherwise(~line_fails(x))), "\n").alias("clean_text"),
    )
    rows = rows.select(
        *[named(c) for c in documents.columns if c.lower() not in added],
        _size(F.col(words_)).alias("n_words"),
        F.length(F.regexp_replace(t, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(full_) - F.size(F.array_distinct(full_))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(words_)).alias("n_repeat_words"),
        (F.length(t) - F.length("clean_text")).cast("long").alias("n_lost_chars"),
        F.length(t).cast("long").alias(size_),
        "clean_text",
    )
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    rows = rows.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("n_lost_chars") * 100 <= F.col(size_) * MAX_LOST_PERCENT))
    # a filter on the verdict must not be moved below the columns it rests on, where words and hashes would be made anew
    # for every use; a generator of one row holds it back
    passed = [named(c) for c in documents.columns if c.lower() not in added]
    return rows.select(*passed, F.inline(F.array(F.struct(*added))))
