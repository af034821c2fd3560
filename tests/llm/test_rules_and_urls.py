"""Quality rules against SQL, URL rules against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.llm import common, quality_rules, queries
from lexloom.llm.url_filter import RuleTrie, filter_urls, split_url
from tests.conftest import SMALL, duck, same_rows
from tests.llm.helpers import awkward, empty


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name], SMALL)


def repeated(words):
    spots = {}
    for i in range(len(words) - 2):
        spots.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({i + k for own in spots.values() if len(own) > 1 for i in own for k in range(3)})


def test_repeated_windows_against_brute_force(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcde"[: r.randint(1, 5)]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in quality_rules.judge(df).select("doc_id", "n_repeat_words").collect():
        assert row["n_repeat_words"] == repeated(texts[row["doc_id"]].split())


PROSE = "This is a plain sentence of some words that nobody could object to in any way at all. " * 5


@pytest.mark.parametrize(
    ("line", "clean"),
    [("A sentence ends here.", True), ("It goes on. and stops short", True), ("no mark at all", False), ("Home", False), ("a | b | c | d. x", False), ("WOW!! NOW!! BUY!!", False), ("We use cookies here.", False), ("Licensed under the Moon License.", False), ("x### y$$$ z&&&. ", False), ("", True)],
)
def test_lines(spark, line, clean):
    text = PROSE + "\n" + line
    row = quality_rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["clean_text"] == (text if clean else PROSE)
    assert row["n_lost_chars"] == (0 if clean else len(line) + 1)


SPACES, CLOSING = " \t\n\x0b\x0c\r", ".!?…\"'”’»)]"


def plain_line_fails(x):
    """The rules sign by sign, without patterns."""
    ends = any(c in "。！？｡।॥؟۔" for c in x) or x.rstrip(SPACES)[-1:] in (":", ";")
    for i, c in enumerate(x):
        if c in ".!?…":
            j = i + 1
            while j < len(x) and x[j] in CLOSING:
                j += 1
            ends |= j == len(x) or x[j] in SPACES
    runs = [len(run) for run in "".join(c if c in "!?" else " " for c in x).split()]
    words = [w for w in x.translate({ord(c): " " for c in SPACES}).split(" ") if w]
    symbols = sum(c in "#*$%&|<>" for c in x)
    parts, at = 0, 0
    while (at := min((k for k in (x.find(f" {c} ", at) for c in "|>»") if k >= 0), default=-1)) >= 0:
        parts, at = parts + 1, at + 3
    low = "".join(c.lower() if c.lower().upper() == c else c for c in x).replace("’", "'")
    menu = low.strip(SPACES).rstrip(".!?:;" + SPACES) in quality_rules.MENU_ENTRIES.split("|")
    phrase = any(_alone(low, p) for p in quality_rules.PHRASES.split("|"))
    return not ends or sum(n > 1 for n in runs) > 2 or symbols * 100 > len(words) * 10 or parts > 1 or menu or phrase


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _alone(low, phrase):
    at = low.find(phrase)
    while at >= 0:
        if (at == 0 or low[at - 1] not in LETTERS) and (at + len(phrase) == len(low) or low[at + len(phrase)] not in LETTERS):
            return True
        at = low.find(phrase, at + 1)
    return False


def test_lines_against_plain_rules(spark):
    r = random.Random(12)
    parts = ["a", "Word", " ", " ", ".", "!", "?", "!!", "??", ":", ";", "\u2028", "\u0085", "\r", "\t", "|", " | ", " > ", " » ", "#", "%", "Home", "MENÜ", "zurück", "Cookies", "tous droits RÉSERVÉS", "d’utilisation", "conditions ", "x", "”", ")", "。", "।", "İ", "é", "log in", "se connecter"]
    lines = ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(1500)]
    lines += ["It ends.\u2028", "It ends.\u0085", "a | b<\u0085 | c.", "a | b<\r | c.", "これは文です。次", "Home\u0085", "no end", "Buy!! Now!! Ok!!", "Über uns", "zurück.", "Notcookies.", "Impressum."]
    lines = [x for x in lines if any(c not in SPACES for c in x)]
    df = spark.createDataFrame(list(enumerate(lines)), "i long, line string")
    got = {x["i"]: x["f"] for x in df.select("i", quality_rules.line_fails(F.col("line")).alias("f")).collect()}
    for i, x in enumerate(lines):
        assert got[i] == plain_line_fails(x), repr(x)
    con = duck(SMALL)
    con.register("lines", df.toPandas())
    for pattern in (quality_rules.SENTENCE_END, quality_rules.SHOUTING, quality_rules.SEPARATORS, quality_rules.MENU, quality_rules.BOILERPLATE):
        there = dict(con.execute("SELECT i, regexp_matches(line, ?) FROM lines", [pattern]).fetchall())
        here = {x["i"]: x["m"] for x in df.select("i", F.col("line").rlike(pattern).alias("m")).collect()}
        assert there == here, pattern


def test_verdicts(spark):
    distinct = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, distinct + "."), (2, distinct), (3, "few words."), (4, "For " * 80 + ".")], "doc_id long, text string")
    assert [(r["base_failed"], r["kept"]) for r in quality_rules.judge(df).orderBy("doc_id").collect()] == [(False, True), (False, False), (True, False), (True, False)]


def test_awkward_documents(spark):
    out = quality_rules.judge(awkward(spark))
    assert out.count() == 11
    assert set(out.columns) >= {"id", "key", "table", "w", "kept", "n_words"}
    assert out.where("doc_id = 0").first()["n_words"] == 0
    assert out.where("kept").count() == out.select("kept").collect().count((True,))  # a filter on the verdict is held back
    assert quality_rules.judge(empty(spark)).count() == 0


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "a.example.com", ""), ("allow", "", "/free/"), ("block", "org", "/x"), ("allow", "org", "/x")]


def plain(url):
    host, path = split_url(url)
    fits = [(len(h) + len(p), v == "block", h + p, v) for v, h, p in RULES if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, "allow")


def test_trie_against_plain_search(spark):
    r = random.Random(1)
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/77?x#y", "https://a.example.com", "http://example.com?x", "http://xexample.com/en/7", "x://org/x/y", "x://com://y/en/"]
    urls += ["http://" + ".".join(r.choices(["com", "example", "a", "org", ""], k=r.randint(1, 4))) + "/" + "/".join(r.choices(["en", "7", "78", "free", "x", ""], k=r.randint(0, 4))) + r.choice(["", "?q", "#f"]) for _ in range(400)]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    for row in filter_urls(df, RULES).collect():
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == plain(urls[row["page_id"]])
    assert filter_urls(df.where(F.lit(False)), RULES).count() == 0


@pytest.mark.parametrize("bound", [100, 3, 0])
def test_rules_as_a_table_give_the_same(spark, bound):
    r = random.Random(2)
    rules = RULES + [(r.choice(("allow", "block")), r.choice(("com", "Example.com", "", "b.org", "a..com")), "/" + "/".join(r.choices(["en", "7", "x", ""], k=r.randint(0, 3)))) for _ in range(40)]
    urls = [None, "", "no scheme", "http://", "http://com./en/", "http://a..com/en/7/", "http://EXAMPLE.com/en/7/x?y", "http://a.example.com/" + "x/" * 3000, "x://b.org#/x"]
    urls += ["http://" + ".".join(r.choices(["com", "example", "a", "org", "b", ""], k=r.randint(1, 4))) + "/" + "/".join(r.choices(["en", "7", "78", "free", "x", ""], k=r.randint(0, 4))) + r.choice(["", "?q", "#f"]) for _ in range(300)]
    df = spark.createDataFrame([(None if i % 5 == 0 else i % 200, u, 1, "x") for i, u in enumerate(urls)], "page_id long, url string, size int, of string")
    want = sorted(map(str, filter_urls(df, rules).collect()))
    assert len(want) == len(urls)
    assert sorted(map(str, filter_urls(df, rules, broadcast_rules=bound).collect())) == want
    as_table = spark.createDataFrame(rules, "verdict string, host string, path string")
    assert sorted(map(str, filter_urls(df, as_table, broadcast_rules=bound).collect())) == want
    assert filter_urls(df.where("false"), rules, broadcast_rules=bound).count() == 0
    with pytest.raises(ValueError):
        filter_urls(df, [("maybe", "com", "/")], broadcast_rules=bound).count()


def test_rules_of_the_contract(spark, tmp_path):
    want = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    assert queries.URL_RULES == want
    urls = ["http://a.net/de/1", "http://a.example.net/de/81", "http://a.example.net/de/7", "http://a.com/en/7", "http://example.com/en/71", "http://b.org/es/", "http://b.org/en/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r["rule"], r["verdict"]) for r in queries.op5_url_filter(spark, str(tmp_path)).orderBy("page_id").collect()]
    assert got == [("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block"), (None, "allow")]


def test_many_rules_and_bad_ones():
    trie = RuleTrie([("block", "com", f"/p{i:03d}") for i in range(300)])
    assert trie.find("x.com", "/p123/y") == ("com/p123", "block")
    assert trie.find("x.com", "/q") == (None, None)
    with pytest.raises(ValueError):
        RuleTrie([("maybe", "com", "/")])


def test_internal_names_do_not_clash(spark):
    row = ("A sentence with words in it. " * 20, "t", "w", "l", "f", "n", "x")
    df = spark.createDataFrame([row], "text string, __t string, __W string, __l string, __f string, __n string, `a.b` string")
    out = quality_rules.judge(df)
    assert out.columns[:7] == df.columns
    assert out.first()[1:7] == row[1:] and out.first()["kept"] == quality_rules.judge(df.select("text")).first()["kept"]


def test_attach_takes_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a", 5, 6), (None, "b", 7, 8)], "k int, __k string, __salt int, ___k int")
    table = spark.createDataFrame([(1, "x", 0), (None, "y", 1)], "k int, v string, __SALT2 int")
    for bound in (10, 0):
        got = common.attach(rows, table, ["k"], bound=bound)
        assert got.columns == ["k", "__k", "__salt", "___k", "v", "__SALT2"]
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(table, rows["k"].eqNullSafe(table["k"])).select(rows["*"], "v", "__SALT2").collect()))
