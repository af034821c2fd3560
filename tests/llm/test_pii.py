"""Personal data against plain regular expressions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lexloom.llm import pii
from tests.llm.helpers import awkward, empty

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain(text):
    valid = {"email": lambda m, d: True, "ip": lambda m, d: all(int(p) <= 255 for p in m.split(".")), "card": lambda m, d: 12 <= len(d) <= 19 and luhn(d), "phone": lambda m, d: 9 <= len(d) <= 15}
    out = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid[kind](m[0], re.sub("[^0-9]", "", m[0]))]
    return ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in sorted(out))


def described(spark, texts, column="pii_base"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r[0]: r[1] for r in pii.find_pii(df).select("doc_id", pii.describe(F.col(column))).collect()}


def test_base_spans_on_random_texts(spark):
    r = random.Random(5)
    parts = ["a", "b.c", "@", ".", "1", "23", "256", "+", "-", " ", "(", ")", "4111111111111111", "+49 (30) 1234-5678", "x@y.zz", "10.0.0.1", "😀", "_", "%"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    got = described(spark, texts)
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 300_000 + "@b", "x@" + "a." * 60_000 + "com", "1" * 200_000, "1-2 " * 50_000, "+1" + "-" * 100_000, "@" * 3000, "1.1.1.1 " * 1500])
def test_long_runs_are_cheap(spark, text):
    assert described(spark, [text])[0] is not None


def test_added_spans(spark):
    texts = ["paid with 4465758382889437 4465758382889437 today", "call +1 (826) 555-4081 190.137.223.204 now", "write to jan at firm dot com please", "version 1.2.3.4 and order 1234 5678 9012", "we sat at home. For once"]
    got, base = described(spark, texts, "pii_spans"), described(spark, texts)
    assert got[0] == "card:10:26,card:27:43"
    assert "phone:5:22" in got[1]
    assert got[2] == "email:9:28"
    assert [got[i] for i in (3, 4)] == [base[i] for i in (3, 4)]
    for i in base:
        assert set(filter(None, base[i].split(","))) <= set(got[i].split(","))


def test_redaction(spark):
    df = spark.createDataFrame([(1, "😀 me@x.org, 10.0.0.25!"), (2, "none"), (3, None)], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(pii.find_pii(df)).orderBy("doc_id").collect()] == ["😀 [EMAIL], [IP]!", "none", None]


def test_trees_as_columns_give_what_trees_give(spark):
    texts = [t for _, _, t in pii._examples(400, seed=21)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind, (trees, cut) in pii._model(spark.sparkContext.applicationId).items():
        assert len(trees) == pii.ROUNDS
        assert cut < float("inf")
        rows = df.select(F.explode(pii.candidates(F.col("t"), pii.proposals(F.col("t"), kind), kind)).alias("c")).select("c.*", F.lit(0).alias("x"))
        score = pii._score(trees, F.struct(*pii.FEATURES))
        got = rows.select(*pii.FEATURES, score.alias("score")).collect()
        assert len(got) > 20
        for r in got:
            assert abs(r["score"] - sum(pii.RATE * pii._value(t, tuple(r)[:-1]) for t in trees)) < 1e-6


@pytest.mark.parametrize("kind", pii.KINDS)
def test_precision_and_recall_on_held_out_examples(spark, kind):
    found = pii.quality(spark, pii._examples(2000, seed=99))[kind]
    assert found["added"] >= 50
    assert found["precision"] >= 0.9
    assert found["recall"] >= 0.9


def test_running_totals(spark):
    r = random.Random(6)
    rows = [[r.randint(-9, 9) for _ in range(n)] for n in (0, 1, 2, 3, 7, 8, 9, 100, 1025)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x array<int>")
    got = df.select("i", pii.scan(F.col("x"), lambda a, b: a + b).alias("s"), pii.scan(F.col("x"), lambda a, b: F.greatest(a, b)).alias("m")).collect()
    for r in got:
        x = rows[r["i"]]
        assert r["s"] == [sum(x[: k + 1]) for k in range(len(x))]
        assert r["m"] == [max(x[: k + 1]) for k in range(len(x))]


def test_merging_against_plain_one(spark):
    r, rows = random.Random(8), []
    for i in range(400):
        base = sorted({(s := r.randint(0, 60), r.randint(0, 3), s + r.randint(1, 8)) for _ in range(r.randint(0, 4))})
        added = []
        for k in range(4):
            at = 0
            while (at := at + r.randint(0, 30)) < 60:  # those of a kind do not overlap
                added.append((at, k, at := at + r.randint(1, 12)))
        rows.append((i, [(*x, x[0], "") for x in base], [(*x, x[0], "") for x in added]))
    span = "s:int,k:int,e:int,b:int,m:string"
    df = spark.createDataFrame(rows, f"i int, base array<struct<{span}>>, added array<struct<{span}>>")
    for x in df.select("i", pii._merge(F.col("base"), F.col("added")).alias("got")).collect():
        _, want, added = rows[x["i"]]
        for kind in pii.ORDER:
            own = [a for a in added if pii.KINDS[a[1]] == kind and not any(a[0] < b[2] and b[0] < a[2] for b in want)]
            want = [*want, *own]
        assert [tuple(y) for y in x["got"]] == sorted(want)


def test_time_is_in_proportion_to_matches(spark):
    seconds = []
    for n in (10_000, 100_000):
        text = " ".join(f"10.0.{i % 256}.7 +1 (555) 010-{i % 10000:04d} a{i}@x.org 4465758382889437," for i in range(n // 4))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        row = pii.redact(pii.find_pii(df)).select(F.size("pii_base").alias("n"), F.size("pii_spans").alias("m"), "text").first()
        seconds.append(time.perf_counter() - began)
        assert row["n"] == n // 4 * 4
        assert row["m"] == row["n"]
        assert row["text"].count("[") == n // 4 * 4
    assert seconds[1] < 10


def test_awkward_documents(spark):
    out = pii.find_pii(awkward(spark))
    assert out.count() == 11
    assert [r["doc_id"] for r in out.where(F.size("pii_base") > 0).collect()] == [8]
    assert pii.find_pii(empty(spark)).count() == 0


def test_internal_names_do_not_clash(spark):
    df = spark.createDataFrame([("mail a@b.org", "x", 1)], "text string, __added string, ___ADDED int")
    out = pii.redact(pii.find_pii(df))
    assert out.first()[:3] == ("mail [EMAIL]", "x", 1)
