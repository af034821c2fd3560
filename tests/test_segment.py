"""Cleaning, sections and chunks on small documents, and against a plain word-by-word model on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom import plans
from lexloom.operators import segment
from tests.conftest import same_rows


def pages(spark, *texts):
    return spark.createDataFrame([(1, "UU 1.pdf", i, t) for i, t in enumerate(texts, 1)], "doc_id long, filename string, page_number int, text string")


def lines(df):
    return [r["line"] for r in df.orderBy("page_number", "line_no").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Pasal\n5\nx", ["Pasal 5", "x"]),
        ("Pasal\n\n5A\nx", ["Pasal 5A", "x"]),
        ("Pasal\n\n5\nx", ["Pasal", "x"]),
        ("kete-\nnaga-\nkerjaan", ["ketenagakerjaan"]),
        ("A-\nBc", ["A-", "Bc"]),
        ("Presiden\nSK No 3\n- 4 -\nisi", ["isi"]),
        ("", []),
    ],
)
def test_cleaning(spark, text, want):
    assert lines(segment.parser_lines(pages(spark, text))) == want


def test_margins(spark):
    body = "\n".join(f"baris {i} isi" for i in "abcdefghijkl")
    two = pages(spark, f"Lembaran Negara\n{body}\nPasal 1", f"Lembaran Negara\n{body.replace('baris', 'kata')}\nPasal 1")
    got = lines(segment.clean_pages(two))
    assert "Lembaran Negara" not in got
    assert got.count("Pasal 1") == 2
    assert "Lembaran Negara" in lines(segment.clean_pages(pages(spark, f"Lembaran Negara\n{body}")))


def chunks(spark, *texts, **kw):
    return segment.chunk_documents(pages(spark, *texts), **kw).orderBy("chunk_id").collect()


def test_sections_and_ids(spark):
    got = chunks(spark, "lost\nBAB II\nKETENTUAN\nUMUM\nPasal 1\nsatu\n(1) dua\ntiga\nBagian Kesatu\nlost too", "Pasal 12a empat\n(2) lima\nPENJELASAN\nPasal 99\nnever")
    assert [(r["chunk_id"], r["bab"], r["bab_title"], r["text"], r["pages"]) for r in got] == [
        ("uu_1-pasal1-ayat1-part1", "II", "KETENTUAN UMUM", "dua tiga", [1]),
        ("uu_1-pasal1-noayat-part1", "II", "KETENTUAN UMUM", "satu", [1]),
        ("uu_1-pasal12A-ayat2-part1", "II", "KETENTUAN UMUM", "lima", [2]),
        ("uu_1-pasal12A-noayat-part1", "II", "KETENTUAN UMUM", "empat", [2]),
    ]


def test_reopened_section_goes_on_counting(spark):
    got = chunks(spark, "Pasal 1\na\nPasal 2\nb\nPasal 1\nc")
    assert [(r["chunk_id"], r["text"]) for r in got] == [("uu_1-pasal1-noayat-part1", "a"), ("uu_1-pasal1-noayat-part2", "c"), ("uu_1-pasal2-noayat-part1", "b")]


@pytest.mark.parametrize(("words", "sizes"), [(["a" * 499, "b" * 500], [1000]), (["a" * 500, "b" * 500], [500, 500]), (["a" * 1500], [1500]), (["x", "a" * 1500, "y"], [1, 1500, 1])])
def test_packing(spark, words, sizes):
    assert [len(r["text"]) for r in chunks(spark, "Pasal 1\n" + " ".join(words))] == sizes


def test_random_packing_keeps_all_words(spark):
    r, rows = random.Random(5), []
    for i in range(60):
        words = ["w" * r.randint(1, 30) + str(k) for k in range(r.randint(1, 80))]
        rows.append((i, 1, 0, None, "1", None, words, sorted(r.choices(range(1, 5), k=len(words)))))
    found = spark.createDataFrame(rows, "doc_id long, section long, bab_no long, bab string, pasal string, ayat string, words array<string>, pages array<int>")
    packed = segment.pack_sections(found, 100).orderBy("doc_id", "k").collect()
    for i, *_, words, on_pages in rows:
        own = [x for x in packed if x["doc_id"] == i]
        assert " ".join(x["text"] for x in own).split() == words
        assert sorted({p for x in own for p in x["pages"]}) == sorted(set(on_pages))
        for a, b in zip(own, own[1:], strict=False):
            assert len(a["text"]) <= 100 or " " not in a["text"]
            assert len(a["text"]) + 1 + len(b["text"].split(" ")[0]) > 100


def test_metrics(spark):
    source = pages(spark, "Pasal 1\nsatu\n(1) dua", "", "Pasal 2\nPENJELASAN\nPasal 3\n(4) x")
    row = segment.document_metrics(source, segment.chunk_documents(source)).first()
    assert (row["pasal_count"], row["ayat_count"], row["chunk_count"]) == (3, 2, 2)
    assert row["identifiers"] == ["Pasal 1", "Pasal 1 Ayat 1", "Pasal 2", "Pasal 3", "Pasal 3 Ayat 4"]
    assert abs(row["page_coverage"] - 2 / 3) < 1e-9
    assert row["native_pages"] == 3


def test_empty_table(spark):
    empty = pages(spark, "x").where(F.lit(False))
    assert segment.chunk_documents(empty).count() == 0


def test_margin_keys_with_a_sharp_s_equal_the_sql(spark, tmp_path):
    text = "\n".join(["Die Straße ß", *[f"zeile {i} inhalt" for i in "abcdefghijk"], "DIE STRAẞE", *[f"satz {i} text" for i in "abcdefghijk"], "Die Straße ß", *[f"wort {i} hier" for i in "abc"]])
    spark.createDataFrame([(28, text), (37, text.upper()), (30, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/rows")
    (file,) = spark.read.parquet(f"{tmp_path}/rows").coalesce(1).select("doc_id", "text").write.parquet(f"{tmp_path}/one") or tmp_path.glob("one/*.parquet")
    (tmp_path / "documents.parquet").write_bytes(file.read_bytes())
    got = plans.QUERIES["margin_keys"](spark, str(tmp_path))
    assert any("ß" in r["key"] for r in got.collect())
    same_rows(got, plans.ORACLES["margin_keys"], str(tmp_path))


def test_cleaning_moves_lines_once_and_equals_its_steps(spark, monkeypatch):
    """Lines with odd ends, signs and headings that come together only when noise between them is gone."""
    r, signs = random.Random(4), ["Pasal", "pasal", "7a", "12", "- 3 -", "..", "Lembaran Stra\u00dfe 1", "LEMBARAN STRASSE 1", "\ufb01nal  x", "kete-", "nagakerjaan", "PENJELASAN", "a\u2028b", "c\rd\r\ne", "", "  SK No 4", "Pasal 3", "(1) x", "g" * 130]
    rows = [(d, f"UU {d}.pdf", p, "\n".join(r.choice(signs) if r.random() < 0.7 else f"baris {r.randint(0, 400)}" for _ in range(r.randint(0, 16)))) for d in range(40) for p in range(1, 5)]
    df = spark.createDataFrame(rows, "doc_id long, filename string, page_number int, text string")
    basic = segment.clean_lines(segment.page_lines(df))
    want = segment.join_hyphens(segment.remove_margins(segment.clean_lines(basic), segment.repeated_margins(basic)))
    kept = segment.join_hyphens(segment.clean_lines(basic))
    monkeypatch.setattr(segment, "stored", None)
    got = segment.clean_pages(df)
    order = lambda x: sorted(map(tuple, x.select("doc_id", "page_number", "line_no", "line").collect()))
    assert order(got) == order(want)
    assert len(order(got)) < len(order(kept))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
