"""Incremental ingestion: two runs over growing input, failures, awkward documents."""

from __future__ import annotations

import pytest

from jobs import common, ingest_documents, queries
from lexloom.operators import segment
from tests.conftest import SMALL, same_rows

KIND = "doc_id long, text string, lang string, source string, n_chars int, status string"
PROSE = "\n".join(f"Line {i} of a text that has no articles at all" for i in range(30))
LAW = "BAB I\nKETENTUAN UMUM\nPasal 1\nDalam undang-undang ini diatur kete-\nnagakerjaan.\n(1) Ayat pertama.\nPasal 2\nIsi pasal dua."


def _write(spark, folder, name, rows):
    """One more file, as a copy job would leave it: rows go to a folder of their own and then beside the others."""
    spark.createDataFrame([(*r, 1, "x") for r in rows], KIND).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def place(tmp_path):
    return [f"file://{tmp_path}/{n}" for n in ("in", "out", "checkpoint")]


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_whole_table_twice(spark):
    same_rows(queries.job1_ingest_documents(spark, SMALL), queries.ORACLES["job1_ingest_documents"], SMALL)


def test_only_new_files_are_taken(spark, place):
    source, target, checkpoint = place
    _write(spark, source, "a", [(5, PROSE, "en", "s"), (3, PROSE, "en", "s"), (7, LAW, "id", "s")])
    first = ingest_documents.run(spark, source, target, checkpoint)
    status = {r["doc_id"]: (r["status"], r["duplicate_of"], r["n_chunks"]) for r in first.collect()}
    assert status == {3: ("completed", None, 3), 5: ("duplicate", 3, 0), 7: ("completed", None, 3)}
    law = sorted((r["pasal"], r["ayat"] or "", r["part"], r["text"]) for r in first.where("doc_id = 7").collect())
    assert law == [("1", "", 1, "Dalam undang-undang ini diatur ketenagakerjaan."), ("1", "1", 1, "Ayat pertama."), ("2", "", 1, "Isi pasal dua.")]
    before = _rows(first)
    assert _rows(ingest_documents.run(spark, source, target, checkpoint)) == before

    _write(spark, source, "b", [(1, LAW, "id", "later"), (9, "A new text.", None, None)])
    second = ingest_documents.run(spark, source, target, checkpoint)
    assert set(before) <= set(_rows(second))
    new = {r["doc_id"]: (r["status"], r["duplicate_of"], r["text"]) for r in second.where("doc_id in (1, 9)").collect()}
    assert new == {1: ("duplicate", 7, None), 9: ("completed", None, "A new text.")}
    batches = {r["batch"] for r in spark.read.parquet(f"{target}/documents").select("batch").distinct().collect()}
    assert batches == {0, 1}


def test_a_batch_that_failed_is_run_again(spark, place, tmp_path, monkeypatch):
    source, target, checkpoint = place
    _write(spark, source, "a", [(i, f"{PROSE}\nand {i}", "en", "s") for i in range(4)])
    ingest_documents.run(spark, source, target, checkpoint)
    _write(spark, source, "b", [(9, LAW, "id", "s"), (2, f"{PROSE}\nand 0", "en", "s")])

    def stop(rows, by):
        raise RuntimeError("lost after writing")

    with monkeypatch.context() as m:
        m.setattr(common, "tally", stop)
        with pytest.raises(Exception, match="lost after writing"):
            ingest_documents.run(spark, source, target, checkpoint)
    after = _rows(ingest_documents.run(spark, source, target, checkpoint))
    undisturbed = ingest_documents.run(spark, source, f"file://{tmp_path}/out2", f"file://{tmp_path}/checkpoint2")
    columns = ["doc_id", "document_hash", "text", "part", "page_start"]
    again = spark.read.schema(ingest_documents.DOCUMENTS + ", batch int").parquet(f"{target}/documents")
    assert again.count() == 6 and after == _rows(ingest_documents.output(spark, target))
    assert _rows(ingest_documents.output(spark, target).where("status = 'completed'").select(*columns)) == _rows(undisturbed.where("status = 'completed'").select(*columns))


def test_one_file_a_batch_gives_the_same_chunks(spark, place, tmp_path):
    source, target, checkpoint = place
    for i in range(3):
        _write(spark, source, str(i), [(10 * i, PROSE, "en", "s"), (10 * i + 1, f"{LAW} {i}", "", "s")])
    slow = ingest_documents.run(spark, source, target, checkpoint, ingest_documents.Config(max_files_per_batch=1))
    fast = ingest_documents.run(spark, source, f"file://{tmp_path}/o", f"file://{tmp_path}/c")
    columns = ["document_hash", "kind", "pasal", "ayat", "part", "page_start", "text"]
    assert _rows(slow.where("kind is not null").select(*columns)) == _rows(fast.where("kind is not null").select(*columns))
    assert slow.where("status = 'duplicate'").count() == 2


def test_awkward_documents(spark, place):
    source, target, checkpoint = place
    long = "word " * 30_000
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "- 3 -\n...", "en", "s"), (4, long, "EN", "s"), (4, long, "EN", "s"), (None, long, "en", "s"), (None, "x", "a/b=c", ""), (4, "other", "en", "s")]
    _write(spark, source, "a", rows)
    got = ingest_documents.run(spark, source, target, checkpoint)
    facts = sorted({(str(r["doc_id"]), r["n_chars"], r["status"], r["duplicate_of"]) for r in got.collect()})
    assert facts == [("1", 0, "failed", None), ("2", 0, "failed", None), ("3", 9, "failed", None), ("4", 5, "completed", None), ("4", 150_000, "completed", None), ("None", 1, "completed", None), ("None", 150_000, "duplicate", 4)]
    words = " ".join(r["text"] for r in got.where("doc_id = 4 and n_chars > 5").orderBy("part").collect())
    assert words == long.strip()
    assert all(len(r["text"]) <= 1000 for r in got.where("text is not null").collect())


def test_no_files_and_no_rows(spark, place):
    source, target, checkpoint = place
    spark.createDataFrame([], KIND).write.parquet(source)
    assert ingest_documents.run(spark, source, target, checkpoint).count() == 0


def test_texts_without_articles_are_not_stored_for_them(spark, monkeypatch):
    kept, store = {}, segment.stored

    def count(df, name):
        out = store(df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(segment, "stored", count)
    rows = spark.createDataFrame([("h1", PROSE, "en"), ("h2", PROSE.replace("text", "poem"), "de")], "document_hash string, text string, language string")
    got = ingest_documents.chunks(rows, ingest_documents.Config()).collect()
    assert kept == {"classified": 0}
    assert {(r["document_hash"], r["language"], r["kind"]) for r in got} == {("h1", "en", "page"), ("h2", "de", "page")}
