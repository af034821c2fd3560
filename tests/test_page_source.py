"""Paged files as a data source: ranges, pruning, errors of pages and files, OCR by page."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.plans import documents
from lexloom.sources import page_source
from lexloom.sources.page_source import count_pages, read_paged, scan_files
from tests.conftest import SMALL, same_rows

OPENER = f"{__name__}:open_file"


class Strict:
    """A file whose name says how many pages it has and which are bad; it writes down what it is asked for."""

    def __init__(self, path: str) -> None:
        self.name = path.rsplit("/", 1)[-1]
        if "broken" in self.name:
            raise OSError("no such format")
        _, pages, bad = self.name.removesuffix(".pdf").split("-")
        self.pages, self.bad, self.log = int(pages), int(bad), path.removeprefix("file:") + ".log"

    def _ask(self, what: str, page: int) -> None:
        with open(self.log, "a") as f:
            f.write(f"{what} {page} {os.getpid()}\n")
        if page == self.bad:
            raise ValueError("bad page")

    def count(self) -> int:
        return self.pages

    def size(self, page):
        self._ask("size", page)
        return 595, 842

    def blocks(self, page):
        self._ask("blocks", page)
        return [(50, 20, f"second of {page}"), (10, 20, "first, "), (0, 900, "last"), (0, 5, "Pasal 1 " + "isi " * 80)]

    def boxes(self, page):
        self._ask("boxes", page)
        return [(0, 0, 595, 842)] if page % 2 == 0 else []


open_file = Strict


@pytest.fixture
def folder(tmp_path):
    for name in ("a-5000-17.pdf", "b-3-0.pdf", "c-broken.pdf", "d-2-0.PDF", "e.txt"):
        (tmp_path / name).write_text("x")
    return tmp_path


def test_a_long_file_is_read_by_many_tasks_and_no_text_is_opened_for_numbers(spark, folder):
    files = count_pages(spark, f"{folder}/*.pdf", OPENER).cache()
    assert {r["path"].rsplit("/", 1)[-1]: (r["n_pages"], r["error"]) for r in files.collect()} == {"a-5000-17.pdf": (5000, None), "b-3-0.pdf": (3, None), "c-broken.pdf": (0, "OSError: no such format")}
    numbers = read_paged(spark, files, OPENER, columns=["path", "page_number"])
    assert numbers.rdd.getNumPartitions() == 100 + 1 + 1
    assert numbers.where("page_number is not null").count() == 5003
    assert not list(folder.glob("*.log"))
    parts = read_paged(spark, files, OPENER).select(F.spark_partition_id().alias("p"), "page_number").where("page_number is not null").groupBy("p").count()
    assert parts.agg(F.max("count"), F.count("*")).first()[:] == (50, 101)


def test_one_bad_page_and_one_broken_file_are_one_row_each(spark, folder):
    files = count_pages(spark, f"{folder}/*.pdf", OPENER)
    for at_once in (50_000, 1):
        got = read_paged(spark, files, OPENER, pages=400, at_once=at_once).where("error is not null").collect()
        assert sorted((r["path"].rsplit("/", 1)[-1], r["page_number"] or 0, r["blocks"], r["error"]) for r in got) == [("a-5000-17.pdf", 17, None, "ValueError: bad page"), ("c-broken.pdf", 0, None, "OSError: no such format")]
    assert read_paged(spark, files.where("false"), OPENER).count() == 0


def test_filters_reach_the_partitions(spark, folder):
    files = count_pages(spark, f"{folder}/*.pdf", OPENER)
    path = f"file:{folder}/a-5000-17.pdf"
    few = read_paged(spark, files, OPENER, columns=["path", "page_number", "blocks"]).where((F.col("path") == path) & F.col("page_number").between(101, 130))
    assert few.rdd.getNumPartitions() == 1
    assert few.count() == 30
    asked = [x.split()[1] for x in (folder / "a-5000-17.pdf.log").read_text().splitlines()]
    assert set(asked) == {str(n) for n in range(101, 131)}
    for where, n in (("page_number = 3", 2), ("page_number > 4999", 1), ("page_number < 1", 0), ("page_number >= 5000 and page_number <= 6000", 1), (f"path in ('{path}', 'other')", 5000), ("page_number = 2 or page_number = 3", 4)):
        assert read_paged(spark, files, OPENER, columns=["path", "page_number"]).where(where).count() == n, where


def _ocr():
    def ocr(path, page, language, dpi):
        if page == 4:
            raise RuntimeError("no")
        return "" if page == 6 else f"ocr of {page} in {language} at {dpi}"

    return ocr


def test_scan_reads_in_order_and_deals_ocr_out_by_page(spark, tmp_path):
    for name in ("a-7-5.pdf", "c-broken.pdf", "e.txt"):
        (tmp_path / name).write_text("x")
    got = {(r["filename"], r["page_number"]): (r["mode"], r["text"], r["error"]) for r in scan_files(spark, str(tmp_path), OPENER, lambda: _ocr(), pages=2).collect()}
    plain = lambda n: f"Pasal 1 {'isi ' * 80}\nfirst, \nsecond of {n}\nlast"
    assert got["a-7-5.pdf", 1] == ("native_text", plain(1), None)
    assert got["a-7-5.pdf", 2] == ("full_ocr", "ocr of 2 in ind at 300", None)
    assert got["a-7-5.pdf", 4][2] == "Full-page OCR gagal pada halaman 4"
    assert got["a-7-5.pdf", 5][2] == "ValueError: bad page"
    assert got["a-7-5.pdf", 6][2] == "Full-page OCR tidak menghasilkan teks pada halaman 6"
    assert got["c-broken.pdf", 0][2] == "OSError: no such format"
    assert len(got) == 8
    native = scan_files(spark, str(tmp_path), OPENER, lambda: 1 / 0, mode="native")
    assert native.where("error is null").count() == 6


def test_form_feed_files(spark, tmp_path):
    (tmp_path / "v").write_text("one\ntwo\f\fthree\f")
    paged = page_source.FormFeedFile(f"{tmp_path}/v")
    assert paged.count() == 3
    assert [[b[2] for b in paged.blocks(n)] for n in (1, 2, 3)] == [["one", "two"], [""], ["three"]]


def test_ranges_do_not_grow_in_number(monkeypatch):
    monkeypatch.setattr(page_source, "TASKS", 10)
    reader = page_source.PageReader(StructType([]), {"opener": OPENER, "files": json.dumps([["a", 1000, None], ["b", 7, None], ["c", 0, "broken"]]), "range": "5"})
    got = reader.partitions()
    assert len(got) <= 10 + 3
    assert [n for p in got if p.path == "a" for n in range(p.first, p.last + 1)] == list(range(1, 1001))
    assert [(p.first, p.last, p.error) for p in got if p.path != "a"] == [(1, 7, None), (0, 0, "broken")]


def test_volumes_are_of_a_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(documents, "VOLUME_PAGES", 20)
    seen = []
    monkeypatch.setattr(page_source, "count_pages", lambda *args: seen.append(count_pages(*args)) or seen[0])
    same_rows(documents.page_scan(spark, SMALL), documents.ORACLES["page_scan"], SMALL)
    assert seen[0].agg(F.max("n_pages")).first()[0] <= 20
