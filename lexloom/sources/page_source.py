"""Paged files (PDF and the like) as a Spark data source: partitions are ranges of pages, rows hold no file's bytes.

    spark.dataSource.register(PageSource)
    spark.read.format("paged").schema("path string, page_number int").options(opener=..., files=...).load()

A file is opened by its path in the task that reads a range of its pages, so a file of any length is read by as many
tasks as it has ranges. Only what the schema names is asked of a page: without `blocks` no text is extracted, without
`boxes` no images are listed. A page that cannot be read is a row with its error, a file that cannot be opened one row
for the file; the others go on.

The library that opens files is a parameter, named as `module:function`. It gives a `Paged` for a path.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from lexloom.functions import document_id, is_pdf
from lexloom.operators.pages import analyze_pages, choose_text
from lexloom.sources.tables import stored
from lexloom.sources.uploads import OCR_DPI, reading_order

PAGES = (
    "path string, page_number int, page_w double, page_h double, blocks array<struct<x0:double,y0:double,text:string>>, "
    "boxes array<struct<x0:double,y0:double,x1:double,y1:double>>, error string"
)
#: Pages of a task, of up to TASKS tasks.
RANGE = 50
#: Ranges of one read from which on they are longer than that: a task opens its file anew, so their number must not grow with the pages.
TASKS = 2_000
#: Files of one read; Spark holds a source's partitions on the driver, so more files are several reads.
FILES = 50_000


class Paged(Protocol):
    """An open file. Pages are numbered from 1."""

    def count(self) -> int: ...

    def size(self, page: int) -> tuple[float, float]: ...

    def blocks(self, page: int) -> list[tuple[float, float, str]]:
        """Blocks of text with their left upper corner, in any order."""

    def boxes(self, page: int) -> list[tuple[float, float, float, float]]:
        """Rectangles of the images."""


def _opener(name: str) -> Callable[[str], Paged]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _said(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


@dataclass
class PageRange(InputPartition):
    """Pages first to last of a file; a file that could not be opened has the error in their place."""

    path: str
    first: int
    last: int
    error: str | None = None

    def __post_init__(self) -> None:
        super().__init__(self.path)


class PageReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names = schema.names
        self.opener, self.range = options["opener"], int(options.get("range", RANGE))
        self.files = [tuple(f) for f in json.loads(options["files"])]
        self.first, self.last, self.paths = 1, float("inf"), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds of page numbers and values of paths become fewer partitions; Spark applies the rest."""
        for f in filters:
            match f:
                case EqualTo(("page_number",), n):
                    self.first, self.last = max(self.first, n), min(self.last, n)
                case GreaterThan(("page_number",), n):
                    self.first = max(self.first, n + 1)
                case GreaterThanOrEqual(("page_number",), n):
                    self.first = max(self.first, n)
                case LessThan(("page_number",), n):
                    self.last = min(self.last, n - 1)
                case LessThanOrEqual(("page_number",), n):
                    self.last = min(self.last, n)
                case EqualTo(("path",), p):
                    self.paths = {p} if self.paths is None else self.paths & {p}
                case In(("path",), ps):
                    self.paths = set(ps) if self.paths is None else self.paths & set(ps)
                case _:
                    yield f

    def partitions(self) -> list[PageRange]:
        out, total = [], sum(n for _, n, error in self.files if error is None)
        size = max(self.range, -(-total // TASKS))
        for path, n, error in self.files:
            if self.paths is not None and path not in self.paths:
                continue
            if error is not None:
                if self.first == 1 and self.last == float("inf"):  # a filter on page numbers takes no row without one
                    out.append(PageRange(path, 0, 0, error))
                continue
            last = int(min(n, self.last))
            out += [PageRange(path, a, min(a + size - 1, last)) for a in range(int(self.first), last + 1, size)]
        return out

    def read(self, partition: PageRange | None) -> Iterator[tuple]:
        if partition is None:  # Spark asks so where there are no partitions
            return
        row = lambda **own: tuple(own.get(c) for c in self.names)
        if partition.error is not None:
            yield row(path=partition.path, error=partition.error)
            return
        try:
            paged = _opener(self.opener)(partition.path)
        except Exception as error:  # noqa: BLE001  it could be opened when its pages were counted
            yield row(path=partition.path, error=_said(error))
            return
        for n in range(partition.first, partition.last + 1):
            own = {"path": partition.path, "page_number": n}
            try:
                if "page_w" in self.names or "page_h" in self.names:
                    own["page_w"], own["page_h"] = map(float, paged.size(n))
                if "blocks" in self.names:
                    own["blocks"] = [(float(x), float(y), str(t)) for x, y, t in paged.blocks(n)]
                if "boxes" in self.names:
                    own["boxes"] = [tuple(map(float, b)) for b in paged.boxes(n)]
            except Exception as error:  # noqa: BLE001  one page must not end the others
                own = {"path": partition.path, "page_number": n, "error": _said(error)}
            yield row(**own)


class PageSource(DataSource):
    """Options: opener (module:function), files (JSON list of [path, pages, error]), range (pages of a task)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(schema, dict(self.options))


def count_pages(spark: SparkSession, path: str, opener: str, only: DataFrame | None = None) -> DataFrame:
    """(path, n_pages, error) of the files under a path, each opened once; their bytes are not read as a column. only: (path) of those that count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    files = files if only is None else files.join(only.select("path"), "path", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_file = _opener(opener)
        for batch in batches:
            rows = []
            for name in batch["path"]:
                try:
                    rows.append((name, open_file(name).count(), None))
                except Exception as error:  # noqa: BLE001  one broken file must not end the others
                    rows.append((name, 0, _said(error)))
            yield pd.DataFrame(rows, columns=["path", "n_pages", "error"])

    return files.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "path string, n_pages int, error string")


def read_paged(spark: SparkSession, files: DataFrame, opener: str, *, columns: list[str] | None = None, pages: int = RANGE, at_once: int = FILES) -> DataFrame:
    """The pages of counted files, as PAGES or the columns of it that are named; `at_once` files to a read."""
    spark.dataSource.register(PageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    kinds = dict(c.split(" ", 1) for c in PAGES.split(", "))
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    out, held = [], []

    def add() -> None:
        out.append(spark.read.format("paged").schema(schema).option("opener", opener).option("range", pages).option("files", json.dumps(held)).load())
        held.clear()

    for row in files.select("path", "n_pages", "error").orderBy("path").toLocalIterator():
        held.append(tuple(row))
        if len(held) == at_once:
            add()
    if held or not out:
        add()
    first, *rest = out
    for more in rest:
        first = first.unionByName(more)
    return first


def ocr_paged(asked: DataFrame, connect: Callable[[], Callable[[str, int, str, int], str]], *, language: str = "ind", dpi: int = OCR_DPI) -> DataFrame:
    """(doc_id, page_number, ocr_text, error) of pages (doc_id, path, page_number), each read by itself, dealt out over the tasks.

    connect() is called once per task that has pages and gives ocr(path, page_number, language, dpi). A page that fails, or without text, has an error.
    """
    kind = f"doc_id {asked.schema['doc_id'].dataType.simpleString()}, page_number int, ocr_text string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ocr = None
        for batch in batches:
            rows, ocr = [], ocr or (connect() if len(batch) else None)
            for doc, path, n in batch.itertuples(index=False):
                try:
                    text, error = ocr(path, int(n), language, dpi), None
                except Exception:  # noqa: BLE001  one page must not end the others
                    text, error = None, f"Full-page OCR gagal pada halaman {n}"
                if error is None and not (text or "").strip():
                    text, error = None, f"Full-page OCR tidak menghasilkan teks pada halaman {n}"
                rows.append((doc, int(n), text, error))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "ocr_text", "error"])

    return asked.select("doc_id", "path", "page_number").repartition("path", "page_number").mapInPandas(run, kind)


def scan_files(spark: SparkSession, path: str, opener: str, connect: Callable[[], Callable[[str, int, str, int], str]], *, mode: str = "hybrid", language: str = "ind", dpi: int = OCR_DPI, pages: int = RANGE, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, document_id, filename, page_number, text, mode, error) of the PDF files under a path, as process_documents takes it; doc_id is the file's path.

    mode: hybrid decides by page, native never uses OCR, full_ocr always. Text is put in reading order. A file or page
    that cannot be read, or whose OCR fails, is a row with its error; a file's own has the page number 0. only: the paths
    (one column, path) to which the scan is kept.
    """
    files = stored(count_pages(spark, path, opener, only).withColumn("filename", F.url_decode(F.element_at(F.split("path", "/"), -1))).where(is_pdf(F.col("filename"))), "files")
    read = read_paged(spark, files, opener, pages=pages).withColumn("text", reading_order(F.col("blocks"))).withColumn("doc_id", F.col("path")).drop("blocks")
    read = stored(read, "pages")
    good = read.where("error is null").drop("error")
    analyzed = stored(analyze_pages(good, mode), "analyzed")
    done = stored(ocr_paged(analyzed.where("should_ocr"), connect, language=language, dpi=dpi), "ocr")
    chosen = choose_text(analyzed, done).join(done.select("doc_id", "page_number", "error"), ["doc_id", "page_number"], "left")
    broken = read.where("error is not null").select("doc_id", F.coalesce("page_number", F.lit(0)).alias("page_number"), F.lit("").alias("final_text"), F.lit("native_text").alias("final_extraction_mode"), "error")
    rows = chosen.select(*broken.columns).unionByName(broken)
    names = files.select(F.col("path").alias("doc_id"), "filename", document_id(F.col("filename")).alias("document_id"))
    return rows.join(names, "doc_id").select("doc_id", "document_id", "filename", "page_number", F.col("final_text").alias("text"), F.col("final_extraction_mode").alias("mode"), "error")


class FormFeedFile:
    """A text file whose pages end with form feeds, by any path that pyarrow's file systems know; lines are blocks."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(path if ":" in path.split("/", 1)[0] else f"file://{path}")
        with system.open_input_stream(place) as f:
            self.pages = f.read().decode().split("\f")
        if not self.pages[-1]:
            self.pages.pop()

    def count(self) -> int:
        return len(self.pages)

    def size(self, page: int) -> tuple[float, float]:
        return 595.0, 842.0

    def blocks(self, page: int) -> list[tuple[float, float, str]]:
        return [(0.0, float(i), line) for i, line in enumerate(self.pages[page - 1].split("\n"))]

    def boxes(self, page: int) -> list[tuple[float, float, float, float]]:
        return []
