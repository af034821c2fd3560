"""PDF uploads as a table, one row per file; bad files are marked and good ones go on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import document_id, is_pdf
from lexloom.operators.pages import analyze_pages, choose_text
from lexloom.sources.tables import stored


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(filename, document_id, document_hash, size, content, failed, reason) of the files under a path. Files without a byte are skipped by the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(F.url_decode(name).alias("filename"), F.sha2("content", 256).alias("document_hash"), F.col("length").alias("size"), "content")
    reason = F.when(~is_pdf(F.col("filename")), "not_a_pdf")
    return rows.withColumn("document_id", document_id(F.col("filename"))).withColumn("reason", reason).withColumn("failed", reason.isNotNull())


PAGE = "filename string, page_number int, page_w double, page_h double, text string, boxes array<struct<x0:double,y0:double,x1:double,y1:double>>, error string"


def read_pages(uploads: DataFrame, extract: Callable[[bytes], list[tuple]]) -> DataFrame:
    """One row per page of each good upload. extract(content) gives (page_number, page_w, page_h, text, boxes) rows.

    The extractor is a parameter because it needs a PDF library; a file that it fails on gives one row with the error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PAGE.split(", ")]
        for batch in batches:
            rows = []
            for name, content in zip(batch["filename"], batch["content"], strict=True):
                try:
                    rows += [(name, *page, None) for page in extract(content)]
                except Exception as error:  # noqa: BLE001  one broken file must not end the others
                    rows.append((name, None, None, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=names)

    return uploads.where(~F.col("failed")).select("filename", "content").mapInPandas(run, PAGE)


#: Resolution of a page's image for OCR.
OCR_DPI = 300
Ocr = Callable[[bytes, int, str, int], str]


def ocr_pages(analyzed: DataFrame, uploads: DataFrame, connect: Callable[[], Ocr], *, language: str = "ind", dpi: int = OCR_DPI) -> DataFrame:
    """(doc_id, page_number, ocr_text, error) of the pages that need OCR; uploads (doc_id, content).

    connect() is called once per task and gives ocr(content, page_number, language, dpi). A page that fails, or without text,
    has an error. Pages of a document are read one after the other next to its bytes, which travel once.
    """
    asked = analyzed.where("should_ocr").groupBy("doc_id").agg(F.array_sort(F.collect_list("page_number")).alias("numbers"))
    kind = f"doc_id {analyzed.schema['doc_id'].dataType.simpleString()}, page_number int, ocr_text string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ocr = connect()
        for batch in batches:
            for doc, numbers, content in zip(batch["doc_id"], batch["numbers"], batch["content"], strict=True):
                rows = []
                for n in numbers:
                    try:
                        text, error = ocr(content, int(n), language, dpi), None
                    except Exception:  # noqa: BLE001  one page must not end the others
                        text, error = None, f"Full-page OCR gagal pada halaman {n}"
                    if error is None and not (text or "").strip():
                        text, error = None, f"Full-page OCR tidak menghasilkan teks pada halaman {n}"
                    rows.append((doc, int(n), text, error))
                yield pd.DataFrame(rows, columns=["doc_id", "page_number", "ocr_text", "error"])

    return uploads.select("doc_id", "content").join(asked, "doc_id").mapInPandas(run, kind)


def scan_documents(uploads: DataFrame, extract: Callable[[bytes], list[tuple]], connect: Callable[[], Ocr], *, mode: str = "hybrid", language: str = "ind", dpi: int = OCR_DPI) -> DataFrame:
    """(doc_id, filename, page_number, text, mode, error): the text of each page of good uploads, native or by OCR, as process_documents takes it.

    mode: hybrid decides by page, native never uses OCR, full_ocr always. A file that cannot be read gives one row with
    the error, a page whose OCR fails has one.
    """
    own = uploads.where(~F.col("failed")).withColumn("doc_id", F.col("document_hash"))
    pages = stored(read_pages(own, extract).join(own.select("doc_id", "filename"), "filename"), "pages")
    analyzed = stored(analyze_pages(pages.where("error is null").drop("error"), mode), "analyzed")
    read = stored(ocr_pages(analyzed, own, connect, language=language, dpi=dpi), "ocr")
    chosen = choose_text(analyzed, read).join(read.select("doc_id", "page_number", "error"), ["doc_id", "page_number"], "left")
    broken = pages.where("error is not null").select("doc_id", "filename", F.lit(0).alias("page_number"), F.lit("").alias("text"), F.lit("native_text").alias("mode"), "error")
    return chosen.select("doc_id", "filename", "page_number", F.col("final_text").alias("text"), F.col("final_extraction_mode").alias("mode"), "error").unionByName(broken)


def reading_order(blocks: Column) -> Column:
    """Text of a page from its blocks (x0, y0, text), array of structs: from top to bottom, then from left to right."""
    placed = F.array_sort(F.transform(blocks, lambda b: F.struct(b["y0"].alias("y"), b["x0"].alias("x"), b["text"].alias("t"))))
    return F.array_join(F.transform(placed, lambda b: b["t"]), "\n")


def check_ocr(find: Callable[[str], str | None], languages: Callable[[], list[str]], language: str = "ind") -> None:
    """Preflight on the driver: the OCR program and its language are there, or an error says what is not."""
    if find("tesseract") is None:
        raise RuntimeError("the OCR program is not on the path")
    if language not in languages():
        raise RuntimeError(f"the OCR language {language!r} is not installed")
