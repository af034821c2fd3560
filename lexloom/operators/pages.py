"""Page-level decisions: image coverage, text density, whether a page needs OCR."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import HEADINGS, suspicious_text, text_length

# The decision's thresholds.
NATIVE_MIN_CHARS = 200
DOMINANT_COVERAGE, DOMINANT_DENSITY = 0.70, 6.0
MULTI_COVERAGE, MULTI_CHARS, MULTI_DENSITY = 0.50, 400, 8.0
POINTS_PER_SQUARE_INCH = 5184.0


def _bind(x: Column, f: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(x), f), F.lit(0))


def clip_boxes(boxes: Column, width: Column, height: Column) -> Column:
    """Boxes cut to the page; empty and non-finite ones go."""
    cut = F.transform(boxes, lambda b: F.struct(F.greatest(b["x0"], F.lit(0.0)).alias("x0"), F.greatest(b["y0"], F.lit(0.0)).alias("y0"), F.least(b["x1"], width).alias("x1"), F.least(b["y1"], height).alias("y1")))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.filter(cut, lambda b: finite(b["x0"]) & finite(b["y0"]) & finite(b["x1"]) & finite(b["y1"]) & (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]))


def union_area(boxes: Column) -> Column:
    """Exact area of the union of boxes: strips between neighbouring x, in each the merged y intervals."""
    zero = F.lit(0.0)

    def merged(spans: Column) -> Column:
        start = F.struct(zero.alias("sum"), F.lit(float("-inf")).alias("end"))
        step = lambda a, s: F.struct((a["sum"] + F.greatest(zero, s["y1"] - F.greatest(s["y0"], a["end"]))).alias("sum"), F.greatest(a["end"], s["y1"]).alias("end"))
        return F.aggregate(spans, start, step, lambda a: a["sum"])

    def strips(xs: Column) -> Column:
        def area(x: Column, i: Column) -> Column:
            right = F.get(xs, i + 1)
            inside = F.sort_array(F.transform(F.filter(boxes, lambda b: (b["x0"] <= x) & (b["x1"] >= right)), lambda b: F.struct(b["y0"].alias("y0"), b["y1"].alias("y1"))))
            return F.when(right.isNull(), zero).otherwise((right - x) * merged(inside))

        return F.aggregate(F.transform(xs, area), zero, lambda a, x: a + x)

    return _bind(F.array_sort(F.array_distinct(F.concat(F.transform(boxes, lambda b: b["x0"]), F.transform(boxes, lambda b: b["x1"])))), strips)


def image_coverage(boxes: Column, width: Column, height: Column) -> Column:
    """Part of the page that images cover, each place once; at most 1, 0 without a page."""
    area = width * height
    covered = F.coalesce(_bind(clip_boxes(boxes, width, height), union_area), F.lit(0.0))
    return F.when(area > 0, F.least(F.lit(1.0), covered / area)).otherwise(0.0)


def text_density(chars: Column, width: Column, height: Column) -> Column:
    """Characters per square inch; without a page infinite if there is text, else 0."""
    area = width * height / POINTS_PER_SQUARE_INCH
    return F.when(width.isNull() | height.isNull(), F.when(chars > 0, float("inf")).otherwise(0.0)).when(area <= 0, 0.0).otherwise(chars / area)


def ocr_reason(suspicious: Column, chars: Column, density: Column, images: Column, coverage: Column) -> Column:
    """Why a page needs OCR, or native_text_trustworthy; the first rule that holds."""
    return (
        F.when(suspicious, "suspicious_or_broken_native_text")
        .when((chars == 0) & (images >= 1), "no_native_text_with_images")
        .when((coverage >= DOMINANT_COVERAGE) & ((chars < NATIVE_MIN_CHARS) | (density < DOMINANT_DENSITY)), "image_dominant_with_low_native_density")
        .when((images >= 2) & (coverage >= MULTI_COVERAGE) & ((chars < MULTI_CHARS) | (density < MULTI_DENSITY)), "multiple_images_with_incomplete_native_text")
        .otherwise("native_text_trustworthy")
    )


def heading_counts(text: Column) -> tuple[Column, Column]:
    """Article and paragraph heading lines of a page whose lines are normalised."""
    lines = F.split(text, "\n")
    count = lambda k: F.size(F.filter(lines, lambda x: x.rlike(HEADINGS[k]))).cast("long")
    return count("PASAL"), count("AYAT")


def analyze_pages(pages: DataFrame, mode: str = "hybrid") -> DataFrame:
    """(doc_id, page_number, text, page_w, page_h, boxes) with the analysis of each page.

    mode: hybrid decides by page, native and full_ocr override the decision and its reason.
    """
    if mode not in ("hybrid", "native", "full_ocr"):
        raise ValueError(f"unknown extraction mode {mode!r}")
    text = F.coalesce("text", F.lit(""))
    rows = pages.withColumn("native_chars", text_length(text)).withColumn("image_count", F.size(F.coalesce("boxes", F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))).cast("long"))
    rows = rows.withColumn("image_coverage", F.coalesce(image_coverage(F.col("boxes"), F.col("page_w"), F.col("page_h")), F.lit(0.0))).withColumn("text_density", text_density(F.col("native_chars"), F.col("page_w"), F.col("page_h")))
    pasal, ayat = heading_counts(text)
    rows = rows.withColumn("native_pasal_count", pasal).withColumn("native_ayat_count", ayat).withColumn("suspicious_text", suspicious_text(text))
    reason = ocr_reason(F.col("suspicious_text"), F.col("native_chars"), F.col("text_density"), F.col("image_count"), F.col("image_coverage"))
    fixed = {"native": "mode_native_only", "full_ocr": "mode_forced_full_ocr"}.get(mode)
    rows = rows.withColumn("decision_reason", F.lit(fixed) if fixed else reason)
    ocr = F.lit(mode == "full_ocr") if fixed else F.col("decision_reason") != "native_text_trustworthy"
    return rows.withColumn("should_ocr", ocr)


def choose_text(analyzed: DataFrame, ocr: DataFrame) -> DataFrame:
    """Final text of each page: OCR output (doc_id, page_number, ocr_text) where it is needed, in page order.

    An empty OCR result where OCR is needed leaves the text null: the page failed.
    """
    rows = analyzed.join(ocr.select("doc_id", "page_number", "ocr_text"), ["doc_id", "page_number"], "left")
    text = F.when(F.col("should_ocr"), F.nullif(F.trim("ocr_text"), F.lit(""))).otherwise(F.col("text"))
    return rows.withColumn("final_text", text).withColumn("final_extraction_mode", F.when(F.col("should_ocr"), "full_ocr").otherwise("native_text")).withColumn("final_chars", text_length(F.col("final_text"))).drop("ocr_text")
