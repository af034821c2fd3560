"""A training corpus from `documents` in five stages; each is written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last return doc_id, text, lang,
source, n_chars. Rows with a null text count as empty ones, which the quality rules reject.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import pii
from lexloom.llm.common import attach, numbered, stored, table
from lexloom.llm.components import connected_components
from lexloom.llm.decontaminate import find_contamination
from lexloom.llm.packing import pack_documents
from lexloom.llm.quality_rules import judge
from lexloom.llm.queries import vocabulary
from lexloom.llm.simhash import near_duplicates
from lexloom.llm.similar import similar_links

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Pieces of text that a packing worker keeps: fewer than op10 alone, as the workers of other stages stay beside it.
KEPT_PIECES = 200_000


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return docs.select(*[new.get(c, F.col(c)).alias(c) for c in COLUMNS])


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Numbered rows but those whose number is among the dropped ones (one column, row); without the numbers."""
    return attach(rows, stored(dropped, "dropped"), ["row"], "left_anti").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, failing lines of the others too."""
    return _with_text(judge(docs.select(*COLUMNS)).where("kept"), "clean_text")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one row stays: that of the smallest id, a null id last; of rows with that id the first one read.

    Groups are chains of documents whose five-word shingles have a Jaccard similarity of 0.8 or more, or whose SimHash
    fingerprints differ in four bits or fewer. Rows are numbered, so that repeated and missing ids make no difference.
    """
    rows = numbered(docs.select(*COLUMNS), "near")
    prints = near_duplicates(rows, id_col="row").where("row <> component_id").select(F.col("component_id").alias("a"), F.col("row").alias("b"))
    groups = connected_components(similar_links(rows, id_col="row").unionByName(prints)).withColumnRenamed("node", "row")
    members = stored(attach(rows.select("row", "doc_id"), groups, ["row"], "inner"), "members")
    first = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    return _without(rows, members.select("row").join(first.select("row"), "row", "left_anti"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, each row judged by its own text."""
    rows = numbered(docs.select(*COLUMNS), "judged")
    return _without(rows, find_contamination(rows, table(spark, sf_dir, "benchmark"), id_col="row").where("contaminated").select("row"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _with_text(pii.redact(pii.find_pii(docs.select(*COLUMNS))), "text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, kept_pieces=KEPT_PIECES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii_redaction", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: Tokenising and packing have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
