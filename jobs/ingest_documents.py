"""Incremental ingestion: new document files become cleaned, bounded, citable chunks, each distinct text once.

    python -m jobs.ingest_documents --source in/documents --target out --checkpoint out/_checkpoint --config jobs/ingest_documents.json

A file stream with a checkpoint takes the files that no run has taken yet and ends when there are no more. A batch is
written under its number, chunks first and documents after them; a batch that is run again overwrites what it left. So a
run after a failure, or one without new files, gives the same tables.

target/chunks, by batch and language: document_hash, kind (article or page), pasal, ayat, part, page_start, page_end, text.
target/documents, by batch: doc_id, document_hash, lang, source, n_chars, n_pages, status, duplicate_of, n_chunks, error.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs import common
from lexloom.jobs.ingest import NO_CHUNKS
from lexloom.operators.segment import chunk_documents, pack_sections, parser_lines
from lexloom.sources.tables import stored

logger = logging.getLogger("ingest_documents")

SOURCE = "doc_id long, text string, lang string, source string"
CHUNKS = "document_hash string, kind string, pasal string, ayat string, part int, page_start int, page_end int, text string"
DOCUMENTS = "doc_id long, document_hash string, lang string, source string, n_chars long, n_pages int, status string, duplicate_of long, n_chunks long, error string"


@dataclass(frozen=True)
class Config:
    """Lines of a page of text, characters of a chunk, files that a batch takes at most."""

    lines_per_page: int = 12
    max_chars: int = 1000
    max_files_per_batch: int = 1000


def pages(texts: DataFrame, lines_per_page: int) -> DataFrame:
    """(document_hash, text) to (doc_id, filename, page_number, text), doc_id and filename the hash; pages of so many lines."""
    lines = F.split("text", "\n", -1)
    starts = lambda x: F.sequence(F.lit(0), F.floor((F.size(x) - 1) / lines_per_page).cast("int"))
    # the lines are bound once, not split anew for each page
    cut = F.transform(F.array(lines), lambda x: F.transform(starts(x), lambda i: F.array_join(F.slice(x, i * lines_per_page + 1, lines_per_page), "\n")))
    out = texts.select("document_hash", F.posexplode(cut[0]).alias("i", "text"))
    return out.select(F.col("document_hash").alias("doc_id"), F.col("document_hash").alias("filename"), (F.col("i") + 1).alias("page_number"), "text")


def page_chunks(lines: DataFrame, max_chars: int) -> DataFrame:
    """Chunks of documents without articles: the words of a page packed, never across pages."""
    words = lambda s: F.array_remove(F.split(s["line"], r"\s+"), "")
    found = lines.groupBy("doc_id", "page_number").agg(F.first("language").alias("language"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    none = F.lit(None).cast("string")
    found = found.select("doc_id", F.col("page_number").alias("section"), F.lit(0).alias("bab_no"), none.alias("bab"), none.alias("pasal"), none.alias("ayat"), "language", F.flatten(F.transform("x", words)).alias("words"))
    found = found.where(F.size("words") > 0).withColumn("pages", F.array_repeat("section", F.size("words")))
    part = F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "k"))
    return pack_sections(found, max_chars, "language").select("doc_id", F.lit("page").alias("kind"), "pasal", "ayat", part.alias("part"), F.col("section").alias("page_start"), F.col("section").alias("page_end"), "text", "language")


def chunks(texts: DataFrame, config: Config) -> DataFrame:
    """Chunks of (document_hash, text, language): by article where a text has articles, otherwise by page.

    The language goes with the lines, so that finished chunks do not move once more to get it.
    """
    paged = pages(texts, config.lines_per_page)
    lines = stored(parser_lines(paged), "ingest-lines")
    articles = stored(chunk_documents(paged, config.max_chars, lines=lines), "ingest-articles")
    languages = texts.select(F.col("document_hash").alias("doc_id"), "language")
    without = languages.join(articles.select("doc_id").distinct(), "doc_id", "left_anti")
    others = page_chunks(lines.repartition("doc_id").join(without, "doc_id"), config.max_chars)
    own = ["pasal", "ayat", "part", "page_start", "page_end", "text", "language"]
    out = articles.join(languages, "doc_id").select("doc_id", F.lit("article").alias("kind"), *own).unionByName(others)
    return out.withColumnRenamed("doc_id", "document_hash")


def take(docs: DataFrame, batch: int, target: str, config: Config) -> None:
    """One batch of documents, (doc_id, text, lang, source)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    lines = F.size(F.split(text, "\n", -1))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "lang", "source")
    rows = docs.select("doc_id", "lang", "source", F.sha2(text, 256).alias("document_hash"), F.length(text).cast("long").alias("n_chars"), F.ceil(lines / config.lines_per_page).cast("int").alias("n_pages"), text.alias("text"), order.alias("order"))
    # copies are folded where they are read, so a text that a third of the rows has is one row of each task
    first = rows.groupBy("document_hash").agg(F.min("order").alias("order"), F.first("text").alias("text"))
    known = spark.read.schema(DOCUMENTS + ", batch int").parquet(f"{target}/documents").where((F.col("batch") < batch) & (F.col("status") == "completed")) if batch else spark.createDataFrame([], DOCUMENTS)
    known = known.select("document_hash", F.col("doc_id").alias("known_as"))
    new = first.join(known, "document_hash", "left").where("known_as IS NULL").select("document_hash", "text", F.coalesce(F.nullif(F.lower("order.lang"), F.lit("")), F.lit("unknown")).alias("language"))
    new.write.mode("overwrite").parquet(f"{target}/_new_texts")
    new = spark.read.schema(new.schema).parquet(f"{target}/_new_texts")
    out = f"{target}/chunks/batch={batch}"
    chunks(new, config).write.mode("overwrite").partitionBy("language").parquet(out)
    counts = spark.read.schema(CHUNKS + ", language string").parquet(out).groupBy("document_hash").agg(F.count(F.lit(1)).alias("n"))

    facts = first.select("document_hash", F.col("order").alias("first")).join(known, "document_hash", "left").join(counts, "document_hash", "left")
    is_known, fails = F.col("known_as").isNotNull(), F.col("n").isNull() & F.col("known_as").isNull()
    is_first = F.col("order").eqNullSafe(F.col("first"))
    status = F.when(fails, "failed").when(~is_known & is_first, "completed").otherwise("duplicate")
    done = rows.drop("text").distinct().join(facts, "document_hash").withColumn("status", status)
    result = done.select(
        "doc_id", "document_hash", "lang", "source", "n_chars", "n_pages", "status",
        F.when(F.col("status") == "duplicate", F.coalesce("known_as", F.col("first.doc_id"))).alias("duplicate_of"),
        F.when(F.col("status") == "completed", F.col("n")).otherwise(0).cast("long").alias("n_chunks"), F.when(fails, NO_CHUNKS).alias("error"),
    )
    result.write.mode("overwrite").parquet(f"{target}/documents/batch={batch}")
    written = spark.read.schema(DOCUMENTS).parquet(f"{target}/documents/batch={batch}")
    found = common.tally(written, "status")
    n_chunks = written.agg(F.sum("n_chunks")).first()[0] or 0
    logger.info("batch %d: read %d documents (%s); wrote %d chunks to %s", batch, sum(found.values()), ", ".join(f"{n} {k}" for k, n in found.items()), n_chunks, out)


def output(spark: SparkSession, target: str) -> DataFrame:
    """All documents of all batches with the chunks of those that have some; nothing where no batch has been."""
    docs = spark.read.schema(DOCUMENTS + ", batch int").parquet(f"{target}/documents").drop("batch")
    texts = spark.read.schema(CHUNKS + ", batch int, language string").parquet(f"{target}/chunks").drop("batch", "language")
    texts = texts.withColumn("status", F.lit("completed"))
    return docs.join(texts, ["document_hash", "status"], "left")


def run(spark: SparkSession, source: str, target: str, checkpoint: str, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Takes what is new in `source` (a folder of Parquet files, or a pattern of paths; a single file needs a pattern) and returns the whole output.

    Rows that are equal in id, text, language and source are one. A text that has been completed before, or has a row
    with a smaller id in its batch (a null id comes last), is a duplicate of that. Texts that give no chunk, as null and
    empty ones do, fail, each copy of them. Files need the columns doc_id, text, lang, source; others are not read.
    """
    stream = spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", config.max_files_per_batch).parquet(source)
    work = stream.writeStream.foreachBatch(lambda docs, batch: take(docs, batch, target, config))
    query = work.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    logger.info("%s: %d batches in this run", source, sum(1 for p in query.recentProgress if p["numInputRows"]))
    return output(spark, target)


def main() -> None:
    given = common.arguments(__doc__, "source", "target", "checkpoint")
    spark = common.session("ingest_documents", given.shared)
    try:
        run(spark, given.source, given.target, given.checkpoint, common.config(spark, given.config, Config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
