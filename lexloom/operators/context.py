"""Parent context, prompt context, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import page_label

PARENT_CHUNKS = 64
PARENT_CHARS = 6000


def parent_texts(chunks: DataFrame, hits: DataFrame, *, limit: int = PARENT_CHUNKS, max_chars: int = PARENT_CHARS) -> DataFrame:
    """(filename, pasal, parent_text) of the parents that hits name: their first chunks by id as text, joined and cut."""
    keys = hits.select("filename", "pasal").where("filename <> '' and pasal <> ''").distinct()
    own = chunks.join(keys, ["filename", "pasal"], "left_semi").withColumn("__n", F.row_number().over(Window.partitionBy("filename", "pasal").orderBy("chunk_id"))).where(F.col("__n") <= limit)
    own = own.withColumn("__t", F.trim("text")).where("__t <> ''")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "__t"))), lambda x: x["__t"]), "\n")
    return own.groupBy("filename", "pasal").agg(F.substring(joined, 1, max_chars).alias("parent_text"))


def expand_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Adds context_text: the parent's text for the first hit of each parent of a query, else the hit's own."""
    first = F.row_number().over(Window.partitionBy("query_id", "filename", "pasal").orderBy("rerank_rank")) == 1
    rows = hits.withColumn("__first", first).join(parents, ["filename", "pasal"], "left")
    return rows.withColumn("context_text", F.when(F.col("__first"), F.coalesce(F.nullif("parent_text", F.lit("")), F.trim("text"))).otherwise(F.trim("text"))).drop("__first", "parent_text")


def _article(name: str, x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{name} "), x))


def build_context(expanded: DataFrame) -> DataFrame:
    """(query_id, n_sources, context): numbered, labelled texts in rerank order."""
    label = F.concat_ws(" · ", F.nullif(F.col("filename"), F.lit("")), F.concat(F.lit("halaman "), page_label(F.col("page_start"), F.col("page_end"))), _article("Pasal", F.col("pasal")), _article("Ayat", F.col("ayat")))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rerank_rank"))
    rows = expanded.withColumn("__n", number).withColumn("__s", F.concat(F.lit("["), F.col("__n").cast("string"), F.lit("] "), label, F.lit("\n"), F.col("context_text")))
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sources"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", "__s"))), lambda x: x["__s"]), "\n\n").alias("context"))


def sources(expanded: DataFrame) -> DataFrame:
    """One citation per hit, numbered as in the context. page_end only where it differs from page; article and paragraph where not null."""
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rerank_rank")).cast("long")
    return expanded.select(
        "query_id", number.alias("id"), F.col("filename").alias("document"), F.col("page_start").alias("page"), F.when(F.col("page_end") != F.col("page_start"), F.col("page_end")).alias("page_end"), "chunk_id", F.trim("text").alias("text"),
        F.round("rerank_score", 6).alias("rerank_score"), F.nullif("bab", F.lit("")).alias("chapter"), F.when(F.col("pasal").isNotNull(), F.concat(F.lit("Pasal "), "pasal")).alias("article"), F.when(F.col("ayat").isNotNull(), F.concat(F.lit("Ayat "), "ayat")).alias("paragraph"),
    )
