"""Rank fusion, reranking, thresholds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
CANDIDATES = 20
RERANKED = 7
MIN_SCORE = 0.05


def fuse_rrf(dense: DataFrame, sparse: DataFrame, *, k: int = RRF_K, limit: int = CANDIDATES, digits: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists of (query_id, id, score, rank) to (query_id, id, dense_score, sparse_score, rrf_score, position).

    A hit without an id takes up its rank and is left out. An id that is twice in a list counts twice and keeps the
    score it has last. Equal sums keep the order of first sight: the dense list by rank, then the sparse one.
    """
    both = dense.select("query_id", "id", "score", "rank", F.lit(0).alias("list")).unionByName(sparse.select("query_id", "id", "score", "rank", F.lit(1).alias("list"))).where(F.col("id").isNotNull())
    last = lambda n: F.coalesce(F.max_by(F.when(F.col("list") == n, F.col("score")), F.when(F.col("list") == n, F.col("rank"))), F.lit(0.0))
    # terms are added in a fixed order, so that sums do not depend on the partitioning
    terms = F.aggregate(F.sort_array(F.collect_list(1.0 / (k + F.col("rank")))), F.lit(0.0), lambda a, x: a + x)
    total = F.round(terms, digits) if digits is not None else terms
    rows = both.groupBy("query_id", "id").agg(last(0).alias("dense_score"), last(1).alias("sparse_score"), total.alias("rrf_score"), F.min(F.struct("list", "rank")).alias("seen"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "seen")
    return rows.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= limit).drop("seen")


def word_set(text: Column) -> Column:
    """The distinct lower-cased ASCII words of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), "[^a-z]+")), "")


def set_overlap(asked: Column, own: Column) -> Column:
    """Stand-in for a reranking model: part of the question's words that the text has."""
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, own)) / F.size(asked)).otherwise(0.0)


#: Hits on one text that meet it in one place, about.
HITS_AT_ONCE = 2_000


def with_words(hits: DataFrame, asked: DataFrame, own: DataFrame) -> DataFrame:
    """hits (query_id, id, ...) with the word sets of their question, asked (query_id, asked), and of their text, own (id, own).

    The best hits are the longest texts, and many questions have the same ones. So a question's words go to its hits, as
    one string, and a text's words never go with a hit; a text with many hits is laid out once for each HITS_AT_ONCE.
    """
    parts = hits.groupBy("id").agg((F.count(F.lit(1)) / HITS_AT_ONCE + 1).cast("long").alias("parts"))
    laid = own.join(parts, "id").select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "own")
    rows = hits.join(parts, "id").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts"))).drop("parts")
    rows = rows.join(asked.withColumn("asked", F.array_join("asked", " ")), "query_id").join(laid, ["id", "part"]).drop("part")
    return rows.withColumn("asked", F.array_remove(F.split("asked", " "), ""))


def overlap_score(question: Column, text: Column) -> Column:
    return set_overlap(word_set(question), word_set(text))


def rerank(candidates: DataFrame, score: Callable[[DataFrame], DataFrame] | Column, *, top: int = RERANKED, min_score: float = MIN_SCORE) -> DataFrame:
    """The best `top` candidates of each query by rerank_score, then those of at least min_score; ties keep the fused position.

    score: a column, or a function that adds rerank_score (for instance by a vectorised UDF that calls a model).
    """
    rows = candidates.withColumn("rerank_score", score) if isinstance(score, Column) else score(candidates)
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "position")
    return rows.withColumn("rerank_rank", F.row_number().over(w).cast("long")).where((F.col("rerank_rank") <= top) & (F.col("rerank_score") >= min_score))
