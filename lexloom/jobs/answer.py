"""The query job: questions to scope, search, fusion, reranking, context, answers and citations, for many questions at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import INSUFFICIENT_EVIDENCE, OUT_OF_SCOPE, append_citations, normalize_query, normalize_questions, question_ok, rewrite_query
from lexloom.operators import context, fusion
from lexloom.sources.models import Embed, classify_scope, embed_texts, generate_answers
from lexloom.sources.sinks import Collection
from lexloom.sources.tables import stored

INVALID = "a question has 1 to 2000 characters and is not blank"


@dataclass
class Models:
    """Connectors, each made once per task: scope and generate take (system prompt or question, prompt or context), embed takes texts; rerank is a column or a scorer for fusion.rerank over question and text."""

    embed: Callable[[], Embed]
    rerank: Column | Callable[[DataFrame], DataFrame]
    generate: Callable[[], Callable[[str, str], str]]
    scope: Callable[[], Callable[[str, str], str]] | None = None


def retrieve(questions: DataFrame, collection: Collection, models: Models, *, limit: int = fusion.CANDIDATES, k: int = fusion.RRF_K, digits: int | None = None) -> DataFrame:
    """(query_id, question, id, position, rrf_score, payload fields): the fused candidates of (query_id, rewritten) rows."""
    asked = stored(embed_texts(questions, models.embed, id_col="query_id", text_col="rewritten"), "asked")
    lists = [collection.search(name, asked.select("query_id", name), limit, digits=digits) for name in ("dense", "sparse")]
    if any(dict(x.dtypes)["payload"] == "string" for x in lists):  # an empty collection
        return lists[0].where("false").select("query_id", F.lit("").alias("question"), "id", F.lit(0).alias("position"))
    # the chunk's id, else the point's
    named = [stored(x.withColumn("id", F.coalesce(F.nullif("payload.chunk_id", F.lit("")), "id")), f"hits-{i}") for i, x in enumerate(lists)]
    fused = fusion.fuse_rrf(*named, k=k, limit=limit, digits=digits)
    both = named[0].withColumn("list", F.lit(0)).unionByName(named[1].withColumn("list", F.lit(1)))
    payloads = both.groupBy("query_id", "id").agg(F.min_by("payload", F.struct("list", "rank")).alias("payload"))
    rows = fused.join(payloads, ["query_id", "id"]).join(questions.select("query_id", F.col("rewritten").alias("question")), "query_id")
    return rows.select("query_id", "question", "id", "position", "rrf_score", "payload.*")


def answer_questions(questions: DataFrame, collection: Collection, models: Models, *, limit: int = fusion.CANDIDATES, top: int = fusion.RERANKED, min_score: float = fusion.MIN_SCORE, k: int = fusion.RRF_K, digits: int | None = None) -> DataFrame:
    """One row per question (query_id, question): answer, sources, in_scope, normalized, rewritten, candidate_chunks, reranked_chunks, error.

    A question out of scope, or without evidence, gets the fixed answer and no sources; neither reaches the answering model.
    A question that is not valid has an error and no answer. Ids are unique.
    """
    rows = normalize_questions(questions.select("query_id", "question", F.col("question").alias("nfkc")), "nfkc")
    rows = stored(rows.select("query_id", "question", question_ok(F.col("question")).alias("ok"), normalize_query(F.col("nfkc")).alias("normalized"), rewrite_query(F.col("nfkc")).alias("rewritten")), "questions")
    valid = rows.where("ok").drop("ok")
    scoped = stored(classify_scope(valid, models.scope) if models.scope else valid.withColumn("in_scope", F.lit(True)), "scoped")
    candidates = stored(retrieve(scoped.where("in_scope"), collection, models, limit=limit, k=k, digits=digits), "candidates")
    found = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidate_chunks"))
    out = rows.join(scoped.select("query_id", "in_scope"), "query_id", "left").join(found, "query_id", "left")
    if candidates.limit(1).count():
        best = stored(fusion.rerank(candidates, models.rerank, top=top, min_score=min_score), "reranked")
        expanded = context.expand_parents(best, context.parent_texts(collection.read(), best))
        prompts = context.build_context(expanded).join(rows.select("query_id", F.col("normalized").alias("question")), "query_id")
        prompts = stored(prompts, "prompts")
        answers = generate_answers(prompts, models.generate).join(prompts.select("query_id", "n_sources"), "query_id").withColumn("answer", append_citations(F.col("answer"), F.col("n_sources")))
        cited = context.sources(best)
        cited = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in cited.columns if c != "query_id"]))).alias("sources"))
        out = out.join(answers, "query_id", "left").join(cited, "query_id", "left")
    else:
        out = out.withColumn("n_sources", F.lit(0).cast("long")).withColumn("answer", F.lit(None).cast("string")).withColumn("sources", F.array().cast("array<string>"))
    fixed = F.when(~F.col("ok"), F.lit(None).cast("string")).when(~F.col("in_scope"), OUT_OF_SCOPE).otherwise(F.coalesce("answer", F.lit(INSUFFICIENT_EVIDENCE)))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(
        "query_id", "question", fixed.alias("answer"), F.coalesce("sources", F.array()).alias("sources"), "in_scope", "normalized", "rewritten",
        count("candidate_chunks").alias("candidate_chunks"), count("n_sources").alias("reranked_chunks"), F.when(~F.col("ok"), INVALID).alias("error"),
    )
