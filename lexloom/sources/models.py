"""Connectors to models as vectorised functions: embedding, reranking, answering. The call itself is a parameter.

A connector is made once per task and given whole batches, so that one request serves many rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import SCOPE_SYSTEM_PROMPT, clean_answer, parse_scope, scope_prompt

Embed = Callable[[list[str]], list[tuple[list[float], dict[int, float]]]]


def embed_texts(rows: DataFrame, connect: Callable[[], Embed], *, id_col: str = "chunk_id", text_col: str = "text", batch: int = 8) -> DataFrame:
    """(id, dense, sparse) by batches of `batch` texts. A reply of another length than the request is an error."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = connect()
        for part in batches:
            ids, texts, out = part["id"].tolist(), part["text"].tolist(), []
            for a in range(0, len(texts), batch):
                got = embed(texts[a : a + batch])
                if len(got) != len(texts[a : a + batch]):
                    raise ValueError(f"{len(got)} embeddings for {len(texts[a : a + batch])} texts")
                out += got
            yield pd.DataFrame({"id": ids, "dense": [d for d, _ in out], "sparse": [{int(k): float(v) for k, v in s.items() if v} for _, s in out]})

    own = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, f"id {kind}, dense array<double>, sparse map<int,double>").withColumnRenamed("id", id_col)


def model_rerank(connect: Callable[[], Callable[[str, list[str]], list[float]]], *, question: str = "question", text: str = "text") -> Callable[[DataFrame], DataFrame]:
    """A scorer for fusion.rerank: the texts of a query go to the model together."""

    def score(candidates: DataFrame) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            got = connect()(rows[question].iloc[0], rows[text].tolist())
            if len(got) != len(rows):
                raise ValueError(f"{len(got)} scores for {len(rows)} texts")
            return rows.assign(rerank_score=[float(x) for x in got])

        # candidates are at most the fusion's limit per query, so a group is small
        return candidates.groupBy("query_id").applyInPandas(run, f"{fields}, rerank_score double")

    return score


def generate_answers(rows: DataFrame, connect: Callable[[], Callable[[str, str], str]]) -> DataFrame:
    """(query_id, answer) from (query_id, question, context), cleaned; an answer that is empty, then or before, is an error."""
    kind = rows.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = connect()
        for part in batches:
            answers = [ask(q, c) for q, c in zip(part["question"], part["context"], strict=True)]
            if any(not (a or "").strip() for a in answers):
                raise ValueError("the model gave an empty answer")
            yield pd.DataFrame({"query_id": part["query_id"], "answer": answers})

    out = rows.select("query_id", "question", "context").mapInPandas(run, f"query_id {kind}, answer string")
    out = out.withColumn("answer", clean_answer(F.col("answer")))
    return out.withColumn("answer", F.when(F.col("answer") == "", F.raise_error(F.lit("the model gave its reasoning only"))).otherwise(F.col("answer")))


def classify_scope(questions: DataFrame, connect: Callable[[], Callable[[str, str], str]]) -> DataFrame:
    """questions with in_scope, read from the model's replies to (system prompt, user prompt); a reply without a verdict is an error."""
    names = [f.name for f in questions.schema.fields]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in questions.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = connect()
        for part in batches:
            yield part.assign(__reply=[ask(SCOPE_SYSTEM_PROMPT, p) for p in part["__prompt"]]).drop(columns="__prompt")

    asked = questions.withColumn("__prompt", scope_prompt(F.col("question"))).mapInPandas(run, f"{kind}, __reply string")
    verdict = parse_scope(F.col("__reply"))
    return asked.select(*names, F.when(verdict.isNull(), F.raise_error(F.lit("a scope reply without a verdict"))).otherwise(verdict).alias("in_scope"))
