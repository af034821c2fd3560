"""Queries on retrieval: vectors, fusion, reranking, context, citations, question and answer text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import INSUFFICIENT_EVIDENCE, OUT_OF_SCOPE, append_citations, clean_answer, normalize_query, parse_scope, question_ok, rewrite_query, text_length
from lexloom.jobs import answer
from lexloom.operators import context, fusion, vectors
from lexloom.plans.fixtures import HITS_SQL, citation_hits, table
from lexloom.sources.sinks import Collection
from lexloom.sources.tables import new_folder, spread, stored

#: Queries are the rows whose id is divisible by this; they are searched for in all rows.
EVERY = 20


def _dense(spark: SparkSession, sf_dir: str, limit: int = 20) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))
    return vectors.dense_top_k(points, points.where(F.col("id") % EVERY == 0).withColumnRenamed("id", "query_id"), limit, digits=6)


def _sparse(spark: SparkSession, sf_dir: str, limit: int = 20) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = stored(vectors.term_vectors(docs, "doc_id"), "terms")
    asked = own.where(F.col("id") % EVERY == 0).withColumnRenamed("id", "query_id")
    return vectors.sparse_top_k(spread(own), asked, own.count(), limit, digits=6)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir)


def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir)


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lists fused; every 97th id stands for a hit that the store gives without one (P10)."""
    nameless = lambda hits: hits.withColumn("id", F.when(F.col("id") % 97 != 0, F.col("id")))
    return fusion.fuse_rrf(nameless(_dense(spark, sf_dir)), nameless(_sparse(spark, sf_dir)), digits=9)


#: Texts that are picked by a broadcast of their ids, at most.
BROADCAST_IDS = 1_000_000


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused list is stored once; each text that it names is cut into words once, and hits get their scores where those are."""
    fused = stored(hybrid_rrf(spark, sf_dir).select("query_id", "id", "position"), "fused")
    named = stored(fused.select(F.col("id").alias("doc_id")).union(fused.select("query_id")).distinct(), "named")
    named = F.broadcast(named) if named.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else named
    words = stored(table(spark, sf_dir, "documents").join(named, "doc_id", "left_semi").select("doc_id", fusion.word_set(F.col("text")).alias("words")), "words")
    rows = fusion.with_words(fused, words.select(F.col("doc_id").alias("query_id"), F.col("words").alias("asked")), words.select(F.col("doc_id").alias("id"), F.col("words").alias("own")))
    return fusion.rerank(rows, F.round(fusion.set_overlap(F.col("asked"), F.col("own")), 6))


def rerank_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select("query_id", "id", "rerank_score", "rerank_rank")


def no_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions left without a hit get the fixed answer."""
    asked = table(spark, sf_dir, "documents").where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"))
    kept = rerank_threshold(spark, sf_dir).where("rerank_score >= 0.6").groupBy("query_id").agg(F.count(F.lit(1)).alias("reranked_chunks"))
    rows = asked.join(kept, "query_id", "left").withColumn("reranked_chunks", F.coalesce("reranked_chunks", F.lit(0).cast("long")))
    return rows.withColumn("answer", F.when(F.col("reranked_chunks") == 0, INSUFFICIENT_EVIDENCE).otherwise("generated"))


def _expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = citation_hits(spark, sf_dir)
    return context.expand_parents(hits, context.parent_texts(hits, hits))


def parent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir).select("query_id", "rerank_rank", "filename", "pasal", "context_text")


def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.build_context(_expanded(spark, sf_dir))


def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.sources(citation_hits(spark, sf_dir))


def _questions(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    i = F.col("item_id")
    tail = F.when(i % 3 == 0, F.concat(F.lit(" PASAL"), (i % 90).cast("string"), F.lit("A  ayat ( "), (i % 7).cast("string"), F.lit(" ) apa"))).when(i % 3 == 1, "  pasal 5 b").otherwise("  \t ")
    return table(spark, sf_dir, "benchmark").select(i, F.concat(F.lit("  "), text, tail).alias("question"))


def _rewritten(questions: DataFrame) -> DataFrame:
    q = F.col("question")
    return questions.select("item_id", normalize_query(q).alias("normalized"), rewrite_query(q).alias("rewritten"), text_length(q).alias("n"), question_ok(q).alias("ok"))


def query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(_questions(spark, sf_dir, F.col("text")))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("conv_id") * 100 + F.col("turn")
    reply = (
        F.when(i % 6 == 0, F.concat(F.lit("<think>plan\n"), F.col("text"), F.lit("</think>\n\n\n\n# "), F.col("text")))
        .when(i % 6 == 1, F.concat(F.col("text"), F.lit("<THINK>never closed"), F.col("text")))
        .when(i % 6 == 2, F.concat(F.lit("## **Bold** __under__\n\n\n\n"), F.col("text"), F.lit(" [1]")))
        .when(i % 6 == 3, '```json\n{"is_labor_law": true}\n```')
        .when(i % 6 == 4, F.concat(F.lit('Well: {"is_labor_law": false} '), F.lit("ok")))
        .otherwise('{"is_labor_law": "yes"}')
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", i.alias("i"), reply.alias("reply"))


def answer_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("conv_id", "turn", clean_answer(F.col("reply")).alias("answer"))


def citation_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("conv_id", "turn", append_citations(clean_answer(F.col("reply")), F.col("i") % 5).alias("answer"))


def scope_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = parse_scope(F.col("reply"))
    return _replies(spark, sf_dir).select("conv_id", "turn", scope.alias("in_scope"), F.when(scope, F.lit(None).cast("string")).otherwise(OUT_OF_SCOPE).alias("refusal"))


#: Length of the made-up dense vectors of the query job.
DIMENSIONS = 16


def _lexicon():
    """A stand-in for an embedding model: vectors that follow from the number in `Pertanyaan n`."""

    def embed(texts: list[str]) -> list[tuple[list[float], dict[int, float]]]:
        ids = [int(re.search(r"Pertanyaan (\d+)", t)[1]) for t in texts]
        return [([float((n * 7 + i * 13) % 17 - 8) for i in range(DIMENSIONS)], {i: float((n + i) % 5) for i in range(DIMENSIONS)}) for n in ids]

    return embed


def _gate():
    return lambda system, prompt: '{"is_labor_law": false}' if int(re.search(r"Pertanyaan (\d+)", prompt)[1]) % 7 == 0 else '```json\n{"is_labor_law": true}\n```'


def _writer():
    return lambda question, context: f"<think>hm</think>**n**: {len(context)}{' [1]' if len(context) % 2 else ''}"


def answer_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole query job over stored chunks, searched in the store: every 20th document asks, some out of scope, some blank."""
    d = F.col("doc_id")
    hits = citation_hits(spark, sf_dir).drop("query_id", "rerank_rank", "rerank_score").withColumn("doc_id", F.substring("chunk_id", 2, 20).cast("long")).where("trim(text) <> ''")
    hits = hits.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    steps = F.sequence(F.lit(0), F.lit(DIMENSIONS - 1))
    dense = F.transform(steps, lambda i: ((d * 7 + i * 13) % 17 - 8).cast("double"))
    sparse = F.map_filter(F.map_from_arrays(steps, F.transform(steps, lambda i: ((d + i) % 5).cast("double"))), lambda k, v: v != 0)
    points = Collection(spark, new_folder(spark, "points"), DIMENSIONS)
    points.upsert(hits.withColumn("dense", dense).withColumn("sparse", sparse), "ing1", "made-up")
    asked = hits.where(d % EVERY == 0).select(d.alias("query_id"), F.when(d % 60 == 0, "  ").otherwise(F.concat(F.lit("Pertanyaan "), d.cast("string"), F.lit(" tentang  pasal"), (d % 9).cast("string"))).alias("question"))
    models = answer.Models(embed=lambda: _lexicon(), rerank=(F.length("text") % 100) / 100, generate=lambda: _writer(), scope=lambda: _gate())
    out = answer.answer_questions(asked, points, models, digits=9)
    cited = F.array_join(F.transform("sources", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["chunk_id"])), ",")
    return out.select("query_id", "answer", "in_scope", "normalized", "rewritten", "candidate_chunks", "reranked_chunks", "error", cited.alias("sources"))


def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense search in the store with payloads; embeddings as points."""
    points = Collection(spark, new_folder(spark, "points"), 64)
    rows = table(spark, sf_dir, "embeddings")
    chunks = rows.select(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"), F.col("embedding").cast("array<double>").alias("dense"))
    points.upsert(chunks, "ing1", "given")
    asked = rows.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("dense"))
    return points.search("dense", asked, 5, digits=6).select("query_id", "rank", "score", "id", "payload.chunk_id", "payload.text")


def vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16, F17 on the embeddings: all their values as a sparse map, numbered from the end, every third one made zero."""
    v = F.col("embedding")
    values = F.transform(v, lambda x, i: F.when((F.col("vec_id") + i) % 3 == 0, 0.0).otherwise(x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").withColumn("w", F.map_from_arrays(F.reverse(F.sequence(F.lit(0), F.size(v) - 1)), values))
    indices, values = vectors.parse_sparse(F.col("w"))
    return rows.select("vec_id", vectors.dense_ok(v).alias("dense_ok"), vectors.sparse_ok(F.col("w")).alias("sparse_ok"), F.array_join(F.transform(indices, lambda x: x.cast("string")), ",").alias("indices"), F.size(values).cast("long").alias("n"))


QUERIES = {f.__name__: f for f in (dense_topk, sparse_topk, hybrid_rrf, rerank_threshold, no_evidence, parent_context, prompt_context, source_list, query_rewrite, answer_clean, citation_append, scope_parse, vector_checks, store_search, answer_job)}

_DENSE = r"""
dense AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::BIGINT AS rank FROM
  (SELECT q.vec_id AS query_id, p.vec_id AS id, round(list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings p, embeddings q WHERE q.vec_id % 20 = 0) QUALIFY rank <= 20)"""
_SPARSE = r"""
tok AS (SELECT doc_id AS id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS term FROM documents) GROUP BY ALL),
df AS (SELECT term, ln(1 + ((SELECT count(*) FROM documents)::DOUBLE - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tok GROUP BY term),
sparse AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::BIGINT AS rank FROM
  (SELECT q.id AS query_id, t.id, round(sum(t.tf * q.tf * idf), 6) AS score FROM tok q JOIN tok t ON q.term = t.term JOIN df ON df.term = t.term WHERE q.id % 20 = 0 GROUP BY ALL) QUALIFY rank <= 20)"""
_FUSED = _DENSE + "," + _SPARSE + r""",
both_lists AS (SELECT *, 0 AS list FROM dense WHERE id % 97 <> 0 UNION ALL SELECT *, 1 AS list FROM sparse WHERE id % 97 <> 0),
fused AS (SELECT query_id, id, coalesce(max(CASE WHEN list = 0 THEN score END), 0.0::DOUBLE) AS dense_score, coalesce(max(CASE WHEN list = 1 THEN score END), 0.0::DOUBLE) AS sparse_score, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score, min(list * 1000 + rank) AS seen FROM both_lists GROUP BY query_id, id),
hybrid AS (SELECT query_id, id, dense_score, sparse_score, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, seen)::BIGINT AS position FROM fused QUALIFY position <= 20)"""
_RERANKED = _FUSED + r""",
words AS (SELECT doc_id, list_filter(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+')), lambda x: x <> '') AS w FROM documents),
scored AS (SELECT h.query_id, h.id, h.position, round(CASE WHEN len(q.w) > 0 THEN len(list_intersect(q.w, t.w))::DOUBLE / len(q.w) ELSE 0.0 END, 6) AS rerank_score FROM hybrid h JOIN words t ON t.doc_id = h.id JOIN words q ON q.doc_id = h.query_id),
reranked AS (SELECT query_id, id, rerank_score, rerank_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, position)::BIGINT AS rerank_rank FROM scored) WHERE rerank_rank <= 7 AND rerank_score >= 0.05)"""
_REPLIES = r"""
replies AS (SELECT conv_id, turn, conv_id * 100 + turn AS i, CASE (conv_id * 100 + turn) % 6
  WHEN 0 THEN '<think>plan' || chr(10) || text || '</think>' || repeat(chr(10), 4) || '# ' || text WHEN 1 THEN text || '<THINK>never closed' || text WHEN 2 THEN '## **Bold** __under__' || repeat(chr(10), 4) || text || ' [1]'
  WHEN 3 THEN '```json' || chr(10) || '{"is_labor_law": true}' || chr(10) || '```' WHEN 4 THEN 'Well: {"is_labor_law": false} ok' ELSE '{"is_labor_law": "yes"}' END AS reply FROM conversations),
bare AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(reply, '(?is)<think>.*?(?:</think>|\z)', '', 'g'), '(?i)</?think>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM replies),
answers AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\*\*|__', '', 'g'), '(?m)^#{1,6}\s*', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS answer FROM bare)"""

_UUID = r"""substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""
_POINT = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('ing1:c' || {})) AS h"
_ANSWERS = rf"""WITH h AS (SELECT doc_id AS pid, 'c' || doc_id AS chunk_id, lang || '.pdf' AS filename, CASE WHEN doc_id % 11 <> 0 THEN source END AS pasal, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 7)::VARCHAR END AS ayat, text,
  (doc_id % 40 + 1)::INTEGER AS page_start, (doc_id % 40 + 1 + doc_id % 2)::INTEGER AS page_end, {_POINT.format('doc_id')} FROM documents WHERE trim(text) <> '' AND doc_id IN (SELECT vec_id FROM embeddings)),
pts AS (SELECT *, {_UUID} AS id, list_transform(range(16), lambda i: ((pid * 7 + i * 13) % 17 - 8)::DOUBLE) AS v FROM h),
all_asked AS (SELECT pid AS query_id, v, pid % 60 <> 0 AS ok, CASE WHEN pid % 60 = 0 THEN '' ELSE 'Pertanyaan ' || pid || ' tentang Pasal ' || (pid % 9) END AS normalized FROM pts WHERE pid % 20 = 0),
questions AS (SELECT *, normalized || CASE WHEN ok THEN ' ketentuan dalam peraturan ketenagakerjaan' ELSE ' menurut peraturan ketenagakerjaan Indonesia' END AS rewritten, CASE WHEN ok THEN query_id % 7 <> 0 END AS in_scope FROM all_asked),
asked AS (SELECT * FROM questions WHERE in_scope),
terms AS (SELECT pid, id, i, ((pid + i) % 5)::DOUBLE AS w FROM (SELECT pid, id, unnest(range(16)) AS i FROM pts) WHERE (pid + i) % 5 <> 0),
df AS (SELECT i, ln(1 + ((SELECT count(*) FROM pts)::DOUBLE - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM terms GROUP BY i),
dense AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::BIGINT AS rank FROM (SELECT query_id, p.id, p.chunk_id, round(list_cosine_similarity(p.v, q.v), 9) AS score FROM pts p, asked q) QUALIFY rank <= 20),
sparse AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::BIGINT AS rank FROM (SELECT a.query_id, t.id, round(sum(t.w * q.w * idf), 9) AS score FROM asked a JOIN terms q ON q.pid = a.query_id JOIN terms t ON t.i = q.i JOIN df ON df.i = t.i GROUP BY ALL) QUALIFY rank <= 20),
lists AS (SELECT query_id, chunk_id, rank, 0 AS list FROM dense UNION ALL SELECT query_id, chunk_id, rank, 1 FROM sparse JOIN pts ON pts.id = sparse.id),
fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min(list * 1000 + rank) AS seen FROM lists GROUP BY ALL),
candidates AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, seen) AS position FROM fused QUALIFY position <= 20),
rated AS (SELECT c.*, p.* EXCLUDE (chunk_id), (length(text) % 100)::DOUBLE / 100 AS rerank_score FROM candidates c JOIN pts p ON p.chunk_id = c.chunk_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, position) AS rerank_rank FROM rated) WHERE rerank_rank <= 7 AND rerank_score >= 0.05),
parent_rows AS (SELECT filename, pasal, chunk_id, trim(text) AS t FROM pts WHERE filename <> '' AND pasal <> '' QUALIFY row_number() OVER (PARTITION BY filename, pasal ORDER BY chunk_id) <= 64),
parents AS (SELECT filename, pasal, substr(string_agg(t, chr(10) ORDER BY chunk_id), 1, 6000) AS parent_text FROM parent_rows WHERE t <> '' GROUP BY filename, pasal),
expanded AS (SELECT b.*, CASE WHEN row_number() OVER (PARTITION BY query_id, b.filename, b.pasal ORDER BY rerank_rank) = 1 THEN coalesce(nullif(parent_text, ''), trim(text)) ELSE trim(text) END AS context_text, row_number() OVER (PARTITION BY query_id ORDER BY rerank_rank) AS n FROM best b LEFT JOIN parents p ON b.filename = p.filename AND b.pasal = p.pasal),
prompts AS (SELECT query_id, count(*) AS n, string_agg(n || ':' || chunk_id, ',' ORDER BY n) AS sources, length(string_agg('[' || n || '] ' || concat_ws(' · ', nullif(filename, ''), 'halaman ' || CASE WHEN page_start = page_end THEN page_start::VARCHAR ELSE page_start || '-' || page_end END,
  CASE WHEN coalesce(pasal, '') <> '' THEN 'Pasal ' || pasal END, CASE WHEN coalesce(ayat, '') <> '' THEN 'Ayat ' || ayat END) || chr(10) || context_text, chr(10) || chr(10) ORDER BY n)) AS size FROM expanded GROUP BY query_id),
counted AS (SELECT query_id, count(*) AS n FROM candidates GROUP BY query_id)
SELECT q.query_id, CASE WHEN NOT ok THEN NULL WHEN NOT in_scope THEN '{OUT_OF_SCOPE}' WHEN p.size IS NULL THEN '{INSUFFICIENT_EVIDENCE}' ELSE 'n: ' || size || CASE WHEN size % 2 = 1 THEN ' [1]' ELSE chr(10) || chr(10) || 'Sumber: ' || array_to_string(list_transform(range(1, p.n + 1), lambda k: '[' || k || ']'), ', ') END END AS answer,
  in_scope, normalized, rewritten, coalesce(c.n, 0)::BIGINT AS candidate_chunks, coalesce(p.n, 0)::BIGINT AS reranked_chunks, CASE WHEN NOT ok THEN '{answer.INVALID}' END AS error, coalesce(sources, '') AS sources
FROM questions q LEFT JOIN prompts p ON q.query_id = p.query_id LEFT JOIN counted c ON q.query_id = c.query_id"""

ORACLES = {
    "answer_job": _ANSWERS,
    "store_search": rf"""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS v, label, {_POINT.format('vec_id')} FROM embeddings), n AS (SELECT *, {_UUID} AS id FROM p)
SELECT query_id, rank, score, id, 'c' || vec_id AS chunk_id, 'label ' || label AS text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::BIGINT AS rank FROM (SELECT q.vec_id AS query_id, n.vec_id, n.id, n.label, round(list_cosine_similarity(n.v, q.v), 6) AS score FROM n, n q WHERE q.vec_id % 20 = 0)) WHERE rank <= 5""",
    "dense_topk": f"WITH {_DENSE} SELECT * FROM dense",
    "sparse_topk": f"WITH {_SPARSE} SELECT * FROM sparse",
    "hybrid_rrf": f"WITH {_FUSED} SELECT * FROM hybrid",
    "rerank_threshold": f"WITH {_RERANKED} SELECT * FROM reranked",
    "no_evidence": f"WITH {_RERANKED}, k AS (SELECT query_id, count(*) AS n FROM reranked WHERE rerank_score >= 0.6 GROUP BY query_id) SELECT doc_id AS query_id, coalesce(n, 0)::BIGINT AS reranked_chunks, CASE WHEN n IS NULL THEN '{INSUFFICIENT_EVIDENCE}' ELSE 'generated' END AS answer FROM documents LEFT JOIN k ON doc_id = query_id WHERE doc_id % 20 = 0",
    "parent_context": f"WITH {HITS_SQL} SELECT query_id, rerank_rank, filename, pasal, context_text FROM expanded",
    "prompt_context": rf"""WITH {HITS_SQL},
numbered AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_rank) AS n, '[' || row_number() OVER (PARTITION BY query_id ORDER BY rerank_rank) || '] ' || concat_ws(' · ', nullif(filename, ''), 'halaman ' || CASE WHEN page_start = page_end THEN page_start::VARCHAR ELSE page_start || '-' || page_end END,
  CASE WHEN coalesce(pasal, '') <> '' THEN 'Pasal ' || pasal END, CASE WHEN coalesce(ayat, '') <> '' THEN 'Ayat ' || ayat END) || chr(10) || context_text AS s FROM expanded)
SELECT query_id, count(*)::BIGINT AS n_sources, string_agg(s, chr(10) || chr(10) ORDER BY n) AS context FROM numbered GROUP BY query_id""",
    "source_list": rf"""WITH {HITS_SQL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_rank)::BIGINT AS id, filename AS document, page_start AS page, CASE WHEN page_end <> page_start THEN page_end END AS page_end, chunk_id, trim(text) AS text,
round(rerank_score, 6) AS rerank_score, nullif(bab, '') AS chapter, 'Pasal ' || pasal AS article, 'Ayat ' || ayat AS paragraph FROM hits""",
    "query_rewrite": r"""
WITH q AS (SELECT item_id, '  ' || text || CASE item_id % 3 WHEN 0 THEN ' PASAL' || (item_id % 90) || 'A  ayat ( ' || (item_id % 7) || ' ) apa' WHEN 1 THEN '  pasal 5 b' ELSE '  ' || chr(9) || ' ' END AS question FROM benchmark),
c AS (SELECT *, regexp_replace(regexp_replace(question, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS s FROM q),
n AS (SELECT *, regexp_replace(regexp_replace(s, '(?i)\bpasal\s*([0-9]+[a-z]?)\b', 'Pasal \1', 'g'), '(?i)\bayat\s*(?:\(\s*)?([0-9]+)(?:\s*\))?', 'Ayat \1', 'g') AS normalized FROM c)
SELECT item_id, normalized, normalized || CASE WHEN regexp_matches(normalized, '(?i)\bPasal\s+\d+|\bAyat\s+\d+') THEN ' ketentuan dalam peraturan ketenagakerjaan' ELSE ' menurut peraturan ketenagakerjaan Indonesia' END AS rewritten,
length(s)::BIGINT AS n, length(question) BETWEEN 1 AND 2000 AND s <> '' AS ok FROM n""",
    "answer_clean": f"WITH {_REPLIES} SELECT conv_id, turn, answer FROM answers",
    "citation_append": rf"WITH {_REPLIES} SELECT conv_id, turn, CASE WHEN regexp_matches(answer, '\[\d+\]') OR i % 5 < 1 THEN answer ELSE answer || chr(10) || chr(10) || 'Sumber: ' || array_to_string(list_transform(range(1, i % 5 + 1), lambda k: '[' || k || ']'), ', ') END AS answer FROM answers",
    "scope_parse": f"WITH v AS (SELECT conv_id, turn, CASE (conv_id * 100 + turn) % 6 WHEN 3 THEN true WHEN 4 THEN false END AS in_scope FROM conversations) SELECT conv_id, turn, in_scope, CASE WHEN in_scope THEN NULL ELSE '{OUT_OF_SCOPE}' END AS refusal FROM v",
    "vector_checks": r"""WITH x AS (SELECT vec_id, embedding, list_filter(range(0, len(embedding)), lambda i: embedding[len(embedding) - i] <> 0 AND (vec_id + len(embedding) - i - 1) % 3 <> 0) AS own FROM embeddings)
SELECT vec_id, len(embedding) > 0 AS dense_ok, true AS sparse_ok, array_to_string(own, ',') AS indices, len(own)::BIGINT AS n FROM x""",
}
