"""The jobs as queries: each runs twice over the whole tables into a new folder; and the SQL of their output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import ingest_documents, question_log
from lexloom.jobs.ingest import NO_CHUNKS
from lexloom.plans.fixtures import chunked_sql
from lexloom.sources.tables import new_folder


def job1_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and chunks after two runs; the second finds nothing new."""
    folder = new_folder(spark, "job1")
    for _ in range(2):
        out = ingest_documents.run(spark, f"{sf_dir}/documents*.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return out


def job2_question_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions after two runs, the second over the first."""
    folder = new_folder(spark, "job2")
    for _ in range(2):
        out = question_log.run(spark, f"{sf_dir}/conversations.parquet", f"{folder}/out")
    return out


QUERIES = {f.__name__: f for f in (job1_ingest_documents, job2_question_log)}

_LINES = r"""
docs AS (SELECT DISTINCT doc_id, sha256(coalesce(text, '')) AS h, lang, source, length(coalesce(text, ''))::BIGINT AS n_chars, ((len(string_split(coalesce(text, ''), chr(10))) + 11) // 12)::INTEGER AS n_pages FROM documents),
firsts AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id IS NULL, doc_id, lang NULLS FIRST, source NULLS FIRST) AS place, first_value(doc_id) OVER (PARTITION BY h ORDER BY doc_id IS NULL, doc_id, lang NULLS FIRST, source NULLS FIRST) AS first_id FROM docs),
texts AS (SELECT sha256(coalesce(text, '')) AS doc_id, any_value(coalesce(text, '')) AS text FROM documents GROUP BY 1),
legal0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ln FROM texts),
legal AS (SELECT doc_id, CAST(1 + ln // 12 AS INTEGER) AS page_number, ln AS line_no, trim(regexp_replace(regexp_replace(line, '[\x00-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g')) AS line FROM legal0)"""

ORACLES = {
    "job1_ingest_documents": f"WITH {chunked_sql(_LINES)}"
    + rf""",
ptok AS (SELECT doc_id, page_number, line_no, unnest(list_filter(string_split(line, ' '), lambda x: x <> '')) AS word, unnest(range(len(list_filter(string_split(line, ' '), lambda x: x <> '')))) AS pos FROM parsed WHERE doc_id NOT IN (SELECT doc_id FROM chunked)),
plist AS (SELECT doc_id, page_number, list(word ORDER BY line_no, pos) AS words FROM ptok GROUP BY doc_id, page_number),
ppack AS (SELECT *, list_reduce(list_transform(words, lambda w: {{'n': length(w)::BIGINT, 'ks': [1::BIGINT]}}), lambda a, x: CASE WHEN a.n + 1 + x.n > 1000 THEN {{'n': x.n, 'ks': list_append(a.ks, a.ks[-1] + 1)}} ELSE {{'n': a.n + 1 + x.n, 'ks': list_append(a.ks, a.ks[-1])}} END).ks AS ks FROM plist),
pflat AS (SELECT doc_id, page_number, unnest(words) AS word, unnest(ks) AS k, unnest(range(len(ks))) AS i FROM ppack),
pchunk AS (SELECT doc_id, page_number, k, string_agg(word, ' ' ORDER BY i) AS text FROM pflat GROUP BY doc_id, page_number, k),
every AS (SELECT doc_id AS h, 'page' AS kind, NULL::VARCHAR AS pasal, NULL::VARCHAR AS ayat, (row_number() OVER (PARTITION BY doc_id ORDER BY page_number, k))::INTEGER AS part, page_number AS page_start, page_number AS page_end, text FROM pchunk
  UNION ALL SELECT doc_id, 'article', pasal, ayat, part, page_start, page_end, text FROM chunked),
counts AS (SELECT h, count(*) AS n FROM every GROUP BY h),
state AS (SELECT f.*, n, CASE WHEN n IS NULL THEN 'failed' WHEN place = 1 THEN 'completed' ELSE 'duplicate' END AS status FROM firsts f LEFT JOIN counts c ON f.h = c.h)
SELECT doc_id, s.h AS document_hash, lang, source, n_chars, n_pages, status, CASE WHEN status = 'duplicate' THEN first_id END AS duplicate_of, CASE WHEN status = 'completed' THEN n ELSE 0 END::BIGINT AS n_chunks, CASE WHEN status = 'failed' THEN '{NO_CHUNKS}' END AS error,
  kind, pasal, ayat, part, page_start, page_end, e.text FROM state s LEFT JOIN every e ON s.h = e.h AND s.status = 'completed'""",
    "job2_question_log": r"""
WITH asked AS (SELECT conv_id, turn, coalesce(text, '') AS raw, regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS s FROM conversations WHERE role = 'user'),
gated AS (SELECT *, length(raw) BETWEEN 1 AND 2000 AND s <> '' AS ok, regexp_replace(regexp_replace(s, '(?i)\bpasal\s*([0-9]+[a-z]?)\b', 'Pasal \1', 'g'), '(?i)\bayat\s*(?:\(\s*)?([0-9]+)(?:\s*\))?', 'Ayat \1', 'g') AS normal FROM asked),
said AS (SELECT conv_id, turn - 1 AS turn, min(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
bare AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<think>.*?(?:</think>|\z)', '', 'g'), '(?i)</?think>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM said),
answers AS (SELECT conv_id, turn, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\*\*|__', '', 'g'), '(?m)^#{1,6}\s*', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), '') AS answer FROM bare),
times AS (SELECT lower(normal) AS key, count(*) AS n, min((conv_id, turn)) AS f FROM gated WHERE ok GROUP BY 1)
SELECT g.conv_id, g.turn, CASE WHEN ok THEN normal ELSE raw END AS question,
  CASE WHEN ok THEN normal || CASE WHEN regexp_matches(normal, '(?i)\bPasal\s+\d+|\bAyat\s+\d+') THEN ' ketentuan dalam peraturan ketenagakerjaan' ELSE ' menurut peraturan ketenagakerjaan Indonesia' END END AS search_text,
  CASE WHEN ok THEN answer END AS answer, CASE WHEN ok AND answer IS NOT NULL THEN len(list_distinct(regexp_extract_all(answer, '\[(\d+)\]', 1))) END::INTEGER AS n_citations,
  n::BIGINT AS times_asked, first_conv, first_turn, CASE WHEN NOT ok THEN 'rejected' WHEN answer IS NULL THEN 'unanswered' ELSE 'answered' END AS outcome
FROM gated g LEFT JOIN answers a ON g.conv_id = a.conv_id AND g.turn = a.turn LEFT JOIN (SELECT key, n, f[1] AS first_conv, f[2] AS first_turn FROM times) t ON ok AND lower(normal) = key""",
}
