"""Queries on ingestion: the registry, job events, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import log_message
from lexloom.jobs import ingest
from lexloom.operators import events, registry
from lexloom.plans.fixtures import JOBS_SQL, chunked_sql, job_events, legal_pages, registry_log, table
from lexloom.sources.registry_store import RegistryStore
from lexloom.sources.sinks import Collection
from lexloom.sources.tables import KeyedTable, new_folder, stored
from lexloom.streaming import ingest as live
from lexloom.streaming import jobs as streams
from lexloom.streaming import reserve, state


def event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.fold_progress(job_events(spark, sf_dir))


def job_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.job_outcomes(job_events(spark, sf_dir))


def ui_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = job_events(spark, sf_dir).where("filename <> '-'").groupBy("job_id", "filename").agg(F.max_by("status", "seq").alias("status"))
    return events.list_status(files, "job_id")


def terminal_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each job up to its end."""
    return events.up_to_terminal(job_events(spark, sf_dir)).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))


def page_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = job_events(spark, sf_dir).where("filename <> '-'")
    rows = e.select(F.col("filename").alias("doc_id"), F.col("seq").alias("page_number"), F.when(F.col("seq") % 3 == 0, "full_ocr").otherwise("native_text").alias("mode"))
    return events.page_progress(rows).drop("mode")


def sse_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = job_events(spark, sf_dir)
    log = log_message(F.col("job_id"), F.col("filename"), F.col("stage"), F.col("status"), F.col("message"))
    return rows.select("seq", events.encode_sse(F.col("type"), events.event_json("type", "job_id", "filename", "stage", "status", "message")).alias("sse"), log.alias("log"))


def job_file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.job_files(job_events(spark, sf_dir)).withColumn("files", F.array_join("files", ","))


def registry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.registry_state(registry_log(spark, sf_dir))


def registry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.registry_outcomes(registry_log(spark, sf_dir)).groupBy("op", "outcome").agg(F.count(F.lit(1)).alias("n"))


def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log, published in two parts, as a stream of files, folded with state; equal to event_fold."""
    folder = new_folder(spark, "events")
    log = job_events(spark, sf_dir).repartitionByRange(4, "seq").sortWithinPartitions("seq")
    for part in (0, 1):
        streams.publish(log.where(F.col("seq") % 2 == part), f"{folder}/log")
    stream = streams.stream_progress(streams.event_stream(spark, f"{folder}/log"))
    streams.to_latest(stream, "filename", f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return KeyedTable(spark, f"{folder}/state", "filename").read()


def stream_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log in two parts through the fold whose state ends with its job; equal to event_fold."""
    folder = new_folder(spark, "job-state")
    log = job_events(spark, sf_dir)
    for part in (0, 1):
        streams.publish(log.where(F.col("seq") % 2 == part), f"{folder}/log")
        with state.rocksdb(spark):
            stream = state.stream_jobs(streams.event_stream(spark, f"{folder}/log"), grace_ms=3_600_000).drop("job_id")
            streams.to_latest(stream, "filename", f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return KeyedTable(spark, f"{folder}/state", "filename").read()


def stream_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4, U5 as a stream; equal to registry_state."""
    folder = new_folder(spark, "registry")
    log = registry_log(spark, sf_dir)
    log.repartitionByRange(4, "seq").sortWithinPartitions("seq").write.parquet(f"{folder}/log")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema.fields)
    streams.to_latest(streams.stream_registry(streams.event_stream(spark, f"{folder}/log", schema)), "document_hash", f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return KeyedTable(spark, f"{folder}/state", "document_hash").read()


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as uploads, ten to a job; every 13th is not a good file."""
    i = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("job"), F.floor(i / 10).cast("string")).alias("job_id"), F.concat(F.lit("up"), i.cast("string"), F.lit(".pdf")).alias("filename"), F.concat(F.lit("h"), i.cast("string")).alias("document_hash"), (i % 13 == 0).alias("failed"))


def duplicate_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads whose hash the registry knows."""
    return registry.duplicates(_uploads(spark, sf_dir), registry.registry_state(registry_log(spark, sf_dir))).select("document_hash", "duplicate", "existing_status", "error")


def upload_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each job of uploads; odd customers make jobs of one file."""
    rows = registry.duplicates(_uploads(spark, sf_dir), registry.registry_state(registry_log(spark, sf_dir)))
    alone = rows.withColumn("job_id", F.concat(F.col("job_id"), F.lit("-"), F.col("document_hash")))
    return registry.upload_report(rows.unionByName(alone)).withColumn("status_code", F.col("status_code").cast("long"))


def registry_durable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log applied to a stored registry in two batches; equal to registry_state."""
    store, log = RegistryStore(spark, new_folder(spark, "registry")), registry_log(spark, sf_dir)
    half = log.agg(F.floor(F.max("seq") / 2)).first()[0]
    for part in (log.where(F.col("seq") <= half), log.where(F.col("seq") > half)):
        store.apply(part)
    return store.read()


def registry_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as requests of two writers, applied by one stream; the registry after them, equal to registry_state."""
    folder, log = new_folder(spark, "requests"), registry_log(spark, sf_dir)
    half = log.agg(F.floor(F.max("seq") / 2)).first()[0]
    kinds = {c.split()[0]: c.split()[1] for c in reserve.REQUESTS.split(", ")}
    for call, part in enumerate((log.where(F.col("seq") <= half), log.where(F.col("seq") > half))):
        # the order of the log stands for the times of the calls
        rows = part.withColumn("request_id", F.col("seq").cast("string")).withColumn("asked_at", F.timestamp_seconds("seq"))
        rows.select(*[F.col(c).cast(k) for c, k in kinds.items()]).write.parquet(f"{folder}/requests/call={call}")
        reserve.serve(spark, folder, once=True).awaitTermination()
    return RegistryStore(spark, f"{folder}/registry").read()


#: Texts of these lengths are those that the stand-in for an embedding model refuses.
BAD_LENGTH = 41


def _embedder():
    def embed(texts: list[str]) -> list[tuple[list[float], dict[int, float]]]:
        if any(len(t) % BAD_LENGTH == 0 for t in texts):
            raise ValueError("embedding failed")
        return [([float(len(t)), 1.0], {len(t): 1.0}) for t in texts]

    return embed


def _uploaded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files of jobs of ten and their pages; every 23rd cannot be read, every third page is read by OCR."""
    source, d = legal_pages(spark, sf_dir), F.col("doc_id")
    error = F.when(d % 23 == 0, "broken file")
    pages = source.withColumn("mode", F.when(F.col("page_number") % 3 == 0, "full_ocr").otherwise("native_text")).withColumn("error", error)
    text = d.cast("string")
    documents = table(spark, sf_dir, "documents").select(F.concat(F.lit("job"), F.floor(d / 10).cast("string")).alias("job_id"), (d % 10).alias("position"), "doc_id", F.concat(F.lit("UU No. "), text, F.lit(".pdf")).alias("filename"), F.concat(F.lit("h"), text).alias("document_hash"), F.concat(F.lit("i"), text).alias("ingestion_id"))
    return documents, pages


def _ingested(spark: SparkSession, sf_dir: str) -> ingest.JobResult:
    documents, pages = _uploaded(spark, sf_dir)
    points = Collection(spark, new_folder(spark, "points"), 2)
    return ingest.process_documents(documents, stored(pages, "pages"), lambda: _embedder(), points)


def ingest_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document job as a stream of micro-batches whose events a second stream follows; the events that it saw, in order."""
    folder = new_folder(spark, "ingest-live")
    documents, pages = _uploaded(spark, sf_dir)
    by_doc = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text", "mode", "error"))).alias("pages"))
    sized = documents.join(documents.groupBy("job_id").agg(F.count(F.lit(1)).cast("int").alias("job_size")), "job_id").join(by_doc, "doc_id")
    queue = sized.select("job_id", "job_size", "position", F.col("doc_id").cast("string").alias("doc_id"), "filename", "document_hash", "ingestion_id", "pages")
    live.queue_documents(queue, f"{folder}/queue", files=3)
    live.ingest_stream(spark, f"{folder}/queue", f"{folder}/out", lambda: _embedder(), Collection(spark, f"{folder}/points", 2), f"{folder}/checkpoint", files_per_batch=2).awaitTermination()
    reader = live.follow_events(spark, f"{folder}/out").writeStream.format("parquet").option("checkpointLocation", f"{folder}/reader").trigger(availableNow=True)
    reader.start(f"{folder}/seen").awaitTermination()
    seen = spark.read.schema(live.EVENTS).parquet(f"{folder}/seen")
    return seen.withColumn("seq", F.row_number().over(Window.partitionBy("job_id").orderBy("seq")).cast("long"))


def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each document of each job ended."""
    return _ingested(spark, sf_dir).outcomes.drop("document_hash", "ingestion_id", "filename")


def ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of every job, in order."""
    return _ingested(spark, sf_dir).events


def ingest_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after the jobs."""
    out = _ingested(spark, sf_dir)
    reserves = out.outcomes.select((F.col("doc_id") * 10).alias("seq"), F.lit("reserve").alias("op"), "document_hash", F.lit("d").alias("document_id"), "filename", "ingestion_id", F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("indexed_chunks"), F.lit(None).cast("string").alias("error"))
    number = F.substring("document_hash", 2, 20).cast("long")
    updates = out.log.select((number * 10 + F.col("step")).alias("seq"), F.lit("update").alias("op"), "document_hash", F.lit("d").alias("document_id"), F.lit("").alias("filename"), "ingestion_id", "status", F.col("indexed_chunks").cast("int").alias("indexed_chunks"), "error")
    return registry.registry_state(reserves.unionByName(updates)).select("document_hash", "ingestion_id", "status", "indexed_chunks", "error")


QUERIES = {f.__name__: f for f in (event_fold, job_outcome, ui_status, terminal_cut, page_progress, sse_encode, job_file_list, registry_state, registry_outcomes, stream_fold, stream_registry, registry_durable, duplicate_uploads, upload_reports, ingest_outcomes, ingest_events, ingest_registry, ingest_live, registry_requests, stream_jobs)}

#: Registry states one operation after the other, by a recursive query.
_REGISTRY = r"""WITH RECURSIVE log AS (SELECT event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'reserve' ELSE 'update' END AS op, 'h' || user_id AS document_hash, 'doc_' || user_id AS document_id, 'f' || user_id || '.pdf' AS filename, 'i' || (event_id // 200) AS ingestion_id,
  (['processing', 'completed', 'failed'])[CAST(event_id % 3 + 1 AS INTEGER)] AS status, CASE WHEN event_id % 3 = 1 THEN (event_id % 90)::INTEGER END AS indexed_chunks, CASE WHEN event_id % 3 = 2 THEN 'boom' END AS error, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
st AS (SELECT DISTINCT document_hash, 0::BIGINT AS rn, NULL::VARCHAR AS op, NULL::VARCHAR AS outcome, NULL::VARCHAR AS document_id, NULL::VARCHAR AS filename, NULL::VARCHAR AS ingestion_id, NULL::VARCHAR AS status, NULL::INTEGER AS indexed_chunks, NULL::VARCHAR AS error FROM log
  UNION ALL
  SELECT document_hash, rn, op, outcome, CASE WHEN outcome IN ('inserted', 'reset') THEN new_id ELSE document_id END, CASE WHEN outcome IN ('inserted', 'reset') THEN new_name ELSE filename END, CASE WHEN outcome IN ('inserted', 'reset') THEN new_ing ELSE ingestion_id END,
    CASE WHEN outcome IN ('inserted', 'reset') THEN 'queued' WHEN outcome = 'updated' THEN new_status ELSE status END, CASE WHEN outcome IN ('inserted', 'reset') THEN NULL WHEN outcome = 'updated' THEN new_chunks ELSE indexed_chunks END, CASE WHEN outcome IN ('inserted', 'reset') THEN NULL WHEN outcome = 'updated' THEN new_error ELSE error END
  FROM (SELECT st.document_hash, l.rn, l.op, st.document_id, st.filename, st.ingestion_id, st.status, st.indexed_chunks, st.error, l.document_id AS new_id, l.filename AS new_name, l.ingestion_id AS new_ing, l.status AS new_status, l.indexed_chunks AS new_chunks, l.error AS new_error,
    CASE WHEN l.op = 'reserve' THEN CASE WHEN st.status IS NULL THEN 'inserted' WHEN st.status = 'failed' THEN 'reset' ELSE 'duplicate' END WHEN st.status IS NULL OR st.ingestion_id <> l.ingestion_id THEN 'rejected' ELSE 'updated' END AS outcome
    FROM st JOIN log l ON l.document_hash = st.document_hash AND l.rn = st.rn + 1))"""
_STATE = _REGISTRY + " SELECT document_hash, document_id, filename, ingestion_id, status, indexed_chunks, error FROM st WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_hash ORDER BY rn DESC) = 1"
_UPLOADS = _REGISTRY + """,
state AS (SELECT document_hash, filename, status FROM st WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_hash ORDER BY rn DESC) = 1),
uploads AS (SELECT 'job' || (c_custkey // 10) AS job_id, 'h' || c_custkey AS document_hash, c_custkey % 13 = 0 AS failed FROM customer),
checked AS (SELECT u.*, s.status IS NOT NULL AS duplicate, s.status AS existing_status, CASE WHEN s.status IS NOT NULL THEN 'Dokumen sudah pernah diinput (status: ' || s.status || ', file: ' || s.filename || ')' END AS error FROM uploads u LEFT JOIN state s ON u.document_hash = s.document_hash AND s.status <> 'failed')"""
_INGEST = f"""WITH {chunked_sql()},
numbered AS (SELECT doc_id, text, (row_number() OVER (PARTITION BY doc_id ORDER BY section, k) - 1)::BIGINT AS n FROM chunked WHERE doc_id % 23 <> 0),
bad AS (SELECT doc_id, min(n // 8) AS batch FROM numbered WHERE length(trim(text)) % 41 = 0 GROUP BY doc_id),
tried AS (SELECT n.doc_id, n // 8 AS batch, n, b.batch IS NULL OR n // 8 < b.batch AS indexed FROM numbered n LEFT JOIN bad b ON n.doc_id = b.doc_id),
counts AS (SELECT doc_id, count(*) AS chunks, count(*) FILTER (WHERE indexed) AS indexed_chunks, bool_and(indexed) AS whole FROM tried GROUP BY doc_id),
page_list AS (SELECT DISTINCT doc_id, page_number FROM legal WHERE doc_id % 23 <> 0),
modes AS (SELECT doc_id, count(*) FILTER (WHERE page_number % 3 <> 0) AS native_pages, count(*) FILTER (WHERE page_number % 3 = 0) AS ocr_pages FROM page_list GROUP BY doc_id),
outcomes AS (SELECT 'job' || (d.doc_id // 10) AS job_id, d.doc_id % 10 AS position, d.doc_id, coalesce(chunks, 0)::BIGINT AS chunks, coalesce(indexed_chunks, 0)::BIGINT AS indexed_chunks, coalesce(native_pages, 0)::BIGINT AS native_pages, coalesce(ocr_pages, 0)::BIGINT AS ocr_pages,
  CASE WHEN d.doc_id % 23 = 0 THEN 'broken file' WHEN chunks IS NULL THEN '{ingest.NO_CHUNKS}' WHEN NOT whole THEN 'embedding failed' END AS error FROM documents d LEFT JOIN counts c ON d.doc_id = c.doc_id LEFT JOIN modes m ON d.doc_id = m.doc_id)"""
_M = ingest.MESSAGES
_EVENTS = _INGEST + f""",
named AS (SELECT *, 'UU No. ' || doc_id || '.pdf' AS filename, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status FROM outcomes),
pages1 AS (SELECT doc_id, page_number, row_number() OVER w AS current, count(*) OVER (PARTITION BY doc_id) AS total, count(*) FILTER (WHERE page_number % 3 <> 0) OVER w AS native, count(*) FILTER (WHERE page_number % 3 = 0) OVER w AS ocr FROM page_list WINDOW w AS (PARTITION BY doc_id ORDER BY page_number)),
ends AS (SELECT doc_id, batch, max(n) + 1 AS current FROM tried WHERE indexed GROUP BY doc_id, batch),
jobs AS (SELECT job_id, max(position) + 1 AS position, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS good FROM named GROUP BY job_id),
e AS (
 SELECT job_id, position, 1 AS step, 0::BIGINT AS sub, 'document_status' AS type, filename, 'parsing' AS stage, 'processing' AS status, '{_M["parsing"]}' AS message, NULL::BIGINT AS chunks, NULL::BIGINT AS indexed_chunks, NULL::BIGINT AS progress_current, NULL::BIGINT AS progress_total, NULL::BIGINT AS progress_percent, NULL::VARCHAR AS progress_unit, NULL::VARCHAR AS extraction_mode, NULL::BIGINT AS native_pages, NULL::BIGINT AS ocr_pages, NULL::BIGINT AS total_pages, NULL::VARCHAR AS error FROM named
 UNION ALL SELECT job_id, position, 2, current, 'document_status', filename, 'parsing', 'processing', CASE WHEN page_number % 3 = 0 THEN 'Full OCR' ELSE 'Membaca native text' END || ' · halaman ' || current || '/' || total || ' · Native ' || native || ' · OCR ' || ocr, NULL, NULL, current, total, round_even(current::DOUBLE / total * 100, 0)::BIGINT, 'halaman', CASE WHEN page_number % 3 = 0 THEN 'full_ocr' ELSE 'native_text' END, native, ocr, total, NULL FROM pages1 p JOIN named n ON p.doc_id = n.doc_id
 UNION ALL SELECT job_id, position, 3, 0, 'document_status', filename, 'parsing', 'processing', '{_M["parsing"]} · ' || chunks || ' chunk ditemukan · Native ' || native_pages || ' halaman · OCR ' || ocr_pages || ' halaman', chunks, NULL, NULL, NULL, NULL, NULL, NULL, native_pages, ocr_pages, native_pages + ocr_pages, NULL FROM named WHERE chunks > 0
 UNION ALL SELECT job_id, position, 4, 2 * batch, 'document_status', filename, 'embedding', 'processing', '{_M["embedding"]} · ' || current || '/' || chunks || ' chunk', NULL, NULL, current, chunks, round_even(current::DOUBLE / chunks * 100, 0)::BIGINT, 'chunk', NULL, NULL, NULL, NULL, NULL FROM ends x JOIN named n ON x.doc_id = n.doc_id
 UNION ALL SELECT job_id, position, 4, 2 * batch + 1, 'document_status', filename, 'indexing', 'processing', '{_M["indexing"]} · ' || current || '/' || chunks || ' chunk', NULL, NULL, current, chunks, round_even(current::DOUBLE / chunks * 100, 0)::BIGINT, 'chunk', NULL, NULL, NULL, NULL, NULL FROM ends x JOIN named n ON x.doc_id = n.doc_id
 UNION ALL SELECT job_id, position, 5, 0, 'document_status', filename, 'completed', 'completed', '{_M["completed"]} · ' || indexed_chunks || ' chunk masuk ke Qdrant', chunks, indexed_chunks, NULL, NULL, NULL, NULL, NULL, native_pages, ocr_pages, native_pages + ocr_pages, NULL FROM named WHERE error IS NULL
 UNION ALL SELECT job_id, position, 5, 0, 'document_status', filename, 'failed', 'failed', '{_M["failed"]}: ' || error, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, error FROM named WHERE error IS NOT NULL
 UNION ALL SELECT job_id, position, 6, 0, 'job_status', '-', 'job', CASE WHEN good > 0 THEN 'completed' ELSE 'failed' END, CASE WHEN good = n THEN '{ingest.JOB_DONE}' WHEN good > 0 THEN '{ingest.JOB_PARTLY}' ELSE '{ingest.JOB_FAILED}' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM jobs)
SELECT * EXCLUDE (position, step, sub), row_number() OVER (PARTITION BY job_id ORDER BY position, step, sub)::BIGINT AS seq FROM e"""
_FOLD = rf"""WITH {JOBS_SQL} SELECT filename, arg_max_null(stage, seq) AS stage, arg_max_null(status, seq) AS status, arg_max_null(message, seq) AS message, arg_max_null(chunks, seq) AS chunks, arg_max_null(indexed_chunks, seq) AS indexed_chunks, arg_max_null(progress_current, seq) AS progress_current, arg_max_null(progress_total, seq) AS progress_total, arg_max_null(progress_percent, seq) AS progress_percent, arg_max_null(progress_unit, seq) AS progress_unit,
arg_max_null(error, seq) AS error, arg_max(native_pages, seq) AS native_pages, arg_max(ocr_pages, seq) AS ocr_pages, arg_max(total_pages, seq) AS total_pages FROM jobs WHERE filename <> '-' AND type <> 'job_status' GROUP BY filename"""
_FILES = f"WITH {JOBS_SQL}, files AS (SELECT job_id, filename, arg_max(status, seq) AS status FROM jobs WHERE filename <> '-' GROUP BY job_id, filename)"
ORACLES = {
    "event_fold": _FOLD,
    "stream_fold": _FOLD,
    "stream_jobs": _FOLD,
    "registry_state": _STATE,
    "stream_registry": _STATE,
    "registry_durable": _STATE,
    "registry_requests": _STATE,
    "duplicate_uploads": _UPLOADS + " SELECT document_hash, duplicate, existing_status, error FROM checked",
    "upload_reports": _UPLOADS + f""", jobs AS (SELECT * FROM checked UNION ALL SELECT job_id || '-' || document_hash, * EXCLUDE (job_id) FROM checked),
g AS (SELECT job_id, count(*) FILTER (WHERE NOT failed AND NOT duplicate)::BIGINT AS accepted, count(*) FILTER (WHERE failed)::BIGINT AS rejected, count(*) FILTER (WHERE duplicate)::BIGINT AS duplicates, bool_and(duplicate) AS every, count(*) AS n, min(error) AS e FROM jobs GROUP BY job_id)
SELECT job_id, accepted, rejected, duplicates, CASE WHEN every THEN 409 WHEN accepted = 0 THEN 422 ELSE 202 END::BIGINT AS status_code, CASE WHEN every THEN CASE WHEN n = 1 THEN e ELSE '{registry.ALL_DUPLICATES}' END END AS detail FROM g""",
    "ingest_outcomes": _INGEST + " SELECT job_id, position, doc_id, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, chunks, indexed_chunks, native_pages, ocr_pages, error FROM outcomes",
    "ingest_events": _EVENTS,
    "ingest_live": _EVENTS,
    "ingest_registry": _INGEST + " SELECT 'h' || doc_id AS document_hash, 'i' || doc_id AS ingestion_id, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, CASE WHEN error IS NULL THEN indexed_chunks END::INTEGER AS indexed_chunks, error FROM outcomes",
    "registry_outcomes": _REGISTRY + " SELECT op, outcome, count(*)::BIGINT AS n FROM st WHERE rn > 0 GROUP BY op, outcome",
    "job_outcome": _FILES + " SELECT job_id, count(*)::BIGINT AS n_files, count(*) FILTER (WHERE status = 'failed')::BIGINT AS n_failed, CASE WHEN count(*) FILTER (WHERE status = 'completed') > 0 THEN 'completed' ELSE 'failed' END AS outcome, count(*) FILTER (WHERE status = 'completed') > 0 AND count(*) FILTER (WHERE status = 'failed') > 0 AS with_failures FROM files GROUP BY job_id",
    "ui_status": _FILES + ", c AS (SELECT job_id, count(*) FILTER (WHERE status NOT IN ('completed', 'failed'))::BIGINT AS pending, count(*) FILTER (WHERE status = 'failed')::BIGINT AS failed, count(*) FILTER (WHERE status = 'completed')::BIGINT AS completed FROM files GROUP BY job_id) SELECT *, CASE WHEN pending > 0 THEN 'processing' WHEN failed > 0 THEN 'error' WHEN completed > 0 THEN 'success' ELSE 'idle' END AS state FROM c",
    "terminal_cut": f"WITH {JOBS_SQL}, e AS (SELECT *, coalesce(max(CASE WHEN type = 'job_status' AND status IN ('completed', 'failed') THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM jobs) SELECT job_id, count(*)::BIGINT AS n, max(seq) AS last FROM e WHERE ended = 0 GROUP BY job_id",
    "page_progress": f"WITH {JOBS_SQL} SELECT filename AS doc_id, seq AS page_number, (sum(CASE WHEN seq % 3 <> 0 THEN 1 ELSE 0 END) OVER w)::BIGINT AS native_pages, (sum(CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END) OVER w)::BIGINT AS ocr_pages, (count(*) OVER (PARTITION BY filename))::BIGINT AS total_pages, round_even((row_number() OVER w)::DOUBLE / count(*) OVER (PARTITION BY filename) * 100, 0)::BIGINT AS progress_percent FROM jobs WHERE filename <> '-' WINDOW w AS (PARTITION BY filename ORDER BY seq)",
    "sse_encode": f"""WITH {JOBS_SQL} SELECT seq, 'event: ' || type || chr(10) || 'data: {{"type":"' || type || '","job_id":"' || job_id || '","filename":"' || filename || '","stage":"' || stage || '","status":"' || status || '","message":"' || message || '"}}' || chr(10) || chr(10) AS sse, 'Document status | job_id=' || job_id || ' filename=' || filename || ' stage=' || stage || ' status=' || status || ' message=' || message AS log FROM jobs""",
    "job_file_list": f"WITH {JOBS_SQL} SELECT job_id, string_agg(DISTINCT filename, ',' ORDER BY filename) AS files FROM jobs WHERE filename <> '-' GROUP BY job_id",
}
