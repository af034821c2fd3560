"""The upload as one job: files are checked, hashed and reserved, the new ones scanned and processed, and the registry told how they ended."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import document_id, is_pdf
from lexloom.jobs.ingest import JobResult, best_effort, process_documents
from lexloom.operators.registry import DUPLICATE, upload_report
from lexloom.sources.models import Embed
from lexloom.sources.page_source import scan_files
from lexloom.sources.registry_store import RegistryStore
from lexloom.sources.sinks import Collection
from lexloom.sources.tables import stored


@dataclass
class UploadResult:
    """files: a verdict on each; report: the job's counts, status code and what is said; job: how the accepted ones went, None if there are none."""

    files: DataFrame
    report: DataFrame
    job: JobResult | None


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, document_id, document_hash, size, failed, reason) of the files under a path; their bytes stay in the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("filename"), F.sha2("content", 256).alias("document_hash"), F.col("length").alias("size"))
    reason = F.when(~is_pdf(F.col("filename")), "not_a_pdf")
    return rows.withColumns({"document_id": document_id(F.col("filename")), "reason": reason, "failed": reason.isNotNull()})


def upload_job(spark: SparkSession, path: str, opener: str, ocr: Callable, connect: Callable[[], Embed], registry: RegistryStore, collection: Collection, *, job_id: str, mode: str = "hybrid", model: str = "embedding", batch: int = 8) -> UploadResult:
    """Takes the files under a path as one job.

    Files that are no PDF are rejected. Of the others those whose hash is new to the registry, or failed before, are
    accepted; of equal ones in the same upload the first by path. The rest are duplicates and say of what. Accepted files
    are scanned (`scan_files`) and processed (`process_documents`); their registry entries follow as far as they can be
    written. A file that fails leaves the others alone.
    """
    files = hash_files(spark, path).withColumn("job_id", F.lit(job_id))
    # by path, so that of equal files the first one reserves
    order = F.row_number().over(Window.partitionBy("job_id").orderBy("path"))
    files = stored(files.withColumn("position", (order - 1).cast("long")).withColumn("ingestion_id", F.concat(F.lpad(order.cast("string"), 10, "0"), F.lit("-"), F.md5(F.concat_ws(":", "job_id", "path")))), "files")
    told = registry.reserve(files.where("not failed").select("document_hash", "document_id", "filename", "ingestion_id")).select("ingestion_id", "outcome")
    state = registry.read().select("document_hash", F.col("status").alias("existing_status"), F.col("filename").alias("existing_name"))
    rows = files.join(told, "ingestion_id", "left").join(state, "document_hash", "left").withColumn("duplicate", F.coalesce(F.col("outcome") == "duplicate", F.lit(False)))
    said = F.concat(F.lit(DUPLICATE[0]), "existing_status", F.lit(DUPLICATE[1]), F.coalesce("existing_name", F.lit("")), F.lit(DUPLICATE[2]))
    rows = stored(rows.withColumn("error", F.when(F.col("duplicate"), said).otherwise(F.col("reason"))).drop("existing_status", "existing_name", "reason"), "verdicts")
    accepted = rows.where("not failed and not duplicate")
    job = None
    if accepted.limit(1).count():
        pages = stored(scan_files(spark, path, opener, ocr, mode=mode, only=accepted).select("doc_id", "filename", "page_number", "text", "mode", "error"), "scanned")
        documents = accepted.select("job_id", "position", F.col("path").alias("doc_id"), "filename", "document_hash", "ingestion_id")
        job = process_documents(documents, pages, connect, collection, model=model, batch=batch)
        best_effort("registry", lambda: registry.update(job.log))
    return UploadResult(rows.select("job_id", "path", "filename", "document_hash", "size", "failed", "duplicate", "outcome", "error"), upload_report(rows), job)
