"""Job events: the progress of each file, outcomes of jobs, server-sent events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import percent, status_rollup

#: Values that the last event sets, also to null, and those that keep the last one that was there.
LAST = ("stage", "status", "message", "chunks", "indexed_chunks", "progress_current", "progress_total", "progress_percent", "progress_unit", "error")

# Fixed value: what a file says whose job is gone.
JOB_LOST = "Status job tidak ditemukan; proses mungkin berhenti saat backend restart"
KEPT = ("native_pages", "ocr_pages", "total_pages")


def is_terminal(kind: Column, status: Column) -> Column:
    return (kind == "job_status") & status.isin("completed", "failed")


def up_to_terminal(events: DataFrame) -> DataFrame:
    """A job's events up to and with the first that ends it."""
    w = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(is_terminal(F.col("type"), F.col("status")).cast("int")).over(w), F.lit(0))
    return events.withColumn("__ended", ended).where("__ended = 0").drop("__ended")


def fold_progress(events: DataFrame) -> DataFrame:
    """(filename, LAST..., KEPT...): state of each file. Events of `-` and of jobs are ignored; repeated events change nothing."""
    own = events.where((F.col("filename") != "-") & (F.col("type") != "job_status"))
    last = F.max_by(F.struct(*LAST), "seq").alias("x")
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in KEPT]
    return own.groupBy("filename").agg(last, *kept).select("filename", "x.*", *KEPT)


def mark_lost(files: DataFrame) -> DataFrame:
    """Folded files whose job is unknown: those still at work have failed."""
    at_work = F.coalesce(F.col("status").isin("queued", "processing"), F.lit(False))
    new = {"status": "failed", "stage": "failed", "message": JOB_LOST, "error": JOB_LOST}
    return files.withColumns({c: F.when(at_work, v).otherwise(F.col(c)) for c, v in new.items()})


def remove_files(listed: DataFrame, names: list[str]) -> DataFrame:
    """The list without files of these names; a file that is still at work stays."""
    at_work = F.coalesce(F.col("status").isin("queued", "processing"), F.lit(False))
    return listed.where(~F.coalesce(F.col("filename").isin(*names), F.lit(False)) | at_work)


def load_state(saved: Column) -> Column:
    """A saved list of files as a struct; absent, broken or wrongly shaped parts are empty."""
    kind = "files array<struct<name:string,size:bigint>>, fileProgress map<string,struct<status:string,stage:string,message:string>>, activeJobIds array<string>, fileJobIds map<string,string>"
    got = F.from_json(saved, kind, {"mode": "PERMISSIVE"})
    empty = {"files": F.from_json(F.lit("[]"), "array<struct<name:string,size:bigint>>"), "fileProgress": F.from_json(F.lit("{}"), "map<string,struct<status:string,stage:string,message:string>>"), "activeJobIds": F.array().cast("array<string>"), "fileJobIds": F.create_map().cast("map<string,string>")}
    return F.struct(*[F.coalesce(got[c], empty[c]).alias(c) for c in empty])


def job_outcomes(events: DataFrame) -> DataFrame:
    """(job_id, n_files, n_failed, outcome, with_failures) from the last status of each file."""
    files = events.where("filename <> '-'").groupBy("job_id", "filename").agg(F.max_by("status", "seq").alias("status"))
    rows = files.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if(F.col("status") == "completed").alias("n_done"))
    return rows.select("job_id", "n_files", "n_failed", F.when(F.col("n_done") > 0, "completed").otherwise("failed").alias("outcome"), ((F.col("n_done") > 0) & (F.col("n_failed") > 0)).alias("with_failures"))


def list_status(files: DataFrame, by: str) -> DataFrame:
    """Counts and overall state of the files of each `by`; a file without status or still at work is pending."""
    done = F.coalesce(F.col("status").isin("completed", "failed"), F.lit(False))
    rows = files.groupBy(by).agg(F.count_if(~done).alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "completed").alias("completed"))
    return rows.withColumn("state", status_rollup(F.col("pending"), F.col("failed"), F.col("completed")))


def page_progress(pages: DataFrame) -> DataFrame:
    """Running native and OCR pages of each document and the percentage done."""
    w = Window.partitionBy("doc_id").orderBy("page_number")
    all_pages = Window.partitionBy("doc_id")
    rows = pages.withColumn("native_pages", F.sum((F.col("mode") == "native_text").cast("long")).over(w)).withColumn("ocr_pages", F.sum((F.col("mode") == "full_ocr").cast("long")).over(w))
    return rows.withColumn("total_pages", F.count(F.lit(1)).over(all_pages)).withColumn("progress_percent", percent(F.row_number().over(w), F.col("total_pages")))


def job_files(events: DataFrame) -> DataFrame:
    """(job_id, files): names of each job, sorted."""
    return events.where("filename <> '-'").groupBy("job_id").agg(F.array_sort(F.collect_set("filename")).alias("files"))


def new_files(chosen: DataFrame, listed: DataFrame) -> DataFrame:
    """Chosen PDF files whose names are not listed yet."""
    return chosen.where(F.lower("filename").like("%.pdf")).join(listed.select("filename"), "filename", "left_anti")


def encode_sse(kind: Column, payload: Column) -> Column:
    """A server-sent event from its type and JSON text."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), payload, F.lit("\n\n"))


def event_json(*columns: str) -> Column:
    """JSON text of event columns in the given order; null ones are left out."""
    return F.to_json(F.struct(*columns))
