"""The document job as a stream: micro-batches of documents are parsed, embedded and stored, and their events appended while the job runs.

A checkpoint says which files of documents are done. What a micro-batch stores it stores under the keys and the number of
the batch, so one that runs again after a crash leaves the same points, outcomes and events; what earlier ones stored is
there whatever comes later. The event log is a folder of Parquet files that any number of streams follow, each with its
own offsets: the history first, then what is added.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.jobs.ingest import best_effort, job_ends, process_documents
from lexloom.sources.models import Embed
from lexloom.sources.registry_store import RegistryStore
from lexloom.sources.sinks import Collection
from lexloom.sources.tables import finished, stored

logger = logging.getLogger(__name__)

DOCUMENTS = (
    "job_id string, job_size int, position long, doc_id string, filename string, document_hash string, ingestion_id string, "
    "pages array<struct<page_number:int,text:string,mode:string,error:string>>"
)
_OUTCOMES = "job_id string, job_size int, position long, doc_id string, filename string, document_hash string, ingestion_id string, status string, chunks long, indexed_chunks long, native_pages long, ocr_pages long, error string"
EVENTS = (
    "type string, job_id string, filename string, stage string, status string, message string, chunks long, indexed_chunks long, progress_current long, progress_total long, progress_percent long, progress_unit string, "
    "extraction_mode string, native_pages long, ocr_pages long, total_pages long, error string, seq long"
)
#: Events of a job in one micro-batch at most; the number of the batch is above it in seq.
_BATCH_EVENTS = 1 << 40


def queue_documents(documents: DataFrame, path: str, *, files: int) -> None:
    """Appends documents (DOCUMENTS) to the folder that ingest_stream reads, the documents of a job together, in so many files."""
    documents.repartition(files, "job_id").write.mode("append").parquet(path)


def event_log(spark: SparkSession, target: str) -> DataFrame:
    """All events so far."""
    return spark.read.schema(EVENTS).parquet(f"{target}/events/*")


def outcomes(spark: SparkSession, target: str) -> DataFrame:
    """How each document ended, of those that have."""
    return spark.read.schema(_OUTCOMES).parquet(f"{target}/outcomes/*")


def follow_events(spark: SparkSession, target: str) -> DataFrame:
    """The event log as a stream. Each query on it has offsets of its own in its checkpoint, so readers do not disturb each other."""
    return spark.readStream.schema(EVENTS).parquet(f"{target}/events/*")


def ingest_stream(spark: SparkSession, source: str, target: str, connect: Callable[[], Embed], collection: Collection, checkpoint: str, *, registry: RegistryStore | None = None, model: str = "embedding", batch: int = 8, files_per_batch: int = 1, once: bool = True) -> StreamingQuery:
    """Processes the documents under `source` in micro-batches of `files_per_batch` files; target gets outcomes and events.

    A job is over when as many of its documents as its job_size have ended, in whichever micro-batch the last one is. The
    registry is written as far as it can be; the job does not depend on it. once: ends when there is nothing new.
    """

    def take(rows: DataFrame, number: int) -> None:
        rows = stored(rows, "taken")
        if not rows.limit(1).count():
            return
        documents = rows.drop("pages", "job_size")
        pages = rows.select("doc_id", "filename", F.inline("pages"))
        sizes = rows.groupBy("job_id").agg(F.max("job_size").alias("job_size"))

        def ended(out: DataFrame) -> DataFrame:
            done = out.select("job_id", "position", "doc_id", "status")
            before = [f"{target}/outcomes/batch={n}" for n in range(number) if finished(spark, f"{target}/outcomes/batch={n}")]
            if before:
                earlier = spark.read.schema(_OUTCOMES).parquet(*before).select(*done.columns)
                done = done.unionByName(earlier.join(F.broadcast(sizes.select("job_id")), "job_id", "left_semi"))
            return job_ends(done).join(sizes, "job_id").where("all >= job_size").drop("job_size")

        result = process_documents(documents, pages, connect, collection, model=model, batch=batch, ended=ended)
        result.outcomes.join(sizes, "job_id").write.mode("overwrite").parquet(f"{target}/outcomes/batch={number}")
        if registry is not None:
            best_effort("registry", lambda: registry.update(result.log))
        # last: a reader may have seen events that are there, so those of a finished write stay as they are
        if not finished(spark, events := f"{target}/events/batch={number}"):
            result.events.withColumn("seq", F.col("seq") + number * _BATCH_EVENTS).write.mode("overwrite").parquet(events)
        logger.info("micro-batch %d is stored", number)

    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    out = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
