"""Structured Streaming twins: the progress fold and the registry as streams that keep their state.

Events carry no time, only an append order, so a sequence number orders them and there is no watermark: state is per
file or document and lives as long as the job log.
"""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.operators.events import KEPT, LAST, fold_progress, is_terminal, mark_lost, up_to_terminal
from lexloom.operators.registry import STATE, fold_batches
from lexloom.sources.tables import KeyedTable
from lexloom.streaming.state import deciding

EVENTS = (
    "seq long, type string, job_id string, filename string, stage string, status string, message string, chunks int, indexed_chunks int, progress_current int, progress_total int, progress_percent double, progress_unit string, "
    "native_pages int, ocr_pages int, total_pages int, error string"
)
_FOLDED = "filename string, stage string, status string, message string, chunks int, indexed_chunks int, progress_current int, progress_total int, progress_percent double, progress_unit string, error string, native_pages int, ocr_pages int, total_pages int"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, *, files_per_batch: int | None = None) -> DataFrame:
    """Events of a folder of Parquet files, the history first and then what is added: no gap and no repeat."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def stream_progress(events: DataFrame) -> DataFrame:
    """fold_progress as a stream: a row with the new state of each file that a batch touches (update mode)."""
    names = [x.split()[0] for x in _FOLDED.split(", ")]
    n = len(names) - 1

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # each value has the seq it came with: a key's chunks come in no promised order, and a replay changes nothing
        held, seqs = (list(state.get[:n]), list(state.get[n:])) if state.exists else ([None] * n, [-1] * n)
        for rows in batches:
            for x in deciding(rows).itertuples():
                for i, c in enumerate(names[1:]):
                    v = getattr(x, c)
                    v = None if pd.isna(v) else v if isinstance(v, str) else float(v) if c == "progress_percent" else int(v)
                    if x.seq > seqs[i] and (c in LAST or v is not None):
                        held[i], seqs[i] = v, int(x.seq)
        state.update((*held, *seqs))
        yield pd.DataFrame([(key[0], *held)], columns=names)

    own = events.where((F.col("filename") != "-") & (F.col("type") != "job_status"))
    return own.groupBy("filename").applyInPandasWithState(fold, _FOLDED, ", ".join([_FOLDED.partition(", ")[2], *(f"{c}_seq long" for c in names[1:])]), "update", GroupStateTimeout.NoTimeout)


def stream_registry(log: DataFrame) -> DataFrame:
    """registry_state as a stream: a row with the new state of each document that a batch touches (update mode)."""
    names = [x.split()[0] for x in STATE.split(", ")]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = fold_batches(batches, dict(zip(names, state.get, strict=True)) if state.exists else None)
        if new is not None:
            state.update(tuple(new[c] for c in names))
            yield pd.DataFrame([tuple(new[c] for c in names)], columns=names)

    return log.groupBy("document_hash").applyInPandasWithState(fold, STATE, STATE, "update", GroupStateTimeout.NoTimeout)


def publish(events: DataFrame, path: str) -> None:
    """Appends events to the log folder that event_stream reads."""
    events.write.mode("append").parquet(path)


def to_latest(stream: DataFrame, key: str, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Keeps the latest row of each key in the KeyedTable under `path`; a batch rewrites the buckets it touches, and once if it runs again."""
    table = KeyedTable(stream.sparkSession, path, key)
    out = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    out = out.foreachBatch(lambda batch, number: table.upsert(batch.dropDuplicates([key]), number + 1))
    return (out.trigger(availableNow=True) if once else out).start()


class CrashLogger(StreamingQueryListener):
    """Logs streaming queries that end with an error, which nobody may be waiting for."""

    def __init__(self, log: logging.Logger = logging.getLogger(__name__)) -> None:
        self.log = log

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception is not None:
            self.log.error("query %s ended unexpectedly: %s", event.id, event.exception)


def replay_job(history: DataFrame, job_id: str, known: DataFrame) -> DataFrame:
    """Files as they stand after a lost connection: the job's history folded anew, or, where the job is gone, `known` files marked lost."""
    own = history.where(F.col("job_id") == job_id)
    return fold_progress(own) if own.limit(1).count() else mark_lost(known)


def follow_job(events: DataFrame, job_id: str, send: Callable[[list[dict]], None], checkpoint: str, *, every: str = "1 second") -> StreamingQuery:
    """Sends a job's events as they come and stops at the one that ends it."""
    ended = threading.Event()

    def deliver(batch: DataFrame, _: int) -> None:
        if ended.is_set():
            return
        own = batch.where(F.col("job_id") == job_id)
        # the events of one job, which its reader gets one by one anyway
        send([r.asDict() for r in up_to_terminal(own).orderBy("seq").toLocalIterator()])
        if own.where(is_terminal(F.col("type"), F.col("status"))).limit(1).count():
            ended.set()

    query = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(deliver).trigger(processingTime=every).start()

    def stop() -> None:
        # from a thread of its own: a query that is stopped by its own batch would wait for itself
        while query.isActive and not ended.wait(1):
            pass
        query.stop()

    threading.Thread(target=stop, daemon=True).start()
    return query


__all__ = ["EVENTS", "KEPT", "CrashLogger", "event_stream", "follow_job", "publish", "replay_job", "stream_progress", "stream_registry", "to_latest"]
