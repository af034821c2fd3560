"""Reservations by many writers at once: requests are appended to a log, one stream applies them to the registry.

Each call writes to a folder of its own, so calls never disturb each other, and Spark's checkpoint lets one query alone
advance the log, so of all that ask for a document hash exactly one is told `inserted` (or `reset`, after a failure), whoever asks, from whichever session. Each
request has an id under which its outcome appears.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.registry import STATE
from lexloom.sources.registry_store import LOG, RegistryStore
from lexloom.sources.tables import finished, stored

REQUESTS = f"request_id string, asked_at timestamp, op string, {STATE}"
OUTCOMES = "request_id string, document_hash string, ingestion_id string, op string, outcome string"


def request(operations: DataFrame, path: str) -> DataFrame:
    """Appends operations (op `reserve` or `update`, and columns of the registry; missing ones are null); returns them with request_id.

    Operations of one hash take effect in order of the time of their call and then of request_id.
    """
    names = [c.split()[0] for c in REQUESTS.split(", ")]
    base = uuid.uuid4().hex
    kinds = dict(c.split() for c in REQUESTS.split(", "))
    rows = operations.withColumn("request_id", F.concat(F.lit(base + "-"), F.monotonically_increasing_id().cast("string"))).withColumn("asked_at", F.current_timestamp())
    rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names])
    rows = stored(rows, "requests")
    rows.write.parquet(f"{path}/requests/call={base}")
    return rows


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """What each request that has been applied did."""
    return spark.read.schema(OUTCOMES).parquet(f"{path}/outcomes/*")


def serve(spark: SparkSession, path: str, *, once: bool = False, every: str = "1 second") -> StreamingQuery:
    """Applies the requests under `path` to the registry there, a micro-batch at a time, each once even if it runs again.

    A second query on the same path is refused by the checkpoint. once: ends when there is nothing new.
    """
    store = RegistryStore(spark, f"{path}/registry")

    def take(batch: DataFrame, number: int) -> None:
        if store.table.version() > number and finished(spark, f"{path}/outcomes/batch={number}"):
            return
        order = F.row_number().over(Window.partitionBy("document_hash").orderBy("asked_at", "request_id")) - 1
        rows = stored(batch.withColumn("seq", order.cast("long")), "asked")
        did, state = store.tried(rows.select(*[c.split()[0] for c in LOG.split(", ")]))
        told = rows.join(did.select("document_hash", "seq", "outcome"), (rows["document_hash"].eqNullSafe(did["document_hash"])) & (rows["seq"] == did["seq"])).select("request_id", rows["document_hash"], "ingestion_id", "op", "outcome")
        # the outcomes first: they follow from the registry as it was, which a batch that runs again finds unchanged
        told.write.mode("overwrite").parquet(f"{path}/outcomes/batch={number}")
        store.table.upsert(state, number + 1)

    stream = spark.readStream.schema(REQUESTS).parquet(f"{path}/requests/*")
    out = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{path}/checkpoint")
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()
