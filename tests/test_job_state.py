"""The fold with state that ends: equal to the batch fold, cleared after the end, begun from a table."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from lexloom.operators.events import fold_progress
from lexloom.sources.tables import KeyedTable
from lexloom.streaming import jobs, state

NONE = [None] * 10


def _events(spark, rows):
    """(seq, type, job, file, stage, status, message, chunks, error) rows."""
    return spark.createDataFrame([(*r[:8], *[None] * 8, r[8]) for r in rows], jobs.EVENTS)


def _run(spark, path, *, initial=None, grace=1):
    with state.rocksdb(spark):
        stream = state.stream_jobs(jobs.event_stream(spark, f"{path}/log"), grace_ms=grace, initial=initial)
        table = KeyedTable(spark, f"{path}/state", "k")
        keyed = stream.withColumn("k", F.concat_ws("/", "job_id", "filename"))
        out = keyed.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint")
        out.foreachBatch(lambda b, n: table.upsert(b.dropDuplicates(["k"]), n + 1)).trigger(availableNow=True).start().awaitTermination()
    return table.read().drop("k")


def _rows(df):
    return sorted(map(str, df.select("filename", *state.NAMES).collect()))


def test_equal_to_the_batch_fold_in_chunks_of_two_and_empty_after_the_end(spark, tmp_path):
    rows = []
    for seq in range(60):
        job, file = f"j{seq % 2}", f"f{seq % 2}{seq % 3}"
        rows.append((seq, "document_status", job, file, f"s{seq % 5}", "processing", f"m{seq}", seq if seq % 4 else None, "e" if seq % 7 == 0 else None))
    log = _events(spark, rows)
    path = f"{tmp_path}/a"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        jobs.publish(log.where("seq < 40").orderBy(F.desc("seq")).coalesce(1), f"{path}/log")
        _run(spark, path)
        jobs.publish(log.where("seq >= 40").coalesce(1), f"{path}/log")
        got = _run(spark, path)
        assert _rows(got) == _rows(fold_progress(log))
        assert state.held(spark, f"{path}/checkpoint") == 6
        ends = _events(spark, [(100, "job_status", "j0", "-", "job", "completed", "done", None, None), (101, "document_status", "j1", "f10", "s", "processing", "more", None, None)])
        jobs.publish(ends.coalesce(1), f"{path}/log")
        _run(spark, path)
        time.sleep(0.1)
        jobs.publish(_events(spark, [(102, "document_status", "j1", "f10", "s", "failed", "late", None, "e")]).coalesce(1), f"{path}/log")
        got = _run(spark, path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert state.held(spark, f"{path}/checkpoint") == 3  # those of j1, which goes on
    assert {r["filename"]: r["message"] for r in got.where("job_id = 'j1'").collect()}["f10"] == "late"


def test_it_begins_from_a_table(spark, tmp_path):
    path = f"{tmp_path}/a"
    kept = spark.createDataFrame([("j", "f", "s0", "processing", "old", 7, *[None] * 5, None, 2, 1, 3, 50)], state.INITIAL)
    jobs.publish(_events(spark, [(40, "document_status", "j", "f", "s", "x", "too old", 1, None), (51, "document_status", "j", "g", "s", "x", "new", 1, None)]).coalesce(1), f"{path}/log")
    _run(spark, path, initial=kept, grace=60_000)
    jobs.publish(_events(spark, [(52, "document_status", "j", "f", "s1", "completed", "later", None, None)]).coalesce(1), f"{path}/log")
    got = {r["filename"]: r for r in _run(spark, path, initial=kept, grace=60_000).collect()}
    assert (got["f"]["message"], got["f"]["ocr_pages"], got["f"]["status"]) == ("later", 1, "completed")
    assert got["g"]["message"] == "new"
