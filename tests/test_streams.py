"""Streams over keys that arrive in several chunks, out of order."""

import random

import pandas as pd
import pytest

from lexloom.operators import events, registry
from lexloom.sources.tables import KeyedTable
from lexloom.streaming import jobs


@pytest.fixture
def small_chunks(spark):
    """Arrow batches of a few rows, so that each key comes in many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def latest(spark, stream, key, folder):
    query = jobs.to_latest(stream, key, f"{folder}/state", f"{folder}/checkpoint")
    query.awaitTermination()
    df = KeyedTable(spark, f"{folder}/state", key).read()
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_progress_does_not_depend_on_the_order_of_chunks(spark, small_chunks, tmp_path):
    r = random.Random(3)
    rows = [(i, "document_status", "j", f"f{r.randint(0, 2)}", "s", "processing", f"m{i}", None, None, i, 300, i / 3, "pages", *[r.choice((None, None, i)) for _ in range(3)], None) for i in range(300)]
    r.shuffle(rows)
    log = spark.createDataFrame(rows, jobs.EVENTS).coalesce(1)
    log.write.parquet(f"{tmp_path}/log")
    want = events.fold_progress(log)
    got = latest(spark, jobs.stream_progress(jobs.event_stream(spark, f"{tmp_path}/log")), "filename", tmp_path)
    assert got == sorted(map(str, want.select(*sorted(want.columns)).collect()))


def test_registry_does_not_depend_on_the_order_of_chunks(spark, small_chunks, tmp_path):
    r = random.Random(4)
    rows = [(i, "reserve" if i % 5 == 0 else "update", f"h{r.randint(0, 2)}", "d", "f.pdf", f"i{i // 40}", r.choice(("processing", "completed", "failed")), r.choice((None, i)), r.choice((None, "boom"))) for i in range(300)]
    r.shuffle(rows)
    schema = "seq long, op string, document_hash string, document_id string, filename string, ingestion_id string, status string, indexed_chunks int, error string"
    log = spark.createDataFrame(rows, schema).coalesce(1)
    log.write.parquet(f"{tmp_path}/log")
    want = registry.registry_state(log)
    got = latest(spark, jobs.stream_registry(jobs.event_stream(spark, f"{tmp_path}/log", schema)), "document_hash", tmp_path)
    assert got == sorted(map(str, want.select(*sorted(want.columns)).collect()))


def test_follow_job_sends_later_events_up_to_the_end(spark, tmp_path):
    def event(seq, job, kind, status):
        return (seq, kind, job, "f", "s", status, *[None] * 11)

    def add(*rows):
        jobs.publish(spark.createDataFrame(rows, jobs.EVENTS).coalesce(1), f"{tmp_path}/log")

    sent = []
    add(event(1, "a", "document_status", "queued"), event(2, "b", "job_status", "completed"))
    query = jobs.follow_job(jobs.event_stream(spark, f"{tmp_path}/log"), "a", sent.extend, f"{tmp_path}/checkpoint")
    query.processAllAvailable()
    assert [x["seq"] for x in sent] == [1] and query.isActive
    add(event(3, "a", "document_status", "completed"), event(4, "a", "job_status", "completed"), event(5, "a", "document_status", "late"))
    assert query.awaitTermination(30)
    assert [x["seq"] for x in sent] == [1, 3, 4]


def test_folds_read_only_the_rows_that_decide():
    from lexloom.streaming.state import deciding

    rows = pd.DataFrame({"seq": [4, 9, 2, 7, 9], "native_pages": [1.0, None, 3.0, None, None], "ocr_pages": [None] * 5, "total_pages": [None, None, 5.0, 6.0, None]}, index=[5, 6, 7, 8, 9])
    assert deciding(rows)["seq"].tolist() == [4, 9, 7]
    many = pd.concat([rows] * 1000, ignore_index=True)
    assert len(deciding(many)) == 3
