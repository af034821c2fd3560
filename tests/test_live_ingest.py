"""The document job as a stream: partial commit, resume after a crash, live readers, failures that stay with their document."""

from __future__ import annotations

import threading
import time

import pytest

from lexloom.jobs import ingest as job
from lexloom.sources.registry_store import RegistryStore
from lexloom.sources.sinks import Collection
from lexloom.streaming import ingest


def _embed():
    def embed(texts):
        if any("SALAH" in t for t in texts):
            raise ValueError("embedding failed")
        return [([1.0] * (3 if "PANJANG" in t else 2), {1: 1.0}) for t in texts]

    return embed


def _page(*lines):
    return [(1, "\n".join(["Pasal 1", *lines]), "native_text", None)]


def _queue(spark, folder, rows):
    for row in rows:  # a file each, so each is a micro-batch
        spark.createDataFrame([row], ingest.DOCUMENTS).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.01)


def _jobs(n_jobs=2, size=3):
    return [(f"job{j}", size, p, f"d{j}{p}", f"{j}-{p}.pdf", f"h{j}{p}", f"i{j}{p}", _page(f"isi dokumen {j} {p}")) for p in range(size) for j in range(n_jobs)]


def _points(spark, folder):
    return sorted((r["point_id"], r["text"]) for r in Collection(spark, f"{folder}/points", 2).read().collect())


def _log(spark, folder):
    rows = ingest.event_log(spark, f"{folder}/out").collect()
    by_job = {}
    for r in sorted(rows, key=lambda r: (r["job_id"], r["seq"])):
        by_job.setdefault(r["job_id"], []).append((r["filename"], r["stage"], r["status"], r["message"]))
    return by_job


def _run(spark, source, folder, connect=_embed, **more):
    ingest.ingest_stream(spark, source, f"{folder}/out", lambda: connect(), Collection(spark, f"{folder}/points", 2), f"{folder}/checkpoint", **more).awaitTermination()


def test_a_crash_leaves_what_was_stored_and_a_restart_ends_as_if_undisturbed(spark, tmp_path, monkeypatch):
    source = f"{tmp_path}/queue"
    _queue(spark, source, _jobs(1, 4))
    calls, real = [], ingest.process_documents

    def crash(*args, **more):
        calls.append(1)
        if len(calls) == 3:
            real(*args, **more)  # its points are stored, its events are not
            raise RuntimeError("lost")
        return real(*args, **more)

    with monkeypatch.context() as m:
        m.setattr(ingest, "process_documents", crash)
        with pytest.raises(Exception, match="lost"):
            _run(spark, source, f"{tmp_path}/a")
    assert ingest.outcomes(spark, f"{tmp_path}/a/out").count() == 2
    assert len(_points(spark, f"{tmp_path}/a")) == 3
    held = _log(spark, f"{tmp_path}/a")
    assert not any(e[0] == "-" for events in held.values() for e in events)
    _run(spark, source, f"{tmp_path}/a")
    _run(spark, source, f"{tmp_path}/b")
    assert _points(spark, f"{tmp_path}/a") == _points(spark, f"{tmp_path}/b")
    log = _log(spark, f"{tmp_path}/a")
    assert log == _log(spark, f"{tmp_path}/b")
    for events in log.values():  # one end, after the last document
        assert [e[:3] for e in events if e[0] == "-"] == [("-", "job", "completed")] and events[-1][0] == "-"


def test_readers_see_events_while_the_job_runs(spark, tmp_path):
    source, folder = f"{tmp_path}/queue", f"{tmp_path}/a"
    _queue(spark, source, _jobs(1, 4))
    seen, lock, gate = {0: [], 1: []}, threading.Lock(), threading.Event()
    real = ingest.process_documents

    def read(k):
        def keep(rows, _):
            with lock:
                seen[k] += [(r["seq"], r["filename"], r["status"]) for r in rows.orderBy("seq").collect()]

        return ingest.follow_events(spark, f"{folder}/out").writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/reader{k}").trigger(processingTime="200 milliseconds").start()

    def slow(*args, **more):
        if len(held := [1 for n in range(9) if ingest.finished(spark, f"{folder}/out/events/batch={n}")]) == 2:
            gate.wait(60)  # the job stands still after two micro-batches
        assert len(held) < 9
        return real(*args, **more)

    ingest.process_documents = slow
    try:
        query = ingest.ingest_stream(spark, source, f"{folder}/out", lambda: _embed(), Collection(spark, f"{folder}/points", 2), f"{folder}/checkpoint")
        end = time.time() + 90
        while not ingest.finished(spark, f"{folder}/out/events/batch=1") and time.time() < end:
            time.sleep(0.2)
        readers = [read(0)]  # begins midway: history first
        while len({f for _, f, _ in seen[0]}) < 2 and time.time() < end:
            time.sleep(0.2)
        assert {f for _, f, _ in seen[0]} == {"0-0.pdf", "0-1.pdf"} and query.isActive
        readers.append(read(1))
        gate.set()
        query.awaitTermination()
        for reader in readers:
            reader.processAllAvailable()
            reader.stop()
    finally:
        ingest.process_documents = real
    log = sorted((r["seq"], r["filename"], r["status"]) for r in ingest.event_log(spark, f"{folder}/out").collect())
    for own in seen.values():
        assert sorted(own) == log and len(set(own)) == len(own)
    assert log[-1][1:] == ("-", "completed")


def test_failures_stay_with_their_document_and_the_registry_follows(spark, tmp_path):
    long = [" ".join(["kata"] * 150) for _ in range(3)]
    rows = [
        ("job1", 4, 0, "a", "a.pdf", "ha", "ia", _page("isi yang baik")), ("job1", 4, 1, "b", "b.pdf", "hb", "ib", _page(*long, "PANJANG")),
        ("job1", 4, 2, "c", "c.pdf", "hc", "ic", [(1, "", "native_text", "broken file")]), ("job1", 4, 3, "d", "d.pdf", "hd", "id", _page("tanpa SALAH")),
        ("job2", 1, 0, "e", "e.pdf", "he", "ie", [(1, "tanpa pasal", "native_text", None)]),
    ]
    spark.createDataFrame(rows, ingest.DOCUMENTS).coalesce(1).write.parquet(f"{tmp_path}/queue")
    store = RegistryStore(spark, f"{tmp_path}/registry")
    store.reserve(spark.createDataFrame([(r[5], r[3], r[4], r[6]) for r in rows], "document_hash string, document_id string, filename string, ingestion_id string"))
    _run(spark, f"{tmp_path}/queue", f"{tmp_path}/a", batch=1, registry=store)
    got = {r["doc_id"]: (r["status"], r["chunks"], r["indexed_chunks"], r["error"]) for r in ingest.outcomes(spark, f"{tmp_path}/a/out").collect()}
    assert got["a"] == ("completed", 1, 1, None)
    assert got["b"] == ("failed", 3, 2, "a vector of 3 values where the collection has 2")
    assert got["c"][3] == "broken file" and got["d"][3] == "embedding failed" and got["e"][3] == job.NO_CHUNKS
    log = _log(spark, f"{tmp_path}/a")
    assert log["job1"][-1][3] == job.JOB_PARTLY and log["job2"][-1][3] == job.JOB_FAILED
    assert {r["document_hash"]: r["status"] for r in store.read().collect()} == {"ha": "completed", "hb": "failed", "hc": "failed", "hd": "failed", "he": "failed"}


def test_unfit_documents_are_marked_and_the_rest_is_stored(spark, tmp_path):
    rows = [("a", 0, "i", "c0", "t"), ("a", 1, "i", "c0", "t"), ("b", 0, "i", " ", "t"), ("b", 1, "i", "c1", "t"), ("c", 0, "i", "c2", "t")]
    chunks = spark.createDataFrame(rows, "doc_id string, n int, ingestion_id string, chunk_id string, text string")
    points = Collection(spark, f"{tmp_path}/points", 2)
    got = {(r["doc_id"], r["n"]): r["error"] for r in job.index_chunks(chunks, lambda: _embed(), points).collect()}
    assert got == {("a", 0): "repeated chunk id c0", ("a", 1): "repeated chunk id c0", ("b", 0): "a chunk without an id", ("b", 1): "a chunk without an id", ("c", 0): None}
    assert [r["chunk_id"] for r in points.read().collect()] == ["c2"]
