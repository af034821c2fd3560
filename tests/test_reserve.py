"""Reservations by many writers: one of them wins, each is told, batches that run again change nothing."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from lexloom.sources.registry_store import RegistryStore
from lexloom.streaming import reserve

KIND = "op string, document_hash string, document_id string, filename string, ingestion_id string, status string, error string"


def _ask(spark, path, rows):
    return reserve.request(spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], KIND).coalesce(1), path)


def test_of_eight_threads_one_reserves(spark, tmp_path):
    path, told = f"{tmp_path}/r", {}
    _ask(spark, path, [("reserve", "old", "d", "f", "i0")])
    query = reserve.serve(spark, path, every="100 milliseconds")

    def writer(k):
        told[k] = [r["request_id"] for r in _ask(spark, path, [("reserve", "h", "d", f"f{k}", f"i{k}"), ("reserve", f"own{k}", "d", "f", f"i{k}")]).collect()]

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    query.processAllAvailable()
    query.stop()
    got = {r["request_id"]: r for r in reserve.outcomes(spark, path).collect()}
    assert set(got) >= {i for ids in told.values() for i in ids} and len(got) == 17
    same = [r for r in got.values() if r["document_hash"] == "h"]
    assert sorted(r["outcome"] for r in same) == ["duplicate"] * 7 + ["inserted"]
    winner = next(r["ingestion_id"] for r in same if r["outcome"] == "inserted")
    store = RegistryStore(spark, f"{path}/registry")
    assert store.get("h").first()["ingestion_id"] == winner
    assert store.read().count() == 10


def test_a_batch_that_runs_again_tells_the_same(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/r"
    _ask(spark, path, [("reserve", "a", "d", "f", "i1"), ("reserve", "b", "d", "f", "i1")])
    reserve.serve(spark, path, once=True).awaitTermination()
    _ask(spark, path, [("update", "a", None, None, "i1", "failed", "boom"), ("update", "b", None, None, "i9", "failed")])
    _ask(spark, path, [("reserve", "a", "d", "f", "i2")])
    real = RegistryStore(spark, f"{path}/registry").table.__class__.upsert
    for moment in ("before", "after"):  # lost before the registry is written, and after that but before the batch is noted

        def lost(self, rows, version=None, moment=moment):
            if moment == "after":
                real(self, rows, version)
            raise RuntimeError("lost")

        with monkeypatch.context() as m:
            m.setattr("lexloom.sources.tables.KeyedTable.upsert", lost)
            with pytest.raises(Exception, match="lost"):
                reserve.serve(spark, path, once=True).awaitTermination()
    reserve.serve(spark, path, once=True).awaitTermination()
    got = sorted((r["document_hash"], r["op"], r["ingestion_id"], r["outcome"]) for r in reserve.outcomes(spark, path).collect())
    assert got == [("a", "reserve", "i1", "inserted"), ("a", "reserve", "i2", "reset"), ("a", "update", "i1", "updated"), ("b", "reserve", "i1", "inserted"), ("b", "update", "i9", "rejected")]
    state = {r["document_hash"]: (r["ingestion_id"], r["status"], r["error"]) for r in RegistryStore(spark, f"{path}/registry").read().collect()}
    assert state == {"a": ("i2", "queued", None), "b": ("i1", "queued", None)}


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    store = RegistryStore(spark, f"{tmp_path}/s")
    assert store.get("h1").count() == 0
    store.reserve(spark.range(300).select(F.concat(F.lit("h"), "id").alias("document_hash"), F.lit("d").alias("document_id"), F.lit("f").alias("filename"), F.lit("i").alias("ingestion_id")))
    found = store.get("h7")
    assert [r["document_hash"] for r in found.collect()] == ["h7"]
    assert len({f.rsplit("/", 2)[-2] for f in found.inputFiles()}) == 1 < len({f.rsplit("/", 2)[-2] for f in store.read().inputFiles()})
    assert store.get("unknown").count() == 0
