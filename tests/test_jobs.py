"""The document job and the query job on small cases; connectors, scans, stored tables."""

import json
import logging

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.functions import INSUFFICIENT_EVIDENCE, OUT_OF_SCOPE, line_key, normalize_query, normalize_questions
from lexloom.jobs import answer, ingest
from lexloom.operators import events, segment
from lexloom.sources import http, models, sinks, uploads
from lexloom.sources.registry_store import RegistryStore
from lexloom.sources.settings import Settings
from lexloom.sources.tables import KeyedTable
from lexloom.streaming import jobs


def texts(n, bad=()):
    return "\n".join(["BAB I", "UMUM", *[f"Pasal {i}\n{'salah ' if i in bad else ''}Isi pasal nomor {i} yang cukup panjang." for i in range(1, n + 1)]])


def embed():
    def run(parts):
        if any("salah" in t for t in parts):
            raise RuntimeError("no vectors")
        return [([float(len(t)), 1.0], {len(t): 1.0}) for t in parts]

    return run


DOCUMENTS = "job_id string, position long, doc_id long, filename string, document_hash string, ingestion_id string"
PAGES = "doc_id long, filename string, page_number int, text string, mode string, error string"


def test_a_failing_document_leaves_the_others_alone(spark, tmp_path):
    docs = spark.createDataFrame([("a", i, i, f"f{i}.pdf", f"h{i}", f"i{i}") for i in range(4)] + [("b", 0, 9, "f9.pdf", "h9", "i9")], DOCUMENTS)
    pages = [(0, "f0.pdf", 1, texts(10), "native_text", None), (1, "f1.pdf", 1, "no heading at all", "full_ocr", None), (2, "f2.pdf", 1, texts(20, {11}), "native_text", None), (2, "f2.pdf", 2, "Pasal 99\nlast", "full_ocr", None), (3, "f3.pdf", 0, "", "native_text", "boom"), (9, "f9.pdf", 1, "nothing", "native_text", None)]
    points = sinks.Collection(spark, f"{tmp_path}/points", 2)
    out = ingest.process_documents(docs, spark.createDataFrame(pages, PAGES), embed, points)
    got = {r["doc_id"]: (r["status"], r["chunks"], r["indexed_chunks"], r["native_pages"], r["ocr_pages"], r["error"]) for r in out.outcomes.collect()}
    assert got == {0: ("completed", 10, 10, 1, 0, None), 1: ("failed", 0, 0, 0, 1, ingest.NO_CHUNKS), 2: ("failed", 21, 8, 1, 1, "no vectors"), 3: ("failed", 0, 0, 0, 0, "boom"), 9: ("failed", 0, 0, 1, 0, ingest.NO_CHUNKS)}
    # the batches before the failing one are stored
    assert {r["filename"]: r["n"] for r in points.read().groupBy("filename").agg(F.count(F.lit(1)).alias("n")).collect()} == {"f0.pdf": 10, "f2.pdf": 8}
    told = [(r["filename"], r["stage"], r["status"]) for r in out.events.where("job_id = 'a'").orderBy("seq").collect()]
    assert told[:3] == [("f0.pdf", "parsing", "processing")] * 3
    assert told[3:8] == [("f0.pdf", "embedding", "processing"), ("f0.pdf", "indexing", "processing")] * 2 + [("f0.pdf", "completed", "completed")]
    assert told[-1] == ("-", "job", "completed")
    assert ("f3.pdf", "failed", "failed") in told
    ends = {r["job_id"]: (r["status"], r["message"]) for r in out.events.where("type = 'job_status'").collect()}
    assert ends == {"a": ("completed", ingest.JOB_PARTLY), "b": ("failed", ingest.JOB_FAILED)}
    assert {r["outcome"] for r in events.job_outcomes(out.events).collect()} == {"completed", "failed"}
    assert out.log.where("status = 'failed'").count() == 4
    again = ingest.process_documents(docs.where("doc_id = 0"), spark.createDataFrame(pages[:1], PAGES), embed, points)
    assert again.outcomes.first()["indexed_chunks"] == 10
    assert points.read().count() == 18  # the same chunks of the same ingestion


def test_best_effort_and_crashes(spark, caplog):
    assert ingest.best_effort("x", lambda: 1)
    with caplog.at_level(logging.ERROR):
        assert not ingest.best_effort("the registry", lambda: 1 / 0)
        jobs.CrashLogger().onQueryTerminated(type("E", (), {"exception": "boom", "id": 1}))
    assert "the registry failed" in caplog.text
    assert "ended unexpectedly: boom" in caplog.text


def test_batch_sizes_and_empty_chunks(spark):
    rows = spark.createDataFrame([(d, n, f"i{d}", f"c{d}-{n}", "" if (d, n) == (1, 5) else "text") for d in range(2) for n in range(7)], "doc_id long, n int, ingestion_id string, chunk_id string, text string")
    got = ingest.index_chunks(rows, embed, None, batch=2)
    assert {(r["doc_id"], r["n"]) for r in got.where("indexed").collect()} == {(0, n) for n in range(7)} | {(1, n) for n in range(4)}
    assert {r["error"] for r in got.where("not indexed").collect()} == {"an empty chunk cannot be embedded"}
    with pytest.raises(ValueError):
        ingest.embed_batches(rows, embed, batch=0)


class Handed:
    """Stands for a frame whose rows come to a task in the parts given; takes the function that works on them."""

    schema = StructType()

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition

    def mapInArrow(self, run, kind):  # noqa: N802
        return run


def test_vectors_go_out_with_the_parts_and_not_by_batch():
    rows = [(f"d{i // 5}", "" if i == 53 else f"text {i}") for i in range(300)]
    parts = [rows[:7], [], rows[7:9], rows[9:212], rows[212:]]
    tables = [pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in p], pa.string()), "text": pa.array([t for _, t in p], pa.string())}) for p in parts]
    asked = []

    def embed(texts):
        asked.append(texts)
        return [([float(t[5:]), 0.5], {1: 2.0, 2: 0.0}) for t in texts]

    out = list(ingest.embed_batches(Handed(), lambda: embed, batch=3)(iter(tables)))
    assert len(out) <= len(parts) + 1
    got = [r for b in out for r in b.to_pylist()]
    assert [(r["doc_id"], r["text"]) for r in got] == rows
    # the second batch of the eleventh document fails, its first one stays
    assert [i for i, r in enumerate(got) if r["error"]] == [53, 54]
    assert all(r["dense"] == [float(r["text"][5:]), 0.5] and r["sparse"] == [(1, 2.0)] for r in got if not r["error"])
    assert all(r["dense"] is None and r["sparse"] is None for r in got if r["error"])
    assert {len(t) for t in asked} == {2, 3} and len(asked) == 119


def lexicon():
    words = ["upah", "cuti", "kontrak"]
    return lambda parts: [([float(t.lower().count(w)) for w in words], {i: float(t.lower().count(w)) for i, w in enumerate(words)}) for t in parts]


def test_questions_are_answered(spark, tmp_path):
    points = sinks.Collection(spark, f"{tmp_path}/points", 3)
    asked = spark.createDataFrame([(1, "Berapa  upah pasal1?"), (2, "resep kue"), (3, " "), (4, "hal lain"), (5, "Ｃuti")], "query_id long, question string")
    scope = lambda: lambda system, user: json.dumps({"is_labor_law": "kue" not in user})
    made = answer.Models(embed=lexicon, rerank=F.when(F.col("question").contains("lain"), 0.0).otherwise(0.5), generate=lambda: lambda q, c: f"**{q}**: {c.count('[')}", scope=scope)
    none = {r["query_id"]: r["answer"] for r in answer.answer_questions(asked, points, made).collect()}
    assert none == {1: INSUFFICIENT_EVIDENCE, 2: OUT_OF_SCOPE, 3: None, 4: INSUFFICIENT_EVIDENCE, 5: INSUFFICIENT_EVIDENCE}
    rows = [(f"c{i}", "uu.pdf", str(i), t) for i, t in enumerate(["Upah dibayar.", "Cuti tahunan.", "Kontrak kerja."])]
    chunks = spark.createDataFrame(rows, "chunk_id string, filename string, pasal string, text string").withColumns({"ayat": F.lit(None).cast("string"), "bab": F.lit("I"), "page_start": F.lit(1), "page_end": F.lit(2)})
    vectors = models.embed_texts(chunks, lexicon)
    points.upsert(chunks.join(vectors, "chunk_id"), "ing", "m")
    got = {r["query_id"]: r for r in answer.answer_questions(asked, points, made).collect()}
    assert got[1]["normalized"] == "Berapa upah Pasal 1?"
    assert got[1]["answer"] == "Berapa upah Pasal 1?: 3\n\nSumber: [1], [2], [3]"
    assert got[1]["sources"][0]["chunk_id"] == "c0"
    assert (got[1]["candidate_chunks"], got[1]["reranked_chunks"]) == (3, 3)
    assert got[5]["normalized"] == "Cuti"
    assert got[5]["sources"][0]["chunk_id"] == "c1"
    assert (got[4]["answer"], got[4]["candidate_chunks"], got[4]["reranked_chunks"]) == (INSUFFICIENT_EVIDENCE, 3, 0)
    assert (got[3]["error"], got[3]["in_scope"]) == (answer.INVALID, None)
    assert points.search("dense", asked, 0).count() == 0
    assert points.scroll_parent("uu.pdf", "1", 0).count() == 0
    assert [r["chunk_id"] for r in points.scroll_parent("uu.pdf", "1").collect()] == ["c1"]
    assert sinks.Collection(spark, f"{tmp_path}/none", 3).scroll_parent("uu.pdf", "1").count() == 0


def test_a_keyed_table_keeps_the_latest(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", "k", buckets=4)
    assert t.read() is None
    rows = lambda a, b, v: spark.range(a, b).select(F.col("id").cast("string").alias("k"), F.lit(v).alias("v"))
    t.upsert(rows(0, 100, 1))
    t.upsert(rows(50, 51, 2))
    before = {p.name for p in (tmp_path / "t" / "v1").glob("bucket=*")}
    t.upsert(rows(50, 51, 3))
    assert {p.name for p in (tmp_path / "t" / "v1").glob("bucket=*")} < before  # what nothing names any more is gone
    assert {(r["v"], r["n"]) for r in t.read().groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()} == {(1, 99), (3, 1)}
    t.upsert(rows(0, 100, 9), version=3)  # a batch that runs again
    assert t.read().where("v = 9").count() == 0
    t.upsert(rows(0, 0, 9))
    assert t.read().count() == 100
    assert t.version() == 4


def test_the_registry_is_durable(spark, tmp_path):
    store = RegistryStore(spark, f"{tmp_path}/registry")
    assert store.read().count() == 0
    docs = spark.createDataFrame([("h1", "d", "f", "i1"), ("h1", "d", "f", "i2"), ("h2", "d", "g", "i3")], "document_hash string, document_id string, filename string, ingestion_id string")
    assert {(r["document_hash"], r["ingestion_id"]): r["outcome"] for r in store.reserve(docs).collect()} == {("h1", "i1"): "inserted", ("h1", "i2"): "duplicate", ("h2", "i3"): "inserted"}
    step = "document_hash string, ingestion_id string, step int, status string, indexed_chunks long, error string"
    told = spark.createDataFrame([("h1", "i1", 1, "processing", None, None), ("h1", "i1", 2, "failed", None, "boom"), ("h2", "other", 2, "completed", 5, None)], step)
    assert sorted(r["outcome"] for r in store.update(told).collect()) == ["rejected", "updated", "updated"]
    store = RegistryStore(spark, f"{tmp_path}/registry")
    assert store.get("h1").select("status", "error", "ingestion_id").first() == ("failed", "boom", "i1")
    assert {r["outcome"] for r in store.reserve(docs.where("ingestion_id = 'i2'")).collect()} == {"reset"}
    assert store.get("h1").select("status", "error", "ingestion_id").first() == ("queued", None, "i2")
    assert store.get("h2").first()["status"] == "queued"
    assert store.get("h3").count() == 0


REPLY = {"embeddings": [[1.0, 2.0]], "sparse": [{"3": 0.5, "4": 0}]}


def test_requests_and_replies():
    sent = []

    def post(status, reply):
        def run(url, headers, body):
            sent.append((url, headers["Authorization"], body))
            return status, reply if isinstance(reply, str) else json.dumps(reply)

        return run

    s = Settings(api_key="k")
    assert http.embedder(s, post(200, REPLY))()(["a"]) == [([1.0, 2.0], {3: 0.5})]
    assert sent[-1] == (f"{s.base_url}/inference/{s.embedding_model}", "Bearer k", {"inputs": ["a"], "dense": True, "sparse": True, "colbert": False, "normalize": True})
    assert http.embedder(s, post(200, {"embeddings": [[1]], "sparse": [[0, 2.0]]}))()(["a"]) == [([1.0], {1: 2.0})]
    for broken in ({}, {"embeddings": [[1]], "sparse": []}, {"embeddings": [[]], "sparse": [{}]}, {"embeddings": [["x"]], "sparse": [{}]}, {"embeddings": [[1]], "sparse": [{"-1": 1}]}, "no json"):
        with pytest.raises(http.ServiceError):
            http.embedder(s, post(200, broken))()(["a"])
    with pytest.raises(http.ServiceError, match="HTTP 500.: gone"):
        http.embedder(s, post(500, {"detail": "gone"}))()(["a"])
    assert http.reranker(s, post(200, [0.5, "1"]))()("q", ["a", "b"]) == [0.5, 1.0]
    assert sent[-1][2]["queries"] == ["q", "q"]
    assert http.reranker(Settings(api_key="k", rerank_model="other"), post(200, {"scores": [1]}))()("q", ["a"]) == [1.0]
    assert sent[-1][2] == {"query": "q", "documents": ["a"]}
    said = {"choices": [{"message": {"content": "yes"}}]}
    assert http.scope_model(s, post(200, said))()("system", "user") == "yes"
    assert (sent[-1][2]["temperature"], sent[-1][2]["max_tokens"]) == (0.0, 16)
    assert http.answer_model(s, post(200, said))()("q", "c") == "yes"
    assert sent[-1][2]["max_tokens"] == s.generation_max_tokens
    with pytest.raises(http.ServiceError):
        http.answer_model(s, post(200, {"choices": []}))()("q", "c")
    with pytest.raises(ValueError, match="api_key"):
        http.embedder(Settings(), post(200, REPLY))()
    assert Settings.of({"DEEPINFRA_API_KEY": "x", "QDRANT_HOST": "http://h/"}) == Settings(api_key="x", store_host="http://h")


def test_scans(spark, tmp_path):
    for name in ("a.pdf", "b.pdf", "c.pdf"):
        (tmp_path / name).write_bytes(name.encode())

    def extract(content):
        if content == b"b.pdf":
            raise ValueError("broken")
        image = [(0.0, 0.0, 595.0, 842.0)]
        return [(1, 595.0, 842.0, "native " * 200, []), (2, 595.0, 842.0, "", image), (3, 595.0, 842.0, "", image)]

    def ocr():
        return lambda content, page, language, dpi: f"read {content.decode()} {page} {language} {dpi}" if page < 3 else "  "

    read = lambda mode: {(r["filename"], r["page_number"]): (r["mode"], r["text"], r["error"]) for r in uploads.scan_documents(uploads.read_uploads(spark, str(tmp_path)), extract, ocr, mode=mode).collect()}
    got = read("hybrid")
    assert got["a.pdf", 2] == ("full_ocr", "read a.pdf 2 ind 300", None)
    assert got["c.pdf", 3] == ("full_ocr", None, "Full-page OCR tidak menghasilkan teks pada halaman 3")
    assert got["c.pdf", 1][0] == "native_text"
    assert got["b.pdf", 0][2] == "ValueError: broken"
    assert {m for m, _, _ in read("native").values()} == {"native_text"}
    assert read("full_ocr")["a.pdf", 1][1] == "read a.pdf 1 ind 300"
    blocks = spark.createDataFrame([([(9.0, 1.0, "b"), (1.0, 1.0, "a"), (0.0, 5.0, "c")],)], "x array<struct<x0:double,y0:double,text:string>>")
    assert blocks.select(uploads.reading_order(F.col("x")).alias("t")).first()["t"] == "a\nb\nc"
    assert uploads.check_ocr(lambda p: "/bin/x", lambda: ["ind"]) is None
    for find, known in ((lambda p: None, ["ind"]), (lambda p: "/bin/x", ["eng"])):
        with pytest.raises(RuntimeError):
            uploads.check_ocr(find, lambda k=known: k)


def test_lost_connections_and_lists(spark):
    def event(seq, job, name, status):
        return (seq, "document_status", job, name, "s", status, "m", *[None] * 10)

    log = spark.createDataFrame([event(1, "j", "a", "processing"), event(2, "j", "a", "completed")], jobs.EVENTS)
    known = events.fold_progress(log.where("seq = 1"))
    assert jobs.replay_job(log, "j", known).first()["status"] == "completed"
    assert jobs.replay_job(log, "gone", known).first()["error"] == events.JOB_LOST
    listed = spark.createDataFrame([("a", "completed"), ("b", "processing"), ("c", None)], "filename string, status string")
    assert sorted(r["filename"] for r in events.remove_files(listed, ["a", "b", "c"]).collect()) == ["b"]
    assert sinks.job_status(log, "j").count() == 2
    assert sinks.job_status(log, "gone").count() == 0
    assert sinks.sse_feed(log.where("seq = 1")).first()["sse"].startswith('event: document_status\ndata: {"type":"document_status"')


def test_unicode_questions_and_keys(spark):
    df = spark.createDataFrame([("ＰＡＳＡＬ 12",), ("plain pasal 3",), (None,)], "question string")
    got = normalize_questions(df).select(normalize_query(F.col("question")).alias("q")).collect()
    assert sorted(str(r["q"]) for r in got) == ["None", "Pasal 12", "plain Pasal 3"]
    keys = spark.createDataFrame([("STRASSE",), ("Straße",), ("STRAẞE",), ("ΟΔΟΣ",), ("οδος",)], "x string").select(line_key(F.col("x")).alias("k")).collect()
    assert len({r["k"] for r in keys}) == 2
    lines = segment.page_lines(spark.createDataFrame([(1, 1, "ﬁn­al​\nＡ")], "doc_id long, page_number int, text string"))
    assert sorted(r["line"] for r in lines.collect()) == ["A", "final"]
