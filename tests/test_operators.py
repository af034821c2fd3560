"""Page decisions, vectors, fusion, context, registry, events, sources on small cases."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.operators import context, events, fusion, pages, registry, vectors
from lexloom.sources import models, settings, sinks, uploads


def test_union_area_equals_a_grid(spark):
    r, rows = random.Random(2), []
    for i in range(120):
        rows.append((i, [(float(x), float(y), float(x + r.randint(-1, 6)), float(y + r.randint(-1, 6))) for x, y in ((r.randint(-3, 12), r.randint(-3, 12)) for _ in range(r.randint(0, 6)))]))
    df = spark.createDataFrame(rows, "id long, boxes array<struct<x0:double,y0:double,x1:double,y1:double>>")
    got = {x["id"]: x["c"] for x in df.select("id", pages.image_coverage(F.col("boxes"), F.lit(10.0), F.lit(10.0)).alias("c")).collect()}
    for i, boxes in rows:
        cells = {(x, y) for x in range(10) for y in range(10) for a, b, c, d in boxes if a <= x < c and b <= y < d}
        assert abs(got[i] - len(cells) / 100) < 1e-9


@pytest.mark.parametrize(
    ("bad", "chars", "density", "images", "coverage", "reason"),
    [
        (True, 900, 9.0, 0, 0.0, "suspicious_or_broken_native_text"), (False, 0, 0.0, 1, 0.1, "no_native_text_with_images"), (False, 199, 9.0, 1, 0.7, "image_dominant_with_low_native_density"), (False, 200, 5.9, 1, 0.7, "image_dominant_with_low_native_density"),
        (False, 200, 6.0, 1, 0.7, "native_text_trustworthy"), (False, 199, 9.0, 1, 0.69, "native_text_trustworthy"), (False, 399, 9.0, 2, 0.5, "multiple_images_with_incomplete_native_text"), (False, 400, 7.9, 2, 0.5, "multiple_images_with_incomplete_native_text"), (False, 400, 8.0, 2, 0.5, "native_text_trustworthy"),
    ],
)
def test_ocr_reasons(spark, bad, chars, density, images, coverage, reason):
    assert spark.range(1).select(pages.ocr_reason(*map(F.lit, (bad, chars, density, images, coverage))).alias("r")).first()["r"] == reason


def test_page_modes(spark):
    df = spark.createDataFrame([(1, 1, "text", 595.0, 842.0, None), (1, 2, None, 595.0, 842.0, [(0.0, 0.0, 595.0, 842.0)])], "doc_id long, page_number int, text string, page_w double, page_h double, boxes array<struct<x0:double,y0:double,x1:double,y1:double>>")
    assert [r["should_ocr"] for r in pages.analyze_pages(df).orderBy("page_number").collect()] == [False, True]
    assert {r["decision_reason"] for r in pages.analyze_pages(df, "full_ocr").collect()} == {"mode_forced_full_ocr"}
    ocr = spark.createDataFrame([(1, 2, " read ")], "doc_id long, page_number int, ocr_text string")
    assert [r["final_text"] for r in pages.choose_text(pages.analyze_pages(df), ocr).orderBy("page_number").collect()] == ["text", "read"]


def test_sparse_weights(spark):
    df = spark.createDataFrame([({7: 0.5, 3: 0.0, 1: 0.2},)], "w map<int,double>")
    i, v = vectors.parse_sparse(F.col("w"))
    assert tuple(df.select(i.alias("i"), v.alias("v")).first()) == ([1, 7], [0.2, 0.5])
    bad = spark.createDataFrame([({-1: 0.5},), ({1: float("nan")},), ({1: 1.0},)], "w map<int,double>")
    assert [r[0] for r in bad.select(vectors.sparse_ok(F.col("w"))).collect()] == [False, False, True]


def test_dense_in_blocks_equals_one_block(spark, monkeypatch):
    r = random.Random(1)
    points = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(40)], "id long, dense array<double>")
    asked = points.where("id < 9").withColumnRenamed("id", "query_id")
    once = sorted(map(tuple, vectors.dense_top_k(points, asked, 5).collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, vectors.dense_top_k(points, asked, 5).collect())) == once
    assert vectors.dense_top_k(points, asked, 0).count() == 0


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id string, score double, rank long")


def test_fusion(spark):
    dense = hits(spark, [(1, "a", 0.9, 1), (1, None, 0.8, 2), (1, "b", 0.7, 3)])
    sparse = hits(spark, [(1, "c", 5.0, 1), (1, "a", 4.0, 2)])
    got = fusion.fuse_rrf(dense, sparse).orderBy("position").collect()
    assert [r["id"] for r in got] == ["a", "c", "b"]
    assert abs(got[0]["rrf_score"] - (1 / 61 + 1 / 62)) < 1e-12
    assert abs(got[2]["rrf_score"] - 1 / 63) < 1e-12
    tie = fusion.fuse_rrf(hits(spark, [(1, "x", 1.0, 1)]), hits(spark, [(1, "y", 1.0, 1)])).orderBy("position").collect()
    assert [r["id"] for r in tie] == ["x", "y"]
    twice = fusion.fuse_rrf(hits(spark, [(1, "x", 1.0, 1), (1, "x", 0.5, 2)]), hits(spark, [])).first()
    assert abs(twice["rrf_score"] - (1 / 61 + 1 / 62)) < 1e-12
    assert twice["dense_score"] == 0.5


def test_rerank(spark):
    df = spark.createDataFrame([(1, str(i), i, s) for i, s in enumerate([0.05, 0.049, 0.9, 0.9, 0.3, 0.2, 0.1, 0.08], 1)], "query_id long, id string, position long, s double")
    got = fusion.rerank(df, F.col("s")).orderBy("rerank_rank").collect()
    assert [r["id"] for r in got] == ["3", "4", "5", "6", "7", "8", "1"]
    scorer = models.model_rerank(lambda: lambda q, texts: [float(len(t)) for t in texts], question="id", text="id")
    assert fusion.rerank(df, scorer, min_score=0).count() == 7


def test_parents_and_context(spark):
    rows = [(1, 1, "d", "5", "1", "B", f"d-part{i}", t, 1, p, 0.5) for i, t, p in ((10, "ten", 1), (2, "two", 2))] + [(1, 3, "d", None, "", None, "x", " own ", 3, 3, 0.1234567)]
    df = spark.createDataFrame([(q, n + k, *rest) for k, (q, n, *rest) in enumerate(rows)], "query_id long, rerank_rank long, filename string, pasal string, ayat string, bab string, chunk_id string, text string, page_start int, page_end int, rerank_score double")
    expanded = context.expand_parents(df, context.parent_texts(df, df))
    assert [r["context_text"] for r in expanded.orderBy("rerank_rank").collect()] == ["ten\ntwo", "two", "own"]
    assert context.build_context(expanded).first()["context"] == "[1] d · halaman 1 · Pasal 5 · Ayat 1\nten\ntwo\n\n[2] d · halaman 1-2 · Pasal 5 · Ayat 1\ntwo\n\n[3] d · halaman 3\nown"
    cited = context.sources(df).orderBy("id").collect()
    assert [(r["page_end"], r["article"], r["paragraph"], r["rerank_score"]) for r in cited] == [(None, "Pasal 5", "Ayat 1", 0.5), (2, "Pasal 5", "Ayat 1", 0.5), (None, None, "Ayat ", 0.123457)]


LOG = "seq long, op string, document_hash string, document_id string, filename string, ingestion_id string, status string, indexed_chunks int, error string"


def test_registry(spark):
    row = lambda seq, op, ing, status=None, n=None: (seq, op, "h", "d", "f", ing, status, n, None)
    log = spark.createDataFrame([row(1, "reserve", "i1"), row(2, "reserve", "i2"), row(3, "update", "i1", "failed"), row(4, "reserve", "i3"), row(5, "update", "i1", "completed", 9), row(6, "update", "i3", "completed", 4)], LOG)
    assert [r["outcome"] for r in registry.registry_outcomes(log).orderBy("seq").collect()] == ["inserted", "duplicate", "updated", "reset", "rejected", "updated"]
    assert registry.registry_state(log).first()[3:6] == ("i3", "completed", 4)
    plain = log.where("seq in (1, 3, 4, 6)")
    assert registry.latest_state(plain).select("ingestion_id", "status", "indexed_chunks").first() == ("i3", "completed", 4)
    up = spark.createDataFrame([("j", "h", False), ("j", "z", False)], "job_id string, document_hash string, failed boolean")
    checked = registry.duplicates(up, registry.registry_state(log))
    assert registry.upload_report(checked).first() == ("j", 1, 0, 1, 202, None)
    only = registry.upload_report(checked.where("document_hash = 'h'")).first()
    assert (only["status_code"], only["detail"]) == (409, "Dokumen sudah pernah diinput (status: completed, file: f)")
    both = registry.upload_report(checked.where("document_hash = 'h'").unionByName(checked.where("document_hash = 'h'"))).first()
    assert (both["status_code"], both["detail"]) == (409, registry.ALL_DUPLICATES)


def test_event_fold_is_idempotent(spark):
    cols = "seq long, type string, job_id string, filename string, stage string, status string, message string, chunks int, indexed_chunks int, progress_current int, progress_total int, progress_percent double, progress_unit string, native_pages int, ocr_pages int, total_pages int, error string"
    df = spark.createDataFrame([(1, "s", "j", "a", "parsing", "processing", "m", 3, None, None, None, None, None, 2, None, None, None), (2, "s", "j", "a", "parsing", "completed", "m", None, None, None, None, None, None, None, 1, None, None), (3, "s", "j", "-", "x", "failed", "m", *[None] * 10), (4, "job_status", "j", "-", "job", "completed", "m", *[None] * 10)], cols)
    once = events.fold_progress(df).collect()
    assert (once[0]["chunks"], once[0]["native_pages"], once[0]["ocr_pages"], once[0]["status"]) == (None, 2, 1, "completed")
    assert events.fold_progress(df.unionByName(df)).collect() == once
    assert events.job_outcomes(df).first() == ("j", 1, 0, "completed", False)
    lost = events.mark_lost(events.fold_progress(df.where("seq = 1"))).first()
    assert (lost["status"], lost["error"]) == ("failed", events.JOB_LOST)


def test_saved_state(spark):
    df = spark.createDataFrame([('{"files": [{"name": "a"}], "activeJobIds": "x"}',), ("broken",), (None,)], "s string")
    got = [r["x"] for r in df.select(events.load_state(F.col("s")).alias("x")).collect()]
    assert [(len(x["files"]), x["activeJobIds"], x["fileJobIds"]) for x in got] == [(1, [], {}), (0, [], {}), (0, [], {})]


def test_collection_and_jsonl(spark, tmp_path):
    c = sinks.Collection(spark, f"{tmp_path}/points", 2)
    rows = spark.createDataFrame([("c1", "d", "5", "t", [1.0, 0.0], None), ("c2", "d", "6", "u", [0.0, 1.0], None)], "chunk_id string, filename string, pasal string, text string, dense array<double>, bab string")
    assert c.upsert(rows, "i1", "m") == 2
    assert c.upsert(rows.where("chunk_id = 'c1'"), "i1", "m") == 1
    assert c.read().count() == 2
    assert [r["chunk_id"] for r in sinks.Collection(spark, f"{tmp_path}/points", 2).scroll_parent("d", "5").collect()] == ["c1"]
    with pytest.raises(ValueError, match="of another size"):
        c.upsert(rows.withColumn("dense", F.array(F.lit(1.0))), "i1", "m")
    with pytest.raises(ValueError, match="repeated"):
        c.upsert(rows.unionByName(rows), "i1", "m")
    with pytest.raises(ValueError, match="vectors of 2"):
        sinks.Collection(spark, f"{tmp_path}/points", 3)
    sinks.write_jsonl(rows.select("chunk_id", "bab"), f"{tmp_path}/out")
    assert '"bab":null' in spark.read.text(f"{tmp_path}/out").first()[0]


def test_uploads(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two")
    got = uploads.read_uploads(spark, str(tmp_path))
    assert {r["filename"]: r["reason"] for r in got.collect()} == {"a.PDF": None, "b.txt": "not_a_pdf"}
    assert uploads.read_pages(got, lambda content: [(1, 10.0, 10.0, content.decode(), [])]).first()["text"] == "one"
    assert "ZeroDivisionError" in uploads.read_pages(got, lambda content: 1 / 0).first()["error"]


def test_settings():
    assert settings.Settings.of({"RRF_K": " ", "GENERATION_MAX_TOKENS": "5", "API_KEY": " k "}).check_query() == settings.Settings(api_key="k", generation_max_tokens=5)
    for bad in ({"RRF_K": "0"}, {"RRF_K": "x"}):
        with pytest.raises(ValueError):
            settings.Settings.of(bad)
    with pytest.raises(ValueError):
        settings.Settings.of({"API_KEY": "k", "GENERATION_MAX_TOKENS": "40961"}).check_query()
    with pytest.raises(ValueError, match="api_key"):
        settings.Settings().check_scope()


def test_model_connectors(spark):
    rows = spark.createDataFrame([(f"c{i}", "x" * i) for i in range(5)], "chunk_id string, text string")
    got = models.embed_texts(rows, lambda: lambda texts: [([float(len(t))], {1: 0.0, 2: 1.0}) for t in texts], batch=2).orderBy("chunk_id").collect()
    assert [r["dense"] for r in got] == [[float(i)] for i in range(5)]
    assert got[0]["sparse"] == {2: 1.0}
    asked = spark.createDataFrame([(1, "q", "c")], "query_id long, question string, context string")
    assert models.generate_answers(asked, lambda: lambda q, c: q + c).first()["answer"] == "qc"


def test_fifty_passes_hold_one_broadcast_and_give_the_same(spark, monkeypatch):
    from pyspark import Broadcast

    rng = random.Random(3)
    words = [a + b for a in "abcdef" for b in "ghijk"]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], " ".join(rng.choices(words, k=12))) for i in range(800)]
    points = spark.createDataFrame(rows, "id long, dense array<double>, text string")
    queries = points.select(F.col("id").alias("query_id"), "dense")
    terms = vectors.term_vectors(points)
    asked = terms.where("id < 100").withColumnRenamed("id", "query_id")
    rowset = lambda df: sorted(map(tuple, df.collect()))
    one_dense, one_sparse = rowset(vectors.dense_top_k(points, queries, 5)), rowset(vectors.sparse_top_k(terms, asked, 800, 5))
    alive, most = set(), []
    real, destroy = type(spark.sparkContext).broadcast, Broadcast.destroy

    def send(self, value):
        shared = real(self, value)
        alive.add(shared._jbroadcast.id())
        most.append(len(alive))
        return shared

    def drop(self, *args):
        alive.discard(self._jbroadcast.id())
        destroy(self, *args)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", send)
    monkeypatch.setattr(Broadcast, "destroy", drop)
    monkeypatch.setattr(vectors, "PASS_BYTES", 1 << 10)
    assert rowset(vectors.dense_top_k(points, queries, 5)) == one_dense
    assert len(most) == 50 and max(most) == 1 and not alive
    monkeypatch.setattr(vectors, "PASS_BYTES", 5 << 10)
    assert rowset(vectors.sparse_top_k(terms, asked, 800, 5)) == one_sparse
    assert len(most) > 52 and max(most) == 1


@pytest.mark.parametrize("most", [1, 7, 10_000])
def test_listed_terms_in_parts_against_a_plain_loop(monkeypatch, most):
    monkeypatch.setattr(vectors, "_PRODUCTS", most)
    r, n = np.random.default_rng(1), 6
    for _ in range(50):
        sizes = r.integers(0, 4, r.integers(1, 8))
        starts, m = np.concatenate([[0], np.cumsum(sizes)]), r.integers(0, 25)
        of, weight, at, place, tf = r.integers(0, n, starts[-1]), r.random(starts[-1]), np.sort(r.integers(0, 4, m)), r.integers(0, len(sizes), m), r.random(m)
        want = [(a * n + of[k], t * weight[k]) for a, p, t in zip(at, place, tf, strict=True) for k in range(starts[p], starts[p + 1])]
        assert [(i, x) for spot, value in vectors._spread(at, place, tf, starts, of, weight, n) for i, x in zip(spot, value, strict=True)] == want


def test_best_points_against_sorting_all():
    r, best, seen = np.random.default_rng(2), vectors._Best(3), []
    for b in range(40):
        ids, scores, there = pd.Series(r.permutation(30) + 30 * b), np.round(r.random((30, 5)) * 8) - 4, r.random((30, 5)) < 0.7
        best.add(0, ids, scores, there)
        seen += [(q, -scores[i, q], ids[i]) for i in range(30) for q in range(5) if there[i, q]]
    want = [(q, i, -s) for q in range(5) for _, s, i in sorted(x for x in seen if x[0] == q)[:3]]
    assert [(q, i, s) for q, i, s in best.rows().itertuples(index=False)] == want
    # what is below the floor is let go at once
    assert best.held < len(seen) / 2


def test_registry_gives_a_frame_for_a_batch_not_for_a_hash():
    names = ["seq", "op", *(c.split()[0] for c in registry.STATE.split(", "))]
    rows = [(s, "update" if s % 2 else "reserve", f"h{h:03d}", "d", "f.pdf", "i", "completed" if s % 2 else None, 3 if s % 2 else None, None) for h in range(40) for s in range(4)]
    frame = pd.DataFrame(rows, columns=names)
    batches = [frame[a : a + 50] for a in range(0, len(frame), 50)]
    outcomes, states = list(registry._outcome_frames(iter(batches))), list(registry._state_frames(iter(batches)))
    assert len(outcomes) == len(batches) and len(states) == len(batches) + 1
    assert pd.concat(outcomes)["outcome"].tolist() == ["inserted", "updated", "duplicate", "updated"] * 40
    got = pd.concat(states)
    assert got["document_hash"].tolist() == [f"h{h:03d}" for h in range(40)] and set(got["status"]) == {"completed"} and set(got["indexed_chunks"]) == {3}


@pytest.mark.parametrize("signs", [1, -1])
def test_points_out_of_reach_are_not_scored_and_the_best_stay(spark, monkeypatch, signs):
    """Every fortieth point is large; the last queries share no word with those and find theirs among the small ones."""
    r, rows = random.Random(3), []
    for i in range(2000):
        words = r.sample([f"w{k}" if i % 50 else f"v{k}" for k in range(40)], 6)
        rows.append((i, words, [float(r.randint(1, 3) * (30 if i % 40 == 1 else 1) * (signs if k == 0 else 1)) for k in range(6)]))
    terms = spark.createDataFrame(rows, "id long, terms array<string>, tfs array<double>").repartition(3)
    asked = terms.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    held = vectors._Best.add
    monkeypatch.setattr(vectors, "FIRST_POINTS", 10_000)
    whole = sorted(map(tuple, vectors.sparse_top_k(terms, asked, 2000, 5, digits=6).collect()))
    monkeypatch.setattr(vectors, "FIRST_POINTS", 50)
    monkeypatch.setattr(vectors, "_POINT_BLOCK", 25)
    counted = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(vectors, "_Best", type("Counted", (vectors._Best,), {"add": lambda self, first, ids, scores, there=None: (counted.add(scores.size), held(self, first, ids, scores, there))[1]}))
    assert sorted(map(tuple, vectors.sparse_top_k(terms, asked, 2000, 5, digits=6).collect())) == whole and len(whole) == 500
    assert 0 < counted.value < 0.75 * 2000 * 100


@pytest.mark.parametrize("known", [vectors.KNOWN_TERMS, 0])
def test_passes_do_not_read_the_terms_of_all_points_again(spark, monkeypatch, known):
    r = random.Random(6)
    rows = [(i, (own := r.sample([f"w{k}" for k in range(300)], 8)), [float(r.randint(1, 4)) for _ in own]) for i in range(600)]
    terms = spark.createDataFrame(rows, "id long, terms array<string>, tfs array<double>").repartition(3)
    asked = terms.where("id % 6 = 0").withColumnRenamed("id", "query_id")
    # a query of unknown words and one of none have no hits
    asked = asked.union(spark.createDataFrame([(-1, ["nowhere"], [1.0]), (-2, [], [])], asked.schema))
    one = sorted(map(tuple, vectors.sparse_top_k(terms, asked, 600, 5, digits=6).collect()))
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    monkeypatch.setattr(vectors, "PASS_BYTES", 1 << 10)
    monkeypatch.setattr(vectors, "KNOWN_TERMS", known)
    assert sorted(map(tuple, vectors.sparse_top_k(terms.mapInArrow(count, terms.schema), asked, 600, 5, digits=6).collect())) == one
    assert len(one) == 500
    # ten passes and more: the terms are read to be counted and to be numbered, and again only where each pass numbers its own
    assert read.value == 1200 if known else read.value > 6000


def test_words_of_texts_against_a_plain_count(spark):
    texts = ["a b a", None, "", "Ab-ab", "é x\u212a é", "...", " lead trail ", "a1b2\x00c\x0bd\x1ce"] * 150 + ["tail"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    got = {x["id"]: dict(zip(x["terms"], x["tfs"], strict=True)) for x in vectors.term_vectors(df).collect()}
    low = {x["id"]: x["low"] for x in df.select("id", F.lower("text").alias("low")).collect()}
    assert got == {i: dict(Counter(re.findall("[a-z]+", low[i] or ""))) for i in range(len(texts))}


def test_lists_end_with_the_queries_in_reach():
    n, known = 40, pa.table({"term": [f"t{k}" for k in range(60)], "idf": [1.0] * 60})
    got = pa.table({"query_id": list(range(n)), "terms": [[f"t{k}" for k in range(60) if (k * 7 + q) % 29 == 0] for q in range(n)], "tfs": [[1.0] * sum((k * 7 + q) % 29 == 0 for k in range(60)) for q in range(n)]})
    terms = vectors._Terms(got, known).ordered(np.arange(n)[::-1])
    place = np.arange(len(terms.starts) - 1)
    whole = [terms.of[a:b].tolist() for a, b in zip(terms.starts[:-1], terms.starts[1:], strict=True)]
    for first in (0, 1, 13, 30, n):
        step = int(terms.up(np.array([first]))[0])
        assert first <= step <= max(first / 0.85 + 1, terms.steps[0]) and (step == 0) == (first == 0)
        ends = terms.ends(np.full(len(place), step), place)
        assert [terms.of[a:b].tolist() for a, b in zip(terms.starts[:-1], ends, strict=True)] == [[q for q in x if q < step] for x in whole]
    # a point has the products of the queries in its own reach, whatever larger points are scored with it
    few = terms.ends(np.full(len(place), int(terms.up(np.array([8]))[0])), place) - terms.starts[:-1]
    assert sum(map(len, whole)) > 3 * few.sum() > 0


@pytest.mark.parametrize("at_once", [fusion.HITS_AT_ONCE, 5])
def test_word_sets_of_a_text_with_many_hits_do_not_go_with_the_hits(spark, monkeypatch, at_once):
    monkeypatch.setattr(fusion, "HITS_AT_ONCE", at_once)
    r, words = random.Random(4), [a + b for a in "abcdefgh" for b in "ijklmnop"]
    sets = [(i, r.sample(words, 60) if i < 2 else r.sample(words, r.randint(0, 6))) for i in range(90)]
    # texts 0 and 1 are hits of every question; some hits name no text, some questions have no words
    hits = [(q, i, float(p)) for q in range(90) for p, i in enumerate([0, 1, *r.sample(range(2, 95), 3)])]
    df = spark.createDataFrame(sets, "k long, words array<string>")
    rows = fusion.with_words(spark.createDataFrame(hits, "query_id long, id long, position double"), df.select(F.col("k").alias("query_id"), F.col("words").alias("asked")), df.select(F.col("k").alias("id"), F.col("words").alias("own")))
    of = dict(sets)
    assert sorted((x["query_id"], x["id"], x["position"], tuple(x["asked"]), tuple(x["own"])) for x in rows.collect()) == sorted((q, i, p, tuple(of[q]), tuple(of[i])) for q, i, p in hits if i in of)


def test_hits_on_one_text_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(fusion, "HITS_AT_ONCE", 20)
    hits = spark.createDataFrame([(q, 7) for q in range(400)], "query_id long, id long")
    df = spark.createDataFrame([(k, ["a", "b"]) for k in range(400)], "k long, words array<string>")
    asked, own = df.select(F.col("k").alias("query_id"), F.col("words").alias("asked")), df.select(F.col("k").alias("id"), F.col("words").alias("own"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sizes = [x["n"] for x in fusion.with_words(hits, asked, own).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert sum(sizes) == 400 and max(sizes) < 150
