"""The corpus pipeline, stage by stage on the smallest data and on awkward documents."""

import random
from itertools import combinations

import corpus_pipeline as pipeline
from lexloom.llm.common import stored, table
from tests.conftest import SMALL
from tests.llm.helpers import awkward, empty
from tests.llm.test_near_and_shared import plain_hits, plain_print
from tests.llm.test_pii import plain
from tests.llm.test_similar import plain_groups, plain_sets


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    items = [(r[0], r[1]) for r in table(spark, SMALL, "benchmark").collect()]
    outs = []
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), name)
        outs.append(docs)
    cleaned, unique, clean, redacted, packed = outs
    for x in outs[:-1]:
        assert x.columns == list(pipeline.COLUMNS)
        assert x.where("n_chars <> length(text)").count() == 0
    good = table(spark, SMALL, "labels").where("quality = 1").join(table(spark, SMALL, "documents"), "doc_id").where("size(split(text, ' ')) > 80")
    assert good.join(cleaned, "doc_id", "left_anti").count() == 0
    texts = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    prints, sets = {i: plain_print(t) for i, t in texts.items()}, dict(zip(texts, plain_sets(texts.values()), strict=True))
    same = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4 or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    group = plain_groups(texts, [(i, j) for i, j in combinations(texts, 2) if same(i, j)])
    assert {r["doc_id"] for r in unique.collect()} == {i for i in texts if group[i] == i}
    rows = {r["doc_id"]: r["text"] for r in unique.collect()}
    hits = dict(zip(rows, plain_hits(rows.values(), items, 10), strict=True))
    assert {r["doc_id"] for r in clean.collect()} == {i for i, (_, n, _) in hits.items() if not n}
    assert {r["doc_id"] for r in redacted.collect()} == {r["doc_id"] for r in clean.collect()}
    assert all(not plain(r["text"]) for r in redacted.collect())
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in redacted.collect()}


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n=70):
    return " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n)) + "."


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in rows], COLUMNS)


def kept(stage, spark, rows):
    return sorted(((r["doc_id"], r["text"]) for r in stage(spark, frame(spark, rows), SMALL).collect()), key=str)


def test_stages_judge_rows_not_ids(spark):
    r = random.Random(1)
    a, b, c, d = (prose(r) for _ in range(4))
    # repeated rows, a copy without an id, one id with two texts
    rows = [(9, a), (9, a), (None, a), (5, b), (5, c), (None, d), (None, d)]
    assert kept(pipeline.near_dedup_stage, spark, rows) == sorted([(9, a), (5, b), (5, c), (None, d)], key=str)
    held = table(spark, SMALL, "benchmark").where("size(split(text, ' ')) > 12").first()["text"]
    leak = f"{b} {held}"
    rows = [(5, leak), (5, c), (None, leak), (None, d), (7, a), (7, a), (8, leak), (8, leak)]
    assert kept(pipeline.decontamination_stage, spark, rows) == sorted([(5, c), (None, d), (7, a), (7, a)], key=str)
    for stage in (pipeline.quality_stage, pipeline.pii_stage):
        assert kept(stage, spark, [(5, a), (5, b), (None, c), (9, d), (9, d)]) == sorted([(5, a), (5, b), (None, c), (9, d), (9, d)], key=str)
    packed = pipeline.packing_stage(spark, frame(spark, [(5, a), (5, b), (None, c), (9, d), (9, d)]), SMALL).collect()
    assert sorted(str(x["doc_id"]) for x in packed) == ["5", "5", "9", "9", "None"]


def test_awkward_and_empty_documents(spark):
    docs = awkward(spark)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == list(pipeline.COLUMNS)
    assert docs.count() == 0  # short texts, and long ones of one repeated line
    assert pipeline.STAGES[-1][1](spark, docs, SMALL).count() == 0
    docs = frame(spark, [(1, None), (2, prose(random.Random(2)))])
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), name)
    assert [x["doc_id"] for x in docs.collect()] == [2]
    docs = empty(spark)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
