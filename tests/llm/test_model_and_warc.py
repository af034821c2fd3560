"""The quality model's held-out accuracy; WARC packages against zipfile and plain groups."""

import base64
import hashlib
import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import quality_model, warc_zip
from lexloom.llm.common import table
from tests.llm.helpers import awkward, empty


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    out = quality_model.score(docs, quality_model.train(docs, labels)).join(labels, "doc_id").where("held_out")
    n, right = out.agg(F.count(F.lit(1)), F.count_if(F.col("predicted") == F.col("quality"))).first()
    assert n > 50
    assert right / n >= 0.95


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.AdditiveModel().fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert {tuple(sorted(p[:2])) for p in model.pairs} >= {(0, 1)}


@pytest.mark.parametrize("condition", ["false", "quality is null", "quality = 1"])
def test_models_without_enough_labels(spark, condition):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (5, 0, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    out = quality_model.score(awkward(spark), quality_model.train(awkward(spark), labels.where(condition)))
    assert out.count() == 11
    assert out.where("score between 0 and 1").count() == 11


def test_scoring_awkward_documents(spark):
    assert quality_model.score(empty(spark), quality_model.AdditiveModel()).count() == 0
    assert quality_model.score(awkward(spark).withColumn("doc_id", F.lit(None).cast("long")), quality_model.AdditiveModel()).where("not held_out").count() == 11


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_packages(zip64):
    data = b"".join(warc_zip.zip_bytes([("archive/a", [b"12", b"3"]), ("indexes/é", [b""])], zip64=zip64))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None
        assert z.read("archive/a") == b"123"
    reads = []

    def read(at, n):
        reads.append(n)
        return data[at : at + n]

    p = warc_zip.ZipPackage(read, len(data))
    assert p.member("archive/a") == b"123"
    assert p.member("indexes/é") == b""
    broken = data.replace(b"123", b"124")
    with pytest.raises(ValueError, match="damaged"):
        warc_zip.ZipPackage(lambda at, n: broken[at : at + n], len(broken)).member("archive/a")
    with pytest.raises(ValueError):
        warc_zip.ZipPackage(lambda at, n: b"nothing"[at : at + n], 7)


def test_zip_with_a_comment_and_deflated_members():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", b"x" * 9)
        z.comment = b"PK\5\6 a comment"
    data = raw.getvalue()
    assert warc_zip.ZipPackage(lambda at, n: data[at : at + n], len(data)).member("a") == b"x" * 9
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 99)
        z.writestr(zipfile.ZipInfo("b"), b"y" * 9, zipfile.ZIP_STORED)
    data = raw.getvalue()
    package = warc_zip.ZipPackage(lambda at, n: data[at : at + n], len(data))
    assert package.member("b") == b"y" * 9  # only members that are read must be stored
    with pytest.raises(ValueError, match="not stored"):
        package.member("a")


PAGES = "page_id long, url string, html string, sha string, n int, page string, refers_to string"


def test_records_round_trip(spark):
    html = [None, "", "same", "same", "same", "unique", "é日本\r\n\r\nx", "same "]
    rows = [(i, None if i == 5 else f"http://x/{i} é", h, "s", 1, "p", "r") for i, h in enumerate(html)]
    df = spark.createDataFrame(rows, PAGES)
    got = {r["page_id"]: r for r in warc_zip.read_packages(warc_zip.write_packages(df)).collect()}
    payloads = [(h or "").encode() for h in html]
    for i, p in enumerate(payloads):
        last = max(k for k, q in enumerate(payloads) if q == p)
        want = (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if last == i else "revisit", None if last == i else last)
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == want
    kept = {r["page_id"]: r["record_type"] for r in warc_zip.read_packages(warc_zip.write_packages(df, min_payload=4)).collect()}
    assert [kept[i] for i in (0, 1, 2, 3, 4)] == ["response", "response", "revisit", "revisit", "response"]
    null_id = df.withColumn("page_id", F.when(F.col("page_id") > 3, F.col("page_id")))
    assert warc_zip.read_packages(warc_zip.write_packages(null_id)).where("page_id is null and record_type = 'response'").count() == 4
    assert warc_zip.read_packages(warc_zip.write_packages(df.unionByName(df))).count() == 16
    assert warc_zip.read_packages(warc_zip.write_packages(df.where("false"))).count() == 0


@pytest.mark.parametrize("bound", [100_000, 1])
def test_records_of_ids_that_repeat(spark, monkeypatch, bound):
    monkeypatch.setattr(warc_zip, "BROADCAST_GROUPS", bound)
    rows = [(1, "A"), (1, "B"), (2, "A"), (3, "B"), (None, "A"), (None, "B"), (4, "C"), (4, "C"), (5, ""), (6, None), (7, "D")]
    df = spark.createDataFrame([(i, "http://x/", h) for i, h in rows], "page_id long, url string, html string")
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    refers = {(1, "A"): 2, (1, "B"): 3, (5, ""): 6}
    want = sorted(((i, len(h or ""), digest(h), "revisit" if (i, h) in refers else "response", refers.get((i, h))) for i, h in rows), key=str)
    got = warc_zip.read_packages(warc_zip.write_packages(df)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_long_records_in_small_packages(spark, monkeypatch):
    monkeypatch.setattr(warc_zip, "PACKAGE_BYTES", 3000)
    monkeypatch.setattr(warc_zip, "READ_BYTES", 1000)
    html = ["".join(chr(97 + (i * k * k) % 26) for k in range(300)) for i in range(40)] + ["é" * 3_000_000]
    df = spark.createDataFrame([(i, "http://x/", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    packages = warc_zip.write_packages(df)
    assert packages.count() > 1
    got = {r["page_id"]: r["payload_digest"] for r in warc_zip.read_packages(packages).collect()}
    assert got == {i: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for i, h in enumerate(html)}


def plain_features(text):
    """features, counted sign by sign and word by word."""
    raw = (text or "").encode()
    words, n = raw.split(), max(len(raw), 1)
    w, count = max(len(words), 1), lambda signs: sum(b in signs for b in raw)
    distinct, long = set(words), [x for x in words if len(x) > 9]
    return [
        math.log2(1 + len(words)), count(bytes(range(65, 91))) / n, count(b"0123456789") / n, count(b"#$%&*<>=@^_~\\/{}[]+") / w, count(b"|") / w, count(b"!") / w, count(b".?") / w, count(b",") / w, count(bytes(range(128, 256))) / n,
        count(b"\n") / w, sum(map(len, words)) / w, len(long) / w, len(distinct) / w, sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / w, math.log2(w / max(len(distinct), 1)),
    ]


def test_scores_against_tables_row_by_row(spark):
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    model = quality_model.train(docs, table(spark, folder, "labels"))
    below = lambda cuts, v: sum(c < v for c in cuts)
    for r in quality_model.score(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        x = plain_features(r["text"])
        assert np.allclose(x, quality_model.features(r["text"]))
        z = model.intercept + sum(t[below(c, v)] for t, c, v in zip(model.tables, model.cuts, x, strict=True))
        z += sum(t[below(cf, x[f]), below(cg, x[g])] for f, g, cf, cg, t in model.pairs)
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
        assert r["predicted"] == int(r["score"] >= 0.7)


def plain_tree(values, g, h):
    """Newton steps of the best tree of two cuts grown greedily, over sorted bins."""
    gain = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + quality_model.L2)
    edges = [0, values]
    for _ in range(2):
        found = [(gain(a, k) + gain(k, b) - gain(a, b), k) for a, b in zip(edges, edges[1:], strict=False) for k in range(a + 1, b)]
        best = max(found, default=(0, 0))
        if best[0] <= 1e-9:
            break
        edges = sorted([*edges, best[1]])
    return [sum(g[a:b]) / (sum(h[a:b]) + quality_model.L2) for a, b in zip(edges, edges[1:], strict=False) for _ in range(a, b)]


def test_one_round_by_hand(monkeypatch):
    monkeypatch.setattr(quality_model, "ROUNDS", 1)
    monkeypatch.setattr(quality_model, "PAIR_ROUNDS", 0)
    r = np.random.default_rng(4)
    x = r.integers(0, 6, (200, 2)).astype(float)
    y = (x[:, 0] + r.random(200) * 3 > 4).astype(float)
    model = quality_model.AdditiveModel().fit(x, y)
    z = [math.log((y.sum() + 0.5) / (200.5 - y.sum()))] * 200
    for f in range(2):
        bins = [sum(c < v for c in model.cuts[f]) for v in x[:, f]]
        p = [1 / (1 + math.exp(-v)) for v in z]
        g, h = ([sum(v for v, b in zip(values, bins, strict=True) if b == k) for k in range(len(model.cuts[f]) + 1)] for values in ([a - b for a, b in zip(y, p, strict=True)], [a * (1 - a) for a in p]))
        steps = plain_tree(len(g), g, h)
        assert np.allclose(model.tables[f], quality_model.RATE * np.array(steps))
        z = [v + quality_model.RATE * steps[b] for v, b in zip(z, bins, strict=True)]


def test_training_is_bounded_and_ignores_clashing_columns(spark):
    labels = spark.createDataFrame([(i, i % 2, "t", i) for i in range(60)], "doc_id long, quality int, text string, id long")
    docs = spark.createDataFrame([(i % 60, f"word{i % 7} " * (i % 2 * 20 + 1), 1, "y") for i in range(180)], "doc_id long, text string, quality int, id string")
    seen = []
    fit = quality_model.AdditiveModel.fit
    model = quality_model.train(docs, labels, rows=10)
    quality_model.AdditiveModel.fit = lambda self, x, y: seen.append(len(y)) or fit(self, x, y)
    try:
        quality_model.train(docs, labels, rows=10)
    finally:
        quality_model.AdditiveModel.fit = fit
    assert seen == [10]  # each id once, however often it is repeated
    assert quality_model.score(docs, model).count() == 180
