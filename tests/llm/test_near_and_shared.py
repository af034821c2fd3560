"""SimHash, decontamination and repeat removal against brute force."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, simhash, suffix_dedup
from lexloom.llm.components import connected_components
from tests.llm.helpers import awkward, empty


def test_masks_cover_the_radius():
    r, masks = random.Random(1), simhash.masks()
    assert len(masks) == 31
    for _ in range(5000):
        diff = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
        assert any(diff & m == 0 for m in masks)


def plain_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("hot", [simhash.HOT_BUCKET, 1])
def test_fingerprints_and_groups(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    r = random.Random(4)
    base = [" ".join(r.choice("abcdefghijkl") + str(r.randint(0, 99)) for _ in range(r.randint(30, 90))) for _ in range(25)]
    texts = base + [" ".join(w if r.random() > 0.02 else "Zz" for w in r.choice(base).split()) for _ in range(80)] + ["", None, "One", "one", "a b c"]
    df = spark.createDataFrame([(i * 3 + 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in simhash.near_duplicates(df).collect()}
    prints = {i * 3 + 7: plain_print(t) for i, t in enumerate(texts)}
    group = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
        if all(group[a] == group[b] for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4):
            break
    for i, p in prints.items():
        assert got[i]["fingerprint"] == f"{p:016x}"
        assert got[i]["component_id"] == group[i]


def test_large_buckets_are_split_without_loss(monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 8)
    r, mask = random.Random(2), simhash.masks()[5]
    own = [r.getrandbits(64) & mask | r.getrandbits(64) & ~mask & 0xFF for _ in range(1)]
    x = np.array([own[0] ^ sum(1 << b for b in r.sample([i for i in range(64) if not mask >> i & 1], r.randint(0, 9))) for _ in range(200)], np.uint64)
    links = simhash._forest(x, 4, ~mask & (1 << 64) - 1)
    top = list(range(200))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in links:
        assert (int(x[i]) ^ int(x[j])).bit_count() <= 4
        top[max(root(i), root(j))] = min(root(i), root(j))
    assert all(root(i) == root(j) for i in range(200) for j in range(i) if (int(x[i]) ^ int(x[j])).bit_count() <= 4)


def test_key_runs_never_cut_a_key():
    r = random.Random(7)
    for _ in range(100):
        rows = pd.DataFrame({"t": sorted(r.choices(range(4), k=40)), "n": range(40)})
        cuts = sorted(r.sample(range(41), 5))
        got = list(simhash.key_runs((rows.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, 40], strict=True)), ["t"]))
        assert pd.concat(got)["n"].tolist() == list(range(40))
        seen = [set(x["t"]) for x in got]
        assert sum(map(len, seen)) == len(set(rows["t"]))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {(r["node"], r["component"]) for r in connected_components(links).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert connected_components(links.where("false")).count() == 0


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_hits(texts, items, window):
    low = lambda t: re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    known = {}
    for i, t in items:
        w = low(t)
        for s in range(max(1, len(w) - window + 1)) if w else ():
            known.setdefault(tuple(w[s : s + window]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = low(t), set(), set()
        for span, own in known.items():
            for s in range(len(w) - len(span) + 1):
                if tuple(w[s : s + len(span)]) == span:
                    hit.update(range(s, s + len(span)))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("bound", [1000, 0])
def test_contamination_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
    r = random.Random(6)
    word = lambda: r.choice(["alpha", "Beta", "gamma", "DELTA", "É", "é", "x1", "9"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([14, 11, 10, 3, 1, 0, 12])] + [(90, None)]
    texts = []
    for _ in range(60):
        w = [word() for _ in range(r.randint(0, 30))]
        if r.random() < 0.6:
            own = r.choice(items)[1] or ""
            w[len(w) // 2 : len(w) // 2] = own.split()[r.randint(0, 2) :]
        texts.append((", " if r.random() < 0.5 else " ").join(w))
    texts += [None, "", "..."]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, len int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: x for x in decontaminate.find_contamination(docs, bench, broadcast_prints=bound).collect()}
    for i, (n, hit, found) in enumerate(plain_hits(texts, items, 10)):
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"], got[i]["contaminated"]) == (n, hit, found, hit > 0)


def test_contamination_where_lower_case_depends_on_what_stands_around(spark):
    """Letters whose lower case is longer, several letters share or depends on their neighbours, across gaps too."""
    odd = [chr(c) for c in range(0x80, 0x2000) if len(chr(c).lower()) > 1 or len(chr(c).upper()) > 1 or ("a" + chr(c)).lower() != "a" + chr(c).lower() or chr(c).lower() == chr(c).upper().lower() != chr(c).casefold()]
    assert "\u03a3" in odd
    rows, items = [], []
    for i, letter in enumerate([*odd, "\u03c3", "\u03c2", "\u212a"]):
        words = [a + letter + b for a, b in zip("\u0391\u0392\u0393\u0394\u0395\u0396\u0397\u0398\u0399\u039a", ["", "", "b", "", "\u0301", "", "", "x", "", ""], strict=True)]
        items.append((i, " ".join(words)))
        rows += [(i, gap.join(words)) for gap in (" ", ".", "'", ", ", ":", "\n")]
    docs, bench = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_contamination(docs, bench).collect()}
    for n, (i, _) in enumerate(rows):
        assert got[n]["n_hit"] == 10 and str(i) in got[n]["items"]


def test_contamination_of_awkward_documents(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (None, "one"), (2, None)], "item_id long, text string")
    out = decontaminate.find_contamination(awkward(spark), bench)
    assert out.count() == 11
    assert [r["doc_id"] for r in out.where("contaminated").collect()] == [4]
    twice = awkward(spark).unionByName(awkward(spark)).withColumn("doc_id", F.when(F.col("doc_id") != 4, F.col("doc_id")))
    got = decontaminate.find_contamination(twice, bench)
    assert got.count() == 22  # a row for each, null ids and repeated rows too
    assert [(r["doc_id"], r["n_hit"]) for r in got.where("contaminated").collect()] == [(None, 10)] * 2
    two = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (1, "other words")], "doc_id long, text string")
    assert sorted((r["n_words"], r["n_hit"]) for r in decontaminate.find_contamination(two, bench).collect()) == [(2, 0), (10, 10)]
    assert decontaminate.find_contamination(awkward(spark), bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.find_contamination(empty(spark), bench).count() == 0


def plain_removal(texts, length):
    seen, out = set(), []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if t[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(t[p : p + length])
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_prefix_groups_against_brute_force():
    r = random.Random(3)
    for _ in range(150):
        length, letters, contexts = r.choice([3, 5, 12]), r.choice(["ab", "abcd"]), []
        for _ in range(r.randint(1, 9)):
            s = "".join(r.choice(letters) for _ in range(r.randint(length, 30 + length)))
            contexts.append((s + (r.choice(contexts).decode() if contexts and r.random() < 0.5 else "")).encode())
        windows = np.array([r.randint(1, len(c) - length + 1) for c in contexts])
        seen, want = set(), []
        for c, n in zip(contexts, windows, strict=True):
            for d in range(n):
                want.append(c[d : d + length] in seen)
                seen.add(c[d : d + length])
        assert suffix_dedup.repeated_windows(contexts, windows, length).tolist() == want


def test_sets_that_are_too_large_are_dealt_out(monkeypatch):
    r = random.Random(9)
    contexts = [bytes(r.choice(b"ab") for _ in range(40)) for _ in range(60)]
    windows = np.full(60, 11)
    seed, key, at = np.zeros(60, np.uint64), np.arange(60), np.zeros(60, np.int64)
    cover = lambda spans: {(int(k), p) for ks, starts, ns in spans for k, a, n in zip(ks, starts, ns, strict=True) for p in range(a, a + n)}
    whole = cover(suffix_dedup.resolve(seed, key, at, windows, contexts, 30))
    monkeypatch.setattr(suffix_dedup, "MAX_SORTED", 4000)
    assert cover(suffix_dedup.resolve(seed, key, at, windows, contexts, 30)) == whole


@pytest.mark.parametrize("sorted_bytes", [suffix_dedup.SORTED, 0])
def test_rows_that_share_a_seed_alone_are_not_sorted(monkeypatch, sorted_bytes):
    monkeypatch.setattr(suffix_dedup, "SORTED", sorted_bytes)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 4000)
    r, word = random.Random(5), lambda r, n: "".join(r.choice("abcdef ") for _ in range(n))
    # a line of 45 bytes with other text around it each time, and a few copies that are cut or changed somewhere
    line, length = word(r, 45), 100
    texts = [word(r, 150) + line + word(r, 150) for _ in range(300)]
    copies = [t[: (p := r.randint(0, 340))] + r.choice(["", "X"]) + t[p + r.randint(0, 3) :] for t in r.sample(texts, 12)]
    texts = [t.encode() for t in texts + copies]
    seed, key, at, windows, contexts = [], [], [], [], []
    for i, t in enumerate(texts):
        for h, lo, hi in zip(*suffix_dedup.find_seeds(np.frombuffer(t, np.uint8), np.array([len(t)])), strict=True):
            seed, key, at, windows, contexts = [*seed, h], [*key, i], [*at, lo], [*windows, hi - lo + 1], [*contexts, t[lo : hi + length]]
    rows = [np.array(seed, np.uint64), *(np.array(x, np.int64) for x in (key, at, windows)), contexts]
    met = np.flatnonzero(np.isin(rows[0], [h for h, n in zip(*np.unique(rows[0], return_counts=True), strict=True) if n > 1]))
    rows = [*(x[met] for x in rows[:4]), [contexts[i] for i in met]]
    cover = lambda spans: {(int(k), p) for ks, starts, ns in spans for k, a, n in zip(ks, starts, ns, strict=True) for p in range(a, a + n)}
    gone, rest = suffix_dedup.narrowed(*rows)
    assert cover([gone, *suffix_dedup.resolve(*rest)]) == cover(suffix_dedup.resolve(*rows))
    assert cover([gone, *suffix_dedup.resolve(*rest)])
    assert sum(map(len, rest[4])) * 4 < sum(map(len, rows[4]))


@pytest.mark.parametrize("hot_rows", [100_000, 3, 0])
def test_removal_against_brute_force(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot_rows)
    r = random.Random(8)
    pool = ["".join(r.choice("abc dé") for _ in range(r.randint(5, 90))) for _ in range(12)]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 6))) for _ in range(50)] + ["", "é" * 200, "é" * 200]
    df = spark.createDataFrame([(i * 2, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, key int").repartition(5)
    got = {x["doc_id"]: x for x in suffix_dedup.remove_repeats(df, length=30).collect()}
    for i, want in enumerate(plain_removal([t.encode() for t in texts], 30)):
        x = got[i * 2]
        assert (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) == want


def test_a_line_in_every_document_makes_no_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 50)
    monkeypatch.setattr(suffix_dedup, "HELD_ROWS", 500)
    r, line = random.Random(3), "".join(random.Random(9).choice("abcdefgh ") for _ in range(300))
    texts = ["".join(r.choice("ijklmn") for _ in range(120)) + line + "".join(r.choice("opqrst") for _ in range(120)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    sizes = []

    def open_rows(rows):
        found = seen(rows)
        sizes.append((found, rows.groupBy("bucket").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]))
        return found

    seen = suffix_dedup._hot_seeds
    monkeypatch.setattr(suffix_dedup, "_hot_seeds", open_rows)
    got = {x["doc_id"]: x for x in suffix_dedup.remove_repeats(df).collect()}
    for i, want in enumerate(plain_removal([t.encode() for t in texts], 100)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want
    # the line's inner windows are merged in the tasks; those at its edges differ everywhere, and their seeds are found hot
    assert len(sizes[0][0]) > 0


def test_removal_of_awkward_documents(spark):
    out = suffix_dedup.remove_repeats(awkward(spark), keep_text=True)
    assert out.count() == 11  # rows that repeat an id are documents of their own
    assert {r["n_removed"] for r in out.where("doc_id = 5").collect()} == {176, 192}
    assert out.where("doc_id = 7").first()["n_removed"] > 150_000
    assert bytes(out.where("doc_id = 3").first()["kept"]) == b"one"
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    null_id = awkward(spark).withColumn("doc_id", F.when(F.col("doc_id") < 8, F.col("doc_id")))
    assert suffix_dedup.remove_repeats(null_id).where("doc_id is null").count() == 1


def test_near_duplicates_of_awkward_documents(spark):
    out = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(awkward(spark)).collect()}
    assert {(0, "0" * 16, 0), (1, "0" * 16, 0), (2, "0" * 16, 0)} <= out
    assert {c for d, _, c in out if d in (5, 6)} == {5}
    assert simhash.near_duplicates(empty(spark)).count() == 0
    null_id = awkward(spark).withColumn("doc_id", F.when(F.col("doc_id") != 5, F.col("doc_id")))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(null_id).collect())
    assert got[:2] == [(-1, 6), (-1, 6)]  # it has no id of its own to give
