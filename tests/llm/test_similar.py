"""Near copies by the similarity of their shingle sets, against brute force."""

import random
from itertools import combinations

import corpus_pipeline as pipeline
from lexloom.llm import simhash, similar
from lexloom.llm.components import connected_components
from tests.conftest import SMALL
from tests.llm.helpers import awkward, empty


def plain_sets(texts):
    words = [(t or "").lower().split() for t in texts]
    return [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def plain_groups(ids, near):
    group = {i: i for i in ids}
    for _ in group:
        for a, b in near:
            group[a] = group[b] = min(group[a], group[b])
    return group


def copies(seed, n_base=20, n_copies=100):
    r = random.Random(seed)
    base = [[r.choice("abcdefghijkl") + str(r.randint(0, 99)) for _ in range(r.randint(60, 200))] for _ in range(n_base)]
    out = [" ".join(b) for b in base]
    for _ in range(n_copies):
        words = list(r.choice(base))
        for _ in range(r.randint(0, len(words) // 25)):
            words[r.randrange(len(words))] = "Zz" + str(r.randint(0, 9))
        out.append(" ".join(words))
    r.shuffle(out)
    return [*out, "", None, "One", "one", "a b c", " \n"]


def similar_pairs(texts):
    sets = plain_sets(texts)
    return [(i, j) for i, j in combinations(range(len(sets)), 2) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def test_links_join_what_is_similar(spark):
    texts = copies(1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = similar_pairs(texts)
    want = {i: g for i, g in plain_groups(range(len(texts)), near).items() if any(i in p for p in near)}
    for block in (similar.BLOCK, 300):  # the small one cuts every group into several blocks
        links = similar.similar_links(df, block=block)
        assert {x["node"]: x["component"] for x in connected_components(links).collect()} == want
    for odd in (awkward(spark), empty(spark)):
        assert similar.similar_links(odd).where("a is null or b is null").count() == 0


def test_stage_keeps_one_of_each_group(spark):
    texts = copies(2)
    ids = range(len(texts))
    prints = [simhash.fingerprint(t) for t in texts]
    far = [(i, j) for i, j in similar_pairs(texts) if (prints[i] ^ prints[j]).bit_count() > simhash.RADIUS]
    assert far
    group = plain_groups(ids, similar_pairs(texts) + [(i, j) for i, j in combinations(ids, 2) if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS])
    docs = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x["doc_id"] for x in pipeline.near_dedup_stage(spark, docs, SMALL).collect()}
    assert kept == {i for i in ids if group[i] == i}
