"""Centroid clustering against a plain version with Python's integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from lexloom.llm import centroids

KIND = "vec_id long, embedding array<double>, q string, cluster int, n int"


def _plain(rows, k, dims, rounds, scale=256, salt="2:"):
    most = centroids.largest_component(dims)
    kept = [(r[0], [max(-most, min(most, math.floor(scale * x))) if abs(x) < 1e300 else (most if x > 0 else -most) for x in r[1]]) for r in rows if r[1] is not None and len(r[1]) == dims and all(x is not None and math.isfinite(x) for x in r[1])]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    first = sorted((digest(f"{salt}{i}"), q) for i, q in kept if i is not None)[:k]
    cs = [q for _, q in first]
    if not cs:
        return []
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c, strict=True))
    near = lambda q: min((far(q, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        place = [near(q)[1] for _, q in kept]
        cs = [[sum(q[d] for (_, q), p in zip(kept, place, strict=True) if p == j) // place.count(j) for d in range(dims)] if j in place else c for j, c in enumerate(cs)]
    last = [near(q) for _, q in kept]
    own = lambda j: sum(d for d, p in last if p == j)
    return sorted(((i if i is not None else -1), j, d, own(j), sum(d for d, _ in last), digest(",".join(map(str, cs[j])))) for (i, _), (d, j) in zip(kept, last, strict=True))


def _got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "extra", 7, 9) for r in rows], KIND)
    return sorted(((r[0] if r[0] is not None else -1), *r[1:]) for r in centroids.cluster(df, **more).collect())


@pytest.mark.parametrize("hot_share", [10_000, 3, 1])
def test_equals_plain_version(spark, hot_share):
    rng = random.Random(hot_share)
    base = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(12)]
    rows = [(i, rng.choice(base)) for i in range(60)]
    rows += [(100 + i, base[0]) for i in range(40)]  # a vector that a large share has
    rows += [(7, base[3]), (7, base[4]), (None, base[5]), (None, [0.5, 0.5, 0.5, 0.5])]  # repeated and missing ids
    rows += [(200, None), (201, []), (202, [1.0, 2.0, 3.0]), (203, [1.0] * 5), (204, [1.0, None, 1.0, 1.0]), (205, [float("nan"), 1.0, 1.0, 1.0]), (206, [float("inf"), 0.0, 0.0, 0.0])]
    for k, rounds in ((5, 3), (1, 1), (8, 0)):
        assert _got(spark, rows, k=k, dims=4, rounds=rounds, hot_share=hot_share) == _plain(rows, k, 4, rounds)


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(10)]  # more centroids than distinct vectors
    got = _got(spark, rows, k=6, dims=2, rounds=4)
    assert got == _plain(rows, 6, 2, 4)
    assert len({r[1] for r in got}) == 2


def test_few_none_and_huge_vectors(spark):
    assert _got(spark, [], k=3, dims=2) == []
    assert _got(spark, [(1, None), (2, [1.0])], k=3, dims=2) == []
    rows = [(1, [1e308, -1e308]), (2, [3.0, 4.0]), (3, [-1e9, 1e9]), (4, [1e200, 0.0])]
    assert _got(spark, rows, k=40, dims=2, rounds=2) == _plain(rows, 40, 2, 2)
    with pytest.raises(ValueError):
        centroids.cluster(spark.createDataFrame([], KIND), k=0)


def test_distances_are_exact_in_either_arithmetic():
    rng = np.random.default_rng(4)
    for most in (200, 1 << 22, 1 << 27):
        q, c = rng.integers(-most, most + 1, (30, 64)), rng.integers(-most, most + 1, (7, 64))
        c[5] = c[2]
        place, distance = centroids.nearest(q, c)
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c)) for x in q]
        assert [(int(d), int(p)) for d, p in zip(distance, place, strict=True)] == want


def test_weights_beyond_64_bits():
    totals, counts = {}, {}
    q = np.array([[1 << 27, -(1 << 27)], [5, 7]], np.int64)
    centroids._add(totals, counts, q, np.array([1 << 40, 3], np.int64), np.array([1, 1]))
    assert totals == {1: [(1 << 67) + 15, -(1 << 67) + 21]} and counts == {1: (1 << 40) + 3}


def test_packed_vectors_round_trip():
    import pyarrow as pa

    q = np.array([[1, -2, 3], [1 << 20, 0, -(1 << 27)], [-32767, 32767, 0]], np.int64)
    packed = centroids._pack(q)
    assert [len(p) for p in packed] == [6, 12, 6]
    assert (centroids._unpack(pa.array(packed, pa.binary()), 3) == q).all()
