"""Centroid clustering by weighted deduplication, exact to the last bit.

Vectors are turned into integers and equal ones are grouped, so Lloyd's rounds see each distinct vector once, with the
number of its copies as weight. A round assigns in the tasks that hold the distinct vectors; what leaves a task is one
count and one weighted integer sum for each centroid and component, whatever it has read, and the sums are added up by Spark.
Only the centroids (k times dims integers) are on the driver. At the end the assignments are joined back to the rows by
the integer vector; vectors with more than one in HOT_SHARE of all rows, at most HOT_SHARE of them, are broadcast, so no
key of the shuffled join has more rows than that share.

Products and distances are computed in doubles where they are exact there (below 2**53), otherwise in 64-bit integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import drop_stored, stored

#: A vector with more than one in so many of all rows is joined by broadcast; there are at most so many of them.
HOT_SHARE = 10_000
#: Integers of all centroids together, which the driver and each task hold.
MOST_CENTROID_CELLS = 1 << 22
#: Distances that a task holds at a time.
_CELLS = 1 << 22


def _pack(q: np.ndarray) -> list[bytes]:
    """Each row as little-endian integers: of 16 bits where all of the row fit, otherwise of 32."""
    short, narrow, wide = (np.abs(q) < 1 << 15).all(axis=1), q.astype("<i2"), q.astype("<i4")
    return [narrow[i].tobytes() if s else wide[i].tobytes() for i, s in enumerate(short)]


def _unpack(column: pa.Array, dims: int) -> np.ndarray:
    out = np.empty((len(column), dims), np.int64)
    for i, raw in enumerate(column.to_pylist()):
        out[i] = np.frombuffer(raw, "<i2" if len(raw) == 2 * dims else "<i4")
    return out


def largest_component(dims: int) -> int:
    """Integers beyond this are taken as this, so that no squared distance exceeds 64 bits."""
    return math.isqrt((1 << 62) // dims) // 2


def _columns(batch: pa.RecordBatch, dims: int, scale: int) -> np.ndarray:
    flat = np.asarray(batch.column("x").flatten(), np.float64).reshape(-1, dims)
    most = largest_component(dims)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * scale), -most, most).astype(np.int64)


def _keyed(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """(id, x) to (id, q), q the packed integer vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_pack(_columns(batch, dims, scale)), pa.binary())], ["id", "q"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, q binary")


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller one of equals) and the squared distance, both exact."""
    most = max(int(np.abs(q).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    exact = np.float64 if 4 * most * most * q.shape[1] < 1 << 53 else np.int64
    c = centroids.astype(exact)
    own, place, distance = (c * c).sum(axis=1), np.empty(len(q), np.int64), np.empty(len(q), np.int64)
    step = max(1, _CELLS // max(len(c), q.shape[1]))
    for a in range(0, len(q), step):
        part = q[a : a + step].astype(exact)
        far = own - 2 * (part @ c.T)
        best = far.argmin(axis=1)
        place[a : a + step] = best
        distance[a : a + step] = ((part - c[best]) ** 2).sum(axis=1).astype(np.int64)
    return place, distance


def _add(totals: dict[int, list[int]], counts: dict[int, int], q: np.ndarray, n: np.ndarray, place: np.ndarray) -> None:
    order = np.argsort(place, kind="stable")
    q, n, place = q[order], n[order], place[order]
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    small = int(np.abs(q).max(initial=0)) * int(n.max(initial=0)) * len(q) < 1 << 62
    weighted = q * n[:, None] if small else q.astype(object) * n.astype(object)[:, None]
    sums, rows = np.add.reduceat(weighted, starts, axis=0), np.add.reduceat(n, starts)
    for k, s, r in zip(place[starts].tolist(), sums.tolist(), rows.tolist(), strict=True):
        totals[k] = [a + b for a, b in zip(totals[k], s, strict=True)] if k in totals else s
        counts[k] = counts.get(k, 0) + r


def _sums(distinct: DataFrame, centroids: np.ndarray, dims: int) -> dict[int, tuple[int, list[int]]]:
    """For each centroid that has vectors: their number and componentwise sums, copies counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            q = _unpack(batch.column("q"), dims)
            if len(q):
                _add(totals, counts, q, np.asarray(batch.column("n"), np.int64), nearest(q, centroids)[0])
        for k, sums in totals.items():
            all_sums = [counts[k], *sums]
            yield pa.RecordBatch.from_arrays([pa.array([k] * (dims + 1), pa.int32()), pa.array(range(-1, dims), pa.int32()), pa.array([Decimal(s) for s in all_sums], pa.decimal128(38, 0))], ["cluster", "at", "total"])

    parts = distinct.mapInArrow(run, "cluster int, at int, total decimal(38,0)").groupBy("cluster", "at").agg(F.sum("total").alias("total"))
    out: dict[int, tuple[int, list[int]]] = {}
    for k, at, total in parts.collect():  # k * (dims + 1) rows
        n, sums = out.get(k, (0, [0] * dims))
        if at < 0:
            n = int(total)
        else:
            sums[at] = int(total)
        out[k] = n, sums
    return out


def _assign(distinct: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, distance = nearest(_unpack(batch.column("q"), dims), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("n"), pa.array(place, pa.int32()), pa.array(distance, pa.int64())], ["q", "n", "cluster", "distance"])

    return distinct.mapInArrow(run, "q binary, n long, cluster int, distance long")


def usable(x: Column, dims: int) -> Column:
    """Whether a vector has exactly `dims` components, none null or non-finite."""
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return F.coalesce((F.size(x) == dims) & fine, F.lit(False))


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, dims: int = 64, rounds: int = 5, scale: int = 256, salt: str = "2:", hot_share: int = HOT_SHARE) -> DataFrame:
    """One row for each vector that is `usable`: its id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Each component x becomes floor(scale * x). The first centroids are the k kept vectors whose sha256 of salt and id is
    smallest; fewer vectors make fewer centroids. Each of `rounds` rounds assigns every vector to the nearest centroid (of
    equals the smaller number) and replaces each centroid that has vectors by the floor of their mean; then vectors are
    assigned once more. distance is squared; the inertias are its sums over the cluster and over all rows, null where
    they exceed 64 bits. centroid_sha256 is of the final centroid's integers, joined by commas.

    Rows that are not usable are left out, as are all rows of an empty table. Ids that repeat stay apart: each row counts.
    A row without an id is clustered, but starts no centroid. Repeated vectors are copies, each with a row of its own.
    Integers beyond `largest_component` (2**27 for 64 dimensions) are taken as that. Further columns are left out.
    """
    if k < 1 or rounds < 0 or dims < 1 or k * dims > MOST_CENTROID_CELLS:
        raise ValueError(f"k and dims from 1 on, k * dims at most {MOST_CENTROID_CELLS}, rounds from 0 on")
    spark = vectors.sparkSession
    x = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), x.alias("x")).where(usable(F.col("x"), dims))
    keyed = _keyed(rows, dims, scale)
    rank = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = _keyed(rows.where("id IS NOT NULL").orderBy(rank, "x").limit(k), dims, scale).select("id", "q").collect()
    chosen = sorted(first, key=lambda r: hashlib.sha256(f"{salt}{r['id']}".encode()).hexdigest())
    centroids = _unpack(pa.array([bytes(r["q"]) for r in chosen], pa.binary()), dims)
    out = f"{id_col} {rows.schema['id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], out)

    distinct = stored(keyed.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "distinct-vectors")
    for _ in range(rounds):
        for i, (n, sums) in _sums(distinct, centroids, dims).items():
            centroids[i] = [s // n for s in sums]
    assigned = stored(_assign(distinct, centroids, dims), "assigned-vectors")
    drop_stored(distinct)

    inertia = F.col("n").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")
    per = assigned.groupBy("cluster").agg(F.sum(inertia).alias("inertia"), F.sum("n").alias("n")).collect()  # k rows
    total, weight = sum(int(r["inertia"]) for r in per), sum(r["n"] for r in per)
    long = lambda v: v if v < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    facts = [(r["cluster"], long(int(r["inertia"])), long(total), digest(centroids[r["cluster"]].tolist())) for r in per]
    clusters = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")

    often = F.col("n") > weight // hot_share
    hot, cold = assigned.where(often).drop("n"), assigned.where(~often).drop("n")
    joined = keyed.join(F.broadcast(hot), "q").unionByName(keyed.join(F.broadcast(hot.select("q")), "q", "left_anti").join(cold, "q"))
    return joined.join(F.broadcast(clusters), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
