"""Links between documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

A SimHash of 64 bits cannot find these: such pairs differ in 10 bits on average and in 17 at times, too many for covering
tables. Here MinHash only proposes groups; what counts is the similarity of the sets themselves.

Documents of equal sets are merged first. BANDS keys of ROWS minima propose pairs: one of similarity 0.8 shares no key
with a probability of (1 - 0.8^5)^40 = 1.3e-7, more similar ones with less. Documents joined by chains of shared keys make
a group. All sets of a group are compared, each with those not yet reached, and only the links of a spanning forest are
emitted, never all pairs. In a group of more than BLOCK shingles all are compared with one leader first; what is similar to
it is connected. The others are cut into blocks, which meet the blocks of the whole group two by two, so no task grows with
the group, and a group of near copies of one text is done in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import attach, release, stored, whole
from lexloom.llm.components import connected_components
from lexloom.llm.simhash import key_runs

SHINGLE = 5
#: The similarity, PART / WHOLE.
PART, WHOLE = 4, 5
BANDS, ROWS = 40, 5
BLOCK = 500_000
#: Members of groups that are broadcast at most (28 bytes each); more are joined by shuffling.
BROADCAST_IDS = 500_000
#: Leaders of large groups whose sets are broadcast at most (some kilobytes each).
BROADCAST_LEADERS = 2_000
#: Rows that a Python worker turns into keys or sets at once.
SLICE = 1000
_TIMES, _PLUS = np.random.default_rng(5).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32)
_TIMES |= np.uint32(1)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles, words as in `simhash.fingerprint`; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([h(line, 42)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - n + 1].tolist()
    return np.unique(np.fromiter((h(line[a:b], 42) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def band_keys(own: np.ndarray) -> list[int]:
    """A key for each band, equal for two sets if their ROWS minima in the band are."""
    x, least = (own >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(least, (x[k : k + 4096] * _TIMES + _PLUS).min(axis=1), out=least)
    raw, size = least.astype("<u4").tobytes(), 4 * ROWS
    return [xxhash.xxh64_intdigest(raw[k * size : (k + 1) * size], k) for k in range(BANDS)]


def _forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Indices (i, j) of links that connect all sets that are connected by similarities of PART / WHOLE or more."""
    n, size = len(sets), np.array([len(s) for s in sets])
    if n == 2:
        return [(0, 1)] if len(np.intersect1d(*sets, True)) * (PART + WHOLE) >= PART * size.sum() else []
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(at, kind="stable")
    holders, count = np.repeat(np.arange(n), size)[order], np.bincount(at)
    first, begin = np.cumsum(count) - count, np.cumsum(size) - size
    out, rest = [], np.arange(n)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            mine = at[begin[i] : begin[i] + size[i]]
            length = count[mine]
            places = np.repeat(first[mine] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            common = np.bincount(holders[places], minlength=n)[rest]
            near = common * (PART + WHOLE) >= PART * (size[i] + size[rest])
            if near.any():
                found = rest[near].tolist()
                out += [(i, j) for j in found]
                queue += found
                rest = rest[~near]
    return out


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), SLICE):
            yield batch.iloc[k : k + SLICE]


def _led(members: DataFrame) -> DataFrame:
    """Members (id, own, component, blocks, set) of large groups with lead_id and whether they are similar to their group's leader, the member of the least own."""
    leaders = stored(members.where("own = component").groupBy("component").agg(F.min("id").alias("lead_id"), F.min_by("set", "id").alias("lead")), "leaders")
    kind = "id long, own long, component long, blocks int, set binary, lead_id long, reached boolean"

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            reached = []
            for own, lead in zip(batch["set"], batch["lead"], strict=True):
                x, y = np.frombuffer(own, np.uint64), np.frombuffer(lead, np.uint64)
                reached.append(len(np.intersect1d(x, y, True)) * (PART + WHOLE) >= PART * (len(x) + len(y)))
            yield batch.drop(columns="lead").assign(reached=reached)
        release()

    return stored(attach(members, leaders, ["component"], "inner", bound=BROADCAST_LEADERS).select("id", "own", "component", "blocks", "set", "lead_id", "lead").mapInPandas(compare, kind), "led")


def _left(led: DataFrame, block: int) -> DataFrame:
    """(component, i, j, id, set): what is still to be compared in large groups.

    Members similar to the leader are connected already and need not meet each other. Each block of the others meets each
    block of all: in a group of near copies of one text that is little or nothing.
    """
    others = led.where("not reached").groupBy("component").agg(F.ceil(F.sum(F.octet_length("set")) / (8 * block)).cast("int").alias("b"))
    rows = attach(led, stored(others, "others"), ["component"], "inner")
    part = lambda n: F.pmod(F.xxhash64("own"), n).cast("int")
    first = rows.where("not reached").select("component", part(F.col("b")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "id", "set")
    second = rows.select("component", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("i"), part(F.col("blocks")).alias("j"), "id", "set")
    return first.unionByName(second)


def similar_links(documents: DataFrame, *, shingle: int = SHINGLE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): ids of documents, links that join all whose shingle sets are PART / WHOLE similar, by chains too.

    Ids are longs; rows with a null id and texts without words have no links. An id that repeats stands for all its texts.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            rows = [(i, xxhash.xxh64_intdigest(s.tobytes()), len(s), band_keys(s)) for i, t in zip(batch["id"], batch["text"], strict=True) if len(s := shingles(t, shingle))]
            keys = np.array([r[3] for r in rows], np.uint64).reshape(-1, BANDS).view(np.int64)
            yield pd.DataFrame({"id": [r[0] for r in rows], "own": np.array([r[1] for r in rows], np.uint64).view(np.int64), "n": [r[2] for r in rows], "keys": pd.Series(list(keys), dtype=object)})
        release()

    docs = documents.select(F.col(id_col).cast("long").alias("id"), whole(documents[text_col]).alias("text")).where("id is not null")
    sketches = stored(docs.mapInPandas(sketch, "id long, own long, n long, keys array<long>"), "sketches")
    nodes = sketches.groupBy("own", "n").agg(F.min("id").alias("node"), F.min_by("keys", "id").alias("keys"))
    nodes = stored(nodes, "sets")
    by_key = nodes.select("own", F.explode("keys").alias("key"))
    shared = by_key.groupBy("key").agg(F.min("own").alias("lead"), F.max("own").alias("__last")).where("lead < __last").drop("__last")
    groups = connected_components(by_key.join(shared, "key").where("own <> lead").select(F.col("lead").alias("a"), F.col("own").alias("b")).distinct())
    groups = stored(groups.withColumnRenamed("node", "own").join(nodes.select("own", "n", "node"), "own"), "groups")
    blocks = groups.groupBy("component").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    members = groups.join(blocks, "component").select(F.col("node").alias("id"), "own", "component", "blocks")
    if groups.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        members = F.broadcast(members)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            found = [shingles(t, shingle).tobytes() for t in batch["text"]]
            # an id that repeats brings other texts along
            same = np.array([xxhash.xxh64_intdigest(s) for s in found], np.uint64).view(np.int64) == batch["own"].to_numpy()
            yield batch.drop(columns="text").assign(set=found)[same]
        release()

    dealt = docs.join(members, "id").mapInPandas(sets, "id long, own long, component long, blocks int, set binary")
    large = groups.join(blocks.where("blocks > 1"), "component", "left_semi").limit(1).count() > 0
    undivided = lambda rows: rows.select("component", F.lit(0).alias("i"), F.lit(0).alias("j"), "id", "set")
    led, pairs = None, undivided(dealt)
    if large:
        dealt = stored(dealt, "dealt")
        led = _led(dealt.where("blocks > 1"))
        pairs = undivided(dealt.where("blocks = 1")).unionByName(_left(led, block))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in key_runs(batches, ["component", "i", "j"]):
            ids, out = batch["id"].to_numpy(), []
            for at in batch.groupby(["component", "i", "j"], sort=False).indices.values():
                if len(at) > 1:
                    out += [(ids[at[a]], ids[at[b]]) for a, b in _forest([np.frombuffer(batch["set"].iloc[x], np.uint64) for x in at])]
            found = np.array(out, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})
        release()

    keys = ["component", "i", "j"]
    near = pairs.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(link, "a long, b long")
    if led is not None:
        near = near.unionByName(led.where("reached and id <> lead_id").select(F.col("lead_id").alias("a"), F.col("id").alias("b")))
    equal = sketches.join(nodes.select("own", "node"), "own").where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"))
    return near.unionByName(equal)
