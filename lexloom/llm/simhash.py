"""SimHash near-duplicates by covering locality-sensitive hashing (Pagh 2016).

Each fingerprint bit gets a vector of RADIUS + 1 bits. For every non-zero vector v there is a table whose mask keeps the
bits whose vector has an odd product with v. If two fingerprints differ in RADIUS bits or fewer, the vectors of those
bits leave a v that is orthogonal to all of them, so in that table both have the same masked value: no pair within the
radius is missed. 2^(RADIUS + 1) - 1 tables of about 32 bits each.

Equal fingerprints are merged first, so that groups of copies cost one row. Within a bucket (table, masked value) a
search visits each fingerprint once and compares it with those not yet reached; only the links of a spanning forest are
emitted, never all pairs. A bucket of more than HOT_BUCKET fingerprints is split before it is dealt out, by the bits that
its mask leaves out: of RADIUS + 1 runs of them one must agree, so this loses no pair either. What a task is left with is
split the same way down to SMALL. Components come from the stars of `components`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import attach, drop_stored, release, stored, whole
from lexloom.llm.components import connected_components

RADIUS = 4
SHINGLE = 4
BITS = 64
#: Fingerprints that are compared with each other; more are split.
SMALL = 4096
#: Fingerprints of a bucket from which it is split before it is dealt out.
HOT_BUCKET = 50_000


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The tables' masks. Bit i has the vector i mod (2^(radius+1) - 1) + 1: never zero, each equally often."""
    top = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % top + 1) & v).bit_count() & 1) for v in range(1, top + 1)]


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """Fingerprint of a text: a bit is 1 if set in over half the hashes of its n-word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return h(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - n + 1].tolist()
    count = len(starts)
    hashes = np.fromiter((h(line[a:b], 42) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)), np.uint64, count)
    total = np.zeros(BITS, np.int64)
    for k in range(0, count, 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > count, bitorder="little").view("<u8")[0])


def runs(left_out: int, radius: int = RADIUS) -> list[int]:
    """radius + 1 masks that share out the bits of left_out: two values that differ in `radius` of these bits agree in one run."""
    places = np.array([i for i in range(BITS) if left_out >> i & 1], dtype=object)
    return [sum(1 << int(i) for i in run) for run in np.array_split(places, radius + 1)]


def _forest(x: np.ndarray, radius: int, left_out: int) -> list[tuple[int, int]]:
    """Indices (i, j) of links that connect all of x that is connected by distances of at most `radius`.

    x may differ in the bits of left_out only. Of more than SMALL values those that agree in a run of these bits are
    compared, and so on while the runs part them well; what they do not part is close together and is soon visited.
    """
    n = len(x)
    if left_out.bit_count() <= radius:
        return [(0, j) for j in range(1, n)]
    if n > SMALL:
        groups = []
        for run in runs(left_out, radius):
            part = x & np.uint64(run)
            order = np.argsort(part, kind="stable")
            own = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
            groups.append((run, own))
        if max(len(g) for _, own in groups for g in own) * 8 <= n:
            return [(int(g[i]), int(g[j])) for run, own in groups for g in own if len(g) > 1 for i, j in _forest(x[g], radius, left_out & ~run)]
    if n == 2:
        return [(0, 1)] if (int(x[0]) ^ int(x[1])).bit_count() <= radius else []
    out, rest = [], np.arange(n)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = np.bitwise_count(x[rest] ^ x[i]) <= radius
            if near.any():
                found = rest[near].tolist()
                out += [(i, j) for j in found]
                queue += found
                rest = rest[~near]
    return out


def key_runs(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of a partition sorted by `key`, dealt anew so that no key is cut between two of them."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = (batch[key] != batch[key].iloc[-1]).any(axis=1).to_numpy().nonzero()[0]
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield pd.concat([*rest, batch.iloc[:cut]], ignore_index=True)
            rest = [batch.iloc[cut:]]
        elif rest and (rest[-1][key].iloc[-1] != batch[key].iloc[0]).any():
            yield pd.concat(rest, ignore_index=True)
            rest = [batch]
        else:
            rest.append(batch)
    if rest:
        yield pd.concat(rest, ignore_index=True)


def near_duplicates(documents: DataFrame, *, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id that chains of fingerprints within `radius` bits reach, the document's own included.
    Null texts and texts without words have fingerprint zero. Ids are longs; rows with a null id are left out of
    components: their component_id is the smallest id of their fingerprint's component, or null if it has none.
    Repeated rows give repeated results, an empty table none. Other columns are not read.
    """

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "fp": np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64).astype(np.int64)})
        release()

    docs = documents.select(F.col(id_col).cast("long").alias("id"), whole(documents[text_col]).alias("text"))
    docs = stored(docs.mapInPandas(prints, "id long, fp long"), "fingerprints")
    nodes = docs.where("id is not null").groupBy("fp").agg(F.min("id").alias("node"))
    all_masks = masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in all_masks]
    tables = nodes.select("fp", "node", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("table", "key"))

    # a bucket of very many fingerprints is dealt out by the runs of the bits that its mask leaves out
    every = (1 << BITS) - 1
    parts = [runs(every & ~m, radius) for m in all_masks]
    hot = tables.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_BUCKET).select("table", "key")
    hot = stored(hot, "hot-buckets")
    keys = ["table", "key", "run", "part"]
    cold, split = tables, None
    if hot.limit(1).count():
        by_table = F.array(*[F.array(*[F.lit(p - (1 << 64) if p >> 63 else p) for p in own]) for own in parts])
        cold, split = attach(tables, hot, ["table", "key"], "left_anti"), attach(tables, hot, ["table", "key"], "left_semi")
        split = split.select("fp", "node", "table", "key", F.posexplode(F.get(by_table, F.col("table"))).alias("run", "part")).withColumn("part", F.col("fp").bitwiseAND(F.col("part")))
    dealt = cold.select("fp", "node", "table", "key", F.lit(-1).alias("run"), F.lit(0).cast("long").alias("part"))
    dealt = dealt if split is None else dealt.unionByName(split)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in key_runs(batches, keys):
            table, run = batch["table"].to_numpy(), batch["run"].to_numpy()
            fps, ids = batch["fp"].to_numpy().view(np.uint64), batch["node"].to_numpy()
            change = np.zeros(len(batch) - 1, bool)
            for c in keys:
                change |= np.diff(batch[c].to_numpy()) != 0
            cuts = np.flatnonzero(change) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(table)]))
            pairs: list[tuple[int, int]] = []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                left_out = every & ~all_masks[table[s]] & ~(parts[table[s]][run[s]] if run[s] >= 0 else 0)
                pairs += [(s + i, s + j) for i, j in _forest(fps[s:e], radius, left_out)]
            at = np.array(pairs, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": ids[at[:, 0]], "b": ids[at[:, 1]]})

    links = dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "fp", "node").mapInPandas(link, "a long, b long")
    found = connected_components(links)
    drop_stored(hot)
    classes = nodes.join(found, nodes["node"] == found["node"], "left").select(nodes["fp"], F.coalesce(found["component"], nodes["node"]).alias("component_id"))
    return docs.join(classes, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
