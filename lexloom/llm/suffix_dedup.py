"""Removal of long byte strings that occur earlier, by interval expansion on Burrows-Wheeler transforms.

Meaning. A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document of smaller id, or
earlier in the same one. Strings are judged on the input, overlaps count, matches never cross documents.

1. Seeds. Of the hashes of all SEED-byte strings inside a LENGTH-byte window, the smallest (leftmost at ties) is the
   window's seed. It depends on the window's bytes alone, so equal windows have equal seeds at equal places: they meet
   under the seed's hash, and no repeat is missed. Consecutive windows with the same seed form one row: about a
   fortieth of the bytes, 29 bytes each, packed by numpy and dealt out by the hash.
2. Classes. Rows of a seed whose windows' bytes are equal (64-bit XXH3 within a 64-bit seed hash) are one class; its
   earliest row stands for it, every window of the others is a repeat. Map tasks do this first, HELD_ROWS rows at a time:
   repeats go to their texts from there, and only the earliest rows are dealt out by the seed. Seeds with one class are
   done. Seeds with more ask for their representatives' bytes.
3. Intervals. The bytes come from the texts, dealt out by document. Rows are cut and take longer seeds, so that those which
   share a seed and nothing around it part. For each bounded set of seeds the suffixes of the bytes are sorted by their first LENGTH bytes, which gives a Burrows-Wheeler transform. A breadth-first search extends
   intervals backward one byte per level (Beller et al. 2013): level l finds exactly the boundaries of suffixes whose
   common prefix is l long, each once. It stops at LENGTH; suffixes between which no boundary was found share LENGTH
   bytes or more. In each such group all but the earliest window are repeats.
4. Removal. The spans go to the texts (the same exchange as before), are merged and cut out.

Every step works on bounded groups: buckets are as many as the input needs. A seed with more than HOT_ROWS rows that
differ (a line that many documents share, with other text around it each time) would make its bucket large. Such seeds are
counted exactly; there cannot be more than HOT_SEEDS. Their windows take step 3 one by one, dealt out by their bytes, where
equal ones are merged in each bucket of texts and by salt before they meet. A set of seeds that still exceeds MAX_SORTED is
split by its windows' bytes.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import SALTS, attach, stored, whole
from lexloom.llm.token_file import groups

LENGTH = 100
SEED = 20
#: Characters of text that a map task takes at a time.
BATCH_CHARS = 3_000_000
#: Windows whose seeds are found at a time: arrays of 2 MB.
CHUNK = 1 << 18
#: Bytes of text per bucket of texts and per bucket of seeds.
TEXT_BUCKET = 3 << 20
SEED_BUCKET = 6 << 20
#: Bytes whose suffixes are sorted together, as a rule and at most.
SORTED, MAX_SORTED = 1 << 20, 4 << 20
#: Buckets of seeds whose bytes are sorted by one task.
SEEDS_AT_ONCE = 4
#: How often rows are halved before what is left of them is sorted.
CUTS = 2

#: Rows of seeds that a map task merges at a time, 33 bytes each.
HELD_ROWS = 1 << 20
#: Rows of a seed from which its windows are dealt out by their bytes, and the most seeds that can be listed so (8 bytes each).
HOT_ROWS, HOT_SEEDS = 250_000, 1_000_000

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), "<u8").astype(np.uint64)
_BREAK = 0xFF  # never in UTF-8


def _columns(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes, each as planes of its bytes, which compress well."""
    out = [struct.pack("<IB", len(arrays[0]), len(arrays)), "".join(a.dtype.char for a in arrays).encode()]
    return b"".join(out + [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays])


def _arrays(data: bytes) -> list[np.ndarray]:
    n, k = struct.unpack_from("<IB", data)
    kinds, at, out = data[5 : 5 + k].decode(), 5 + k, []
    for kind in kinds:
        kind = np.dtype(kind)
        size = n * kind.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at).reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += size
    return out


def _count(data: bytes) -> int:
    """Rows in packed columns."""
    return struct.unpack_from("<I", data)[0]


def _joined(blobs: Iterator[bytes], width: int) -> list[np.ndarray]:
    got = [_arrays(b) for b in blobs]
    return [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * width


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    h = key.astype(np.int64).view(np.uint64) * _MIX
    return ((h ^ (h >> np.uint64(31))) % np.uint64(n)).astype(np.int64)


def _dealt(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, columns) of the rows of each bucket."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for own in np.split(order, cuts) if len(order) else ():
        yield int(bucket[own[0]]), _columns(*[a[own] for a in arrays])


def _seed_of_windows(raw: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the k bytes from each place, and for each window the place of its seed."""
    base = lambda m: np.uint64(pow(_BASE, m, 1 << 64))
    powers, m = {1: _TABLE[raw]}, 1
    while 2 * m <= k:
        powers[2 * m] = powers[m][:-m] * base(m) + powers[m][m:]
        m *= 2
    h, done = powers[m], m
    for part in (p for p in reversed(list(powers)) if p < m):
        if done + part <= k:
            rest = powers[part][done:]
            h = h[: len(rest)] * base(part) + rest
            done += part
    h = h ^ (h >> np.uint64(29))
    h *= _MIX
    h ^= h >> np.uint64(32)
    least, span, want = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1, length - k + 1
    while 2 * span <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < want:
        least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
    return h, (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def find_seeds(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = SEED, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, lo, hi): the runs lo..hi of windows with the same seed, over texts joined in raw that end at `ends`.

    Works through `chunk` window starts at a time, whatever the length of a text.
    """
    starts = np.concatenate(([0], ends[:-1]))
    long = ends - starts >= length
    inside = np.zeros(len(raw) + 1, np.int8)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    inside, out = np.cumsum(inside, dtype=np.int8), [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a in range(0, len(raw), chunk):
        p = np.flatnonzero(inside[a : a + chunk])
        if not len(p):
            continue
        h, seed = _seed_of_windows(raw[a : a + chunk + length - 1], length, k)
        s = seed[p]
        cut = np.flatnonzero((np.diff(p) != 1) | (np.diff(s) != 0)) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(p) - 1]))
        out.append((h[s[first]], p[first] + a, p[last] + a))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` bytes, equal ones in any order. The text is a ring, as its transform is."""
    n = len(text)
    padded = np.resize(text, n + 8)
    key = np.zeros(n, np.uint64)
    for i in range(min(8, depth)):
        key = (key << np.uint64(8)) | padded[i : i + n]
    known = min(8, depth)
    while True:
        order = np.argsort(key)
        if known >= depth:
            return order
        ranks = np.empty(n, np.int64)
        own = key[order]
        ranks[order] = np.cumsum(np.concatenate(([1], own[1:] != own[:-1])))
        step = min(known, depth - known)
        key = ranks * (n + 1) + np.roll(ranks, -step)
        known += step


def shared_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Group number of each suffix in `order`: neighbours are in one group if they share `depth` bytes.

    Breadth-first backward extension: an interval holds the suffixes that begin with some string w; extended by a byte c
    it becomes the interval of cw. At level l the intervals of strings of l + 1 bytes end at boundaries whose common
    prefix is at most l; a boundary that is met for the first time has exactly l, and only then its interval lives on.
    """
    n = len(text)
    before = text[order - 1]
    by_byte = np.argsort(before, kind="stable")
    to = np.empty(n, np.int64)
    to[by_byte] = np.arange(n)
    same = before[by_byte[1:]] == before[by_byte[:-1]]
    following, preceding = np.full(n, n), np.full(n, -1)
    following[by_byte[:-1][same]], preceding[by_byte[1:][same]] = by_byte[1:][same], by_byte[:-1][same]
    met = np.zeros(n + 1, bool)
    met[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    for level in range(depth):
        if not len(lo):
            break
        size = hi - lo
        one = size == 1
        left = to[lo[one]]
        right = left + 1
        if not one.all():
            lo, hi, size = lo[~one], hi[~one], size[~one]
            own = np.repeat(np.arange(len(lo)), size)
            rows = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + lo[own]
            # per interval and byte the first and the last row; those intervals are disjoint, so sorting pairs them
            left = np.concatenate((left, np.sort(to[rows[preceding[rows] < lo[own]]])))
            right = np.concatenate((right, np.sort(to[rows[following[rows] >= hi[own]]]) + 1))
        new = ~met[right]
        lo, hi = left[new], right[new]
        met[hi] = True
        if level == 0:
            # the whole text's last extension ends at n, which is no boundary but whose interval is needed
            end = right == n
            lo, hi = np.concatenate((lo, left[end])), np.concatenate((hi, right[end]))
    return np.cumsum(met[:n]) - 1


def repeated_windows(contexts: list[bytes], windows: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For contexts in order of their place, whether each of their windows (windows[i] of them from the start of context i) equals an earlier one."""
    text = np.frombuffer(bytes([_BREAK]).join(contexts) + bytes([_BREAK]), np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts)) + 1
    starts = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(contexts)), windows)
    place = starts[own] + np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    order = sorted_suffixes(text, length)
    group = np.empty(len(text), np.int64)
    group[order] = shared_prefixes(text, order, length)
    _, first = np.unique(group[place], return_index=True)
    out = np.ones(len(place), bool)
    out[first] = False
    return out


def _spans(place: np.ndarray, key: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows (same key, at + 1) as (key, start, bytes); place keeps runs of different rows apart."""
    if not len(at):
        return key, at, at
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(place) != 0)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(at) - 1]))
    return key[first], at[first], at[last] - at[first] + length


def narrowed(seed: np.ndarray, key: np.ndarray, at: np.ndarray, windows: np.ndarray, contexts: list[bytes], length: int = LENGTH, k: int = SEED) -> tuple[tuple, tuple]:
    """(key, start, bytes) spans of parts that repeat whole, and the parts that are left to compare, as rows under longer seeds.

    Equal windows have their seed at equal places. So a row is cut where that place passes from one range to the next, and
    each part's new seed is the hash of the bytes that all windows of its range have around the seed. Of parts with equal
    bytes the earliest stays, as among rows; a part that is then alone under its seed has no equal window elsewhere and
    goes. This is done CUTS times, the ranges halved each time; sets above SORTED are cut on, down to single windows. What is
    left to sort follows from what is equal in part, not from how many rows share a seed.
    """
    place, row, done, width, cuts = _seed_places(contexts, length, k), np.arange(len(key)), [], length - k + 1, 0
    first, last, spans = place - windows + 1, place, [(np.zeros(0, np.int64),) * 3]
    hashed = lambda a, b, salt: np.fromiter((xxhash.xxh3_64_intdigest(contexts[r][i:j], q) for r, i, j, q in zip(row.tolist(), a.tolist(), b.tolist(), salt.tolist(), strict=True)), np.uint64, len(row))
    while len(row) and width > 1:
        width, cuts = -(-width // 2), cuts + 1
        # parts: the ranges of places from `first` to `last` of each row
        n = last // width - first // width + 1
        own = np.repeat(np.arange(len(row)), n)
        part = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + (first // width)[own]
        row, first, last = row[own], np.maximum(first[own], part * width), np.minimum(last[own], (part + 1) * width - 1)
        name = hashed(place[row] - part * width, place[row] - np.minimum((part + 1) * width - 1, length - k) + length, part)
        start = place[row] - last
        lone, rest = _classes(name, hashed(start, place[row] - first + length, part), key[row], at[row] + start)
        spans.append((key[row[rest]], (at[row] + start)[rest], (last - first)[rest] + length))
        _, group, times = np.unique(name[lone], return_inverse=True, return_counts=True)
        met, name, row, first, last = times[group] > 1, name[lone], row[lone], first[lone], last[lone]
        cut = met & (width > 1) & (np.bincount(group, last - first + length + 1) > (SORTED if cuts >= CUTS else 0))[group]
        done.append(tuple(x[met & ~cut] for x in (name, row, first, last)))
        row, first, last = row[cut], first[cut], last[cut]
    spans = tuple(np.concatenate(x) for x in zip(*spans, strict=True))
    if not done:
        return spans, (seed, key, at, windows, contexts)
    name, row, first, last = (np.concatenate(x) for x in zip(*done, strict=True))
    start = place[row] - last
    size = last - first + 1
    return spans, (name, key[row], at[row] + start, size, [contexts[r][i:j] for r, i, j in zip(row.tolist(), start.tolist(), (start + size + length - 1).tolist(), strict=True)])


def _seed_places(contexts: list[bytes], length: int, k: int) -> np.ndarray:
    """Where the seed is in each context, a chunk of contexts at a time."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    ends = np.cumsum(sizes)
    cuts = [0, *np.flatnonzero(np.diff(ends // CHUNK)) + 1, len(contexts)]
    out = [np.zeros(0, np.int64)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            starts = ends[a:b] - sizes[a:b] - (ends[a] - sizes[a])
            out.append(_seed_of_windows(np.frombuffer(b"".join(contexts[a:b]), np.uint8), length, k)[1][starts] - starts)
    return np.concatenate(out)


def resolve(seed: np.ndarray, key: np.ndarray, at: np.ndarray, windows: np.ndarray, contexts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Repeats among representatives, as (key, start, bytes) spans, by bounded sets of whole seeds."""
    order = np.lexsort((at, key, seed))
    seed, key, at, windows = seed[order], key[order], at[order], windows[order]
    contexts = [contexts[i] for i in order.tolist()]
    sizes = np.cumsum([len(c) + 1 for c in contexts])
    ends = np.concatenate((np.flatnonzero(np.diff(seed)) + 1, [len(seed)])).tolist()
    a = 0
    while a < len(seed):
        base, b = int(sizes[a - 1]) if a else 0, None
        for e in ends[np.searchsorted(ends, a, side="right") :]:
            if b is not None and sizes[e - 1] - base > SORTED:
                break
            b = e
        own = slice(a, b)
        if sizes[b - 1] - base <= MAX_SORTED:
            # by place, so that the earliest window of a group comes first
            o = np.lexsort((at[own], key[own])) + a
            repeat = repeated_windows([contexts[i] for i in o.tolist()], windows[o], length)
            row = np.repeat(np.arange(len(o)), windows[o])
            where = at[o][row] + np.arange(len(row)) - np.repeat(np.cumsum(windows[o]) - windows[o], windows[o])
            yield _spans(row[repeat], key[o][row[repeat]], where[repeat], length)
        else:
            yield from _resolve_hot(key[own], at[own], windows[own], contexts[own], length)
        a = b


def _resolve_hot(key: np.ndarray, at: np.ndarray, windows: np.ndarray, contexts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same for a set that is too large: single windows, dealt out by their bytes into parts that are not."""
    parts = -(-int(windows.sum()) * (length + 1) // (MAX_SORTED // 2))
    row = np.repeat(np.arange(len(key)), windows)
    step = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    part = np.fromiter((xxhash.xxh3_64_intdigest(contexts[r][s : s + length]) % parts for r, s in zip(row.tolist(), step.tolist(), strict=True)), np.int64, len(row))
    for p in range(parts):
        o = np.flatnonzero(part == p)
        if not len(o):
            continue
        o = o[np.lexsort((at[row[o]] + step[o], key[row[o]]))]
        texts = [contexts[r][s : s + length] for r, s in zip(row[o].tolist(), step[o].tolist(), strict=True)]
        if len(texts) * (length + 1) > MAX_SORTED:  # a window that is itself that frequent: equal ones are merged first
            seen: dict[bytes, int] = {}
            repeat = np.array([seen.setdefault(t, i) != i for i, t in enumerate(texts)])
        else:
            repeat = repeated_windows(texts, np.ones(len(texts), np.int64), length)
        o = o[repeat]
        yield _spans(np.arange(len(o)), key[row[o]], at[row[o]] + step[o], length)


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None, int]:
    """(key, text) with unique keys in the order of documents, (key, id) where they differ from the ids, and the bytes of text."""
    docs = documents.select(documents[id_col].cast("long").alias("key"), whole(documents[text_col]).alias("text"))
    n, some, distinct, size = docs.agg(F.count(F.lit(1)), F.count("key"), F.count_distinct("key"), F.sum(F.octet_length("text"))).collect()[0]
    if n == distinct:
        return docs, None, size or 0
    # repeated or missing ids: number the rows by id, then text; null ids come first
    rows = stored(docs.withColumn("hash", F.sha2("text", 256)).withColumn("row", F.monotonically_increasing_id()), "numbered")
    ranked = stored(rows.select("key", "hash", "row").orderBy(F.asc_nulls_first("key"), "hash", "row").withColumn("part", F.spark_partition_id()).withColumn("in_part", F.monotonically_increasing_id()), "ranked")
    parts = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("in_part").alias("least"))
    parts = parts.select("part", "least", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    keys = stored(ranked.join(F.broadcast(parts), "part").select("row", (F.col("before") + F.col("in_part") - F.col("least")).alias("new"), F.col("key").alias("id")), "keys")
    return rows.join(keys, "row").select(F.col("new").alias("key"), "text"), keys.select(F.col("new").alias("key"), "id"), size or 0


def _hot_seeds(rows: DataFrame) -> np.ndarray:
    """Hashes, in order, of the seeds with more than HOT_ROWS rows that differ; rows (bucket, n, rows) are the packed rows of seeds.

    Counted exactly: a seed's rows are all in one bucket, so only buckets of more than HOT_ROWS rows are looked into. Of
    very large inputs the least number grows, so that there are never more than HOT_SEEDS such seeds.
    """
    sizes = rows.groupBy("bucket").agg(F.sum("n").alias("rows"))
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    least = max(HOT_ROWS, total // HOT_SEEDS)
    heavy = stored(sizes.where(F.col("rows") > least).select("bucket"), "heavy")
    if not heavy.limit(1).count():
        return np.zeros(0, np.uint64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seeds, n = np.unique(_joined(batch["rows"], 5)[0], return_counts=True)
            yield pd.DataFrame({"seed": seeds.astype(np.uint64).view(np.int64), "n": n})

    counted = attach(rows, heavy, ["bucket"], "left_semi").select("rows").mapInPandas(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r["seed"] for r in counted.where(F.col("n") > least).collect()], np.int64).view(np.uint64))


def remove_repeats(documents: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per document: its id, n_bytes, n_removed, n_spans (long), kept_sha256 and, on request, kept (binary).

    Null texts are empty. Rows that repeat an id are documents of their own, ordered by text hash; null ids come before
    all others. An empty table gives no rows. Other columns are not read.
    """
    docs, ids, size = _keyed(documents, id_col, text_col)
    n_seed, n_text = max(1, -(-size // SEED_BUCKET)), max(1, -(-size // TEXT_BUCKET))
    rows_kind, spans_kind = "bucket long, n long, rows binary", "bucket long, rows binary"

    def spans_of(key: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[tuple[int, bytes]]:
        """Spans (key, at, bytes) that are to go, dealt by the bucket of their text."""
        return list(_dealt(_bucket(key, n_text), key.astype(np.int64), at.astype(np.uint32), n.astype(np.uint32)))

    def raw_texts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        for group in groups(batches, BATCH_CHARS):
            yield group["key"].to_numpy(np.int64), [t.encode("utf-8", "surrogatepass") for t in group["text"]]

    # 1 and 2: rows of seeds; a task keeps the earliest of equal ones and marks the others as repeats
    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []

        def dealt() -> pd.DataFrame:
            hashes, same, key, at, windows = (np.concatenate(x) for x in zip(*held, strict=True))
            first, rest = _classes(hashes, same, key, at)
            out = [(b, _count(x), False, x) for b, x in spans_of(key[rest], at[rest], windows[rest].astype(np.int64) + length - 1)]
            out += [(b, _count(x), True, x) for b, x in _dealt((hashes[first] % np.uint64(n_seed)).astype(np.int64), hashes[first], same[first], key[first], at[first], windows[first])]
            return pd.DataFrame(out, columns=["bucket", "n", "open", "rows"])

        for keys, texts in raw_texts(batches):
            raw = b"".join(texts)
            ends = np.cumsum([len(t) for t in texts])
            hashes, lo, hi = find_seeds(np.frombuffer(raw, np.uint8), ends, length)
            doc = np.searchsorted(ends, lo, side="right")
            same = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)), np.uint64, len(lo))
            held.append((hashes, same, keys[doc], (lo - np.concatenate(([0], ends[:-1]))[doc]).astype(np.uint32), (hi - lo + 1).astype(np.uint8)))
            if sum(len(x[0]) for x in held) >= HELD_ROWS:
                yield dealt()
                held = []
        if held:
            yield dealt()

    found = stored(docs.mapInPandas(seeds, "bucket long, n long, open boolean, rows binary"), "seeds")
    open_rows, done = found.where("open").select("bucket", "n", "rows"), [found.where("not open").select("bucket", "rows")]
    hot = _hot_seeds(open_rows)

    def classes(batch: pd.DataFrame) -> pd.DataFrame:
        hashes, same, key, at, windows = _joined(batch["rows"], 5)
        first, rest = _classes(hashes, same, key, at)
        own = hashes[first]
        many = np.concatenate((own[1:] == own[:-1], [False])) | np.concatenate(([False], own[1:] == own[:-1])) if len(own) else np.zeros(0, bool)
        ask = first[many]
        out = [(b, False, x) for b, x in spans_of(key[rest], at[rest], windows[rest].astype(np.int64) + length - 1)]
        out += [(b, True, x) for b, x in _dealt(_bucket(key[ask], n_text), key[ask].astype(np.int64), at[ask].astype(np.uint32), windows[ask].astype(np.uint8), hashes[ask].astype(np.uint64))]
        return pd.DataFrame(out, columns=["bucket", "asks", "rows"])

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, raw in raw_texts(batches):
            bucket, out = _bucket(keys, n_text), []
            for b in np.unique(bucket).tolist():
                own = np.flatnonzero(bucket == b).tolist()
                lengths = np.array([len(raw[i]) for i in own], np.int64)
                out.append((b, _columns(keys[own], lengths), zlib.compress(b"".join(raw[i] for i in own), 1)))
            yield pd.DataFrame(out, columns=["bucket", "index", "texts"])

    def opened(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bytes]:
        key, lengths = _joined(batch["index"], 2)
        return key, lengths, b"".join(map(zlib.decompress, batch["texts"]))

    def looked_up(texts_of: pd.DataFrame, key: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bucket's texts and where in them the places are."""
        keys, lengths, raw = opened(texts_of)
        order = np.argsort(keys)
        return raw, (np.cumsum(lengths) - lengths)[order[np.searchsorted(keys[order], key)]] + at

    def fetch(texts_of: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(texts_of):
            return pd.DataFrame([], columns=["bucket", "rows", "bytes"])
        key, at, windows, hashes = _joined(asked["rows"], 4)
        raw, start = looked_up(texts_of, key, at)
        bucket, out = (hashes % np.uint64(n_seed)).astype(np.int64), []
        by = np.argsort(bucket, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
            data = b"".join(raw[a:b] for a, b in zip(start[own].tolist(), (start[own] + windows[own] + length - 1).tolist(), strict=True))
            out.append((int(bucket[own[0]]), _columns(key[own], at[own], windows[own], hashes[own]), data))
        return pd.DataFrame(out, columns=["bucket", "rows", "bytes"])

    # 3: the transform decides
    def expand(batch: pd.DataFrame) -> pd.DataFrame:
        key, at, windows, hashes = _joined(batch["rows"], 4)
        at, windows, data = at.astype(np.int64), windows.astype(np.int64), b"".join(batch["bytes"])
        ends = np.cumsum(windows + length - 1)
        contexts = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        gone, rest = narrowed(hashes, key, at, windows, contexts, length)
        return pd.DataFrame([x for spans in (gone, *resolve(*rest, length)) for x in spans_of(*spans)], columns=["bucket", "rows"])

    # hot seeds: their windows are dealt out by their bytes; equal ones shrink in each text's bucket, then by salt
    def is_hot(hashes: np.ndarray) -> np.ndarray:
        return hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes

    def without_hot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [(b, (x := _arrays(data)), is_hot(x[0])) for b, data in zip(batch["bucket"], batch["rows"], strict=True)]
            yield pd.DataFrame([(b, int((~h).sum()), _columns(*[a[~h] for a in x])) for b, x, h in parts if not h.all()], columns=["bucket", "n", "rows"])

    def ask_hot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes, _, key, at, windows = _joined(batch["rows"], 5)
            own = np.flatnonzero(is_hot(hashes))
            out = _dealt(_bucket(key[own], n_text), key[own].astype(np.int64), at[own].astype(np.uint32), windows[own].astype(np.uint8))
            yield pd.DataFrame([(b, _count(x), x) for b, x in out], columns=["bucket", "n", "rows"])

    def merged(key: np.ndarray, at: np.ndarray, data: np.ndarray, bucket_of, salt: int) -> pd.DataFrame:
        """The earliest of equal windows (rows of data), dealt by their bytes; spans of the others."""
        order = np.lexsort((at, key))
        _, first = np.unique(np.ascontiguousarray(data[order]).view(f"V{length}").ravel(), return_index=True)
        keep = np.zeros(len(order), bool)
        keep[first] = True
        rest, first = order[~keep], order[keep]
        out = [(b, 0, False, x, b"") for b, x in spans_of(key[rest], at[rest], np.full(len(rest), length))]
        to = bucket_of(data[first])
        by = np.argsort(to, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(to[by])) + 1) if len(by) else ():
            i = first[own]
            out.append((int(to[own[0]]), salt, True, _columns(key[i].astype(np.int64), at[i].astype(np.uint32)), data[i].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "salt", "open", "rows", "bytes"])

    def hot_windows(n_hot: int):
        bucket_of = lambda data: np.fromiter((xxhash.xxh3_64_intdigest(x.tobytes()) % n_hot for x in data), np.int64, len(data))

        def fetch_hot(texts_of: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(texts_of):
                return pd.DataFrame([], columns=["bucket", "salt", "open", "rows", "bytes"])
            key, at, windows = _joined(asked["rows"], 3)
            row = np.repeat(np.arange(len(key)), windows)
            step = np.arange(len(row)) - np.repeat(np.cumsum(windows, dtype=np.int64) - windows, windows)
            raw, start = looked_up(texts_of, key, at)
            every, salt, out = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), length), int(asked["bucket"].iloc[0]) % SALTS, []
            for a in range(0, len(row), CHUNK):
                own = slice(a, a + CHUNK)
                out.append(merged(key[row[own]], at[row[own]] + step[own], every[start[row[own]] + step[own]], bucket_of, salt))
            return pd.concat(out, ignore_index=True)

        def shrink(batch: pd.DataFrame) -> pd.DataFrame:
            key, at = _joined(batch["rows"], 2)
            return merged(key, at.astype(np.int64), np.frombuffer(b"".join(batch["bytes"]), np.uint8).reshape(-1, length), bucket_of, 0)

        return fetch_hot, shrink

    def expand_hot(batch: pd.DataFrame) -> pd.DataFrame:
        key, at = _joined(batch["rows"], 2)
        data = b"".join(batch["bytes"])
        contexts, one = [data[a : a + length] for a in range(0, len(data), length)], np.ones(len(key), np.int64)
        spans = resolve(np.zeros(len(key), np.uint64), key, at.astype(np.int64), one, contexts, length)
        return pd.DataFrame([x for own in spans for x in spans_of(*own)], columns=["bucket", "rows"])

    # 4: the spans go to the texts
    def finish(texts_of: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]
        if not len(texts_of):
            return pd.DataFrame([], columns=names)
        keys, lengths, raw = opened(texts_of)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        gone = np.zeros(len(raw), bool)
        if len(spans):
            key, at, n = _joined(spans["rows"], 3)
            order = np.argsort(keys)
            a = starts[order[np.searchsorted(keys[order], key)]] + at
            change = np.bincount(a, minlength=len(raw) + 1) - np.bincount(a + n, minlength=len(raw) + 1)
            gone = np.cumsum(change[: len(raw)]) > 0
        removed = np.concatenate(([0], np.cumsum(gone)))
        rises = np.concatenate(([0], np.cumsum(gone & ~np.concatenate(([False], gone[:-1])))))
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out = []
        for key, a, b in zip(keys.tolist(), starts.tolist(), ends.tolist(), strict=True):
            kept = left[a - int(removed[a]) : b - int(removed[b])]
            runs = int(rises[b] - rises[a]) + int(a < b and a > 0 and gone[a] and gone[a - 1])
            out.append((key, b - a, int(removed[b] - removed[a]), runs, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
        return pd.DataFrame(out, columns=names)

    # both parts of it are used below: the seeds' exchange is reused, and finding the classes again costs less than a table
    asked = (open_rows.mapInPandas(without_hot, rows_kind) if len(hot) else open_rows).select("bucket", "rows").groupBy("bucket").applyInPandas(classes, "bucket long, asks boolean, rows binary")
    held = docs.mapInPandas(texts, "bucket long, index binary, texts binary")
    contexts = held.groupBy("bucket").cogroup(asked.where("asks").select("bucket", "rows").groupBy("bucket")).applyInPandas(fetch, "bucket long, rows binary, bytes binary")
    # a number of its own: its few bytes take long, and partitions that are joined by bytes would leave cores idle
    contexts = contexts.repartition(-(-n_seed // SEEDS_AT_ONCE), "bucket")
    done += [asked.where("not asks").select("bucket", "rows"), contexts.groupBy("bucket").applyInPandas(expand, spans_kind)]
    if len(hot):
        asks = stored(open_rows.mapInPandas(ask_hot, rows_kind), "hot-rows")
        # a row of a seed has at most LENGTH - SEED + 1 windows
        n_hot = max(1, -(-(asks.agg(F.sum("n")).first()[0] or 0) * (length + 1) * (length - SEED + 1) // SORTED))
        fetch_hot, shrink = hot_windows(n_hot)
        kind = "bucket long, salt int, open boolean, rows binary, bytes binary"
        once = stored(held.groupBy("bucket").cogroup(asks.select("bucket", "rows").groupBy("bucket")).applyInPandas(fetch_hot, kind), "hot-windows")
        twice = stored(once.where("open").groupBy("bucket", "salt").applyInPandas(shrink, kind), "hot-windows")
        done += [x.where("not open").select("bucket", "rows") for x in (once, twice)]
        done.append(twice.where("open").groupBy("bucket").applyInPandas(expand_hot, spans_kind))
    spans = functools.reduce(DataFrame.unionByName, done)
    kind = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    out = held.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInPandas(finish, kind)
    if ids is not None:
        return out.join(ids, "key").withColumn(id_col, F.col("id")).select(id_col, *[c for c in out.columns if c != "key"])
    return out.withColumnRenamed("key", id_col)


def _classes(hashes: np.ndarray, same: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are the earliest of their (hash, same), in order of hash; all other rows."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((at, key, same, hashes))
    h, s = hashes[order], same[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])))
    return order[new], order[~new]
