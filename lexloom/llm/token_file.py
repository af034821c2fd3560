"""Token ids in fixed-width bit-packed files, with numpy unpacking and random access.

A file holds the ids of consecutive documents. Each id takes the least bits that hold the vocabulary, least significant
bit first; blocks of BLOCK ids begin at a byte. Layout, little-endian:

    magic `LXTK`, version uint16, bits uint16, block uint32, documents uint64, ids uint64
    document ids int64 x documents, ends uint64 x documents (ids up to and with each document, from the file's start)
    block offsets uint64 x (blocks + 1), from the start of the blocks
    blocks

Files are written in the shared folder by the tasks, under a name of their own first and then moved to a name that
depends on the shard alone: a task that runs again writes the same file.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import scratch, stored, whole
from lexloom.llm.encode import encoder, ids_crc32

MAGIC, VERSION, BLOCK = b"LXTK", 1, 1 << 14
HEADER = struct.Struct("<4sHHIQQ")
#: Documents that are encoded together, and the characters at which such a group is closed.
GROUP_CHARS = 2_000_000
#: Bytes of the input's files for a partition, at most.
PARTITION_BYTES = 64 << 20
#: Ids in a file at most, but for a single longer document.
SHARD_IDS = 8_000_000


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of `bits` bits each, least significant first, filled up to a byte."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    flat = ((ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(flat.ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """n ids of `bits` bits (32 at most) from the start of data."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)])
    at = np.arange(n, dtype=np.int64) * bits
    window = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        window |= raw[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((window >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def to_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """A file's content."""
    blocks = [pack(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8")
    head = HEADER.pack(MAGIC, VERSION, bits, block, len(doc_ids), len(ids))
    return b"".join([head, np.asarray(doc_ids, "<i8").tobytes(), np.cumsum(lengths).astype("<u8").tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Reads a file by parts: `read(offset, size)` gives bytes of it."""

    def __init__(self, read) -> None:
        self.read = read
        magic, version, self.bits, self.block, self.documents, self.ids = HEADER.unpack(read(0, HEADER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        n, blocks = self.documents, -(-self.ids // self.block)
        index = read(HEADER.size, 16 * n + 8 * (blocks + 1))
        self.doc_ids, self.ends = np.frombuffer(index, "<i8", n), np.frombuffer(index, "<u8", n, 8 * n)
        self.offsets = np.frombuffer(index, "<u8", blocks + 1, 16 * n)
        self.start = HEADER.size + len(index)

    def span(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (exclusive) of the file; reads the blocks that hold them."""
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        at, end = int(self.offsets[first]), int(self.offsets[last + 1])
        data, out = memoryview(self.read(self.start + at, end - at)), []
        for k in range(first, last + 1):
            n = min(self.block, self.ids - k * self.block)
            out.append(unpack(data[int(self.offsets[k]) - at : int(self.offsets[k + 1]) - at], n, self.bits))
        return np.concatenate(out)[a - first * self.block : b - first * self.block]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the file."""
        return self.span(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") and "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def put(uri: str, data: list[bytes]) -> None:
    """Writes a file whole or not at all; a second writer of the same content does no harm."""
    store, path = _filesystem(uri)
    own = f"{path}.{uuid.uuid4().hex}.part"
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(own) as out:
        for x in data:
            out.write(x)
    store.move(own, path)


def opened(uri: str):
    """A file of the shared folder for reading by offset."""
    store, path = _filesystem(uri)
    return store.open_input_file(path)


def groups(batches: Iterator[pd.DataFrame], limit: int = GROUP_CHARS) -> Iterator[pd.DataFrame]:
    """The rows in order, in groups of about `limit` characters; a longer text is a group of its own."""
    for batch in batches:
        total = batch["text"].str.len().cumsum().to_numpy()
        for own in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(total // limit)) + 1) if len(batch) else []:
            yield batch.iloc[own]


def text_groups(batches: Iterator[pa.RecordBatch], limit: int = GROUP_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of (id, text) rows in order, in groups of about `limit` bytes; only a group at a time becomes Python strings."""
    for batch in batches:
        total = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(total // limit)) + 1).tolist(), len(total)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                part = batch.slice(a, b - a)
                yield part.column(0).to_pylist(), part.column(1).to_pylist()


def write_token_files(documents: DataFrame, tokenizer: str, *, end_id: int, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, adds end_id, writes files in ascending id order; returns (path, shard, part, first, n_docs, n_ids).

    Texts are whole, null is empty. Documents of equal id stand side by side, ordered by text; a null id comes first and
    is stored as the least long. An empty table gives no file. Other columns are not read.
    """
    spark = documents.sparkSession
    folder = scratch(spark, "tokens")
    docs = documents.select(F.coalesce(documents[id_col].cast("long"), F.lit(-(2**63))).alias("id"), whole(documents[text_col]).alias("text"))
    # as many partitions as the input's files call for, where the session's number would make them too large
    wanted = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // PARTITION_BYTES
    if partitions is None and int(spark.conf.get("spark.sql.shuffle.partitions")) < wanted < 1 << 20:
        partitions = wanted
    ordered = (docs.repartitionByRange(partitions, "id") if partitions else docs.repartitionByRange("id")).sortWithinPartitions("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, part, code = TaskContext.get().partitionId(), 0, encoder(tokenizer, "leading")
        bits = max(1, int(max(code.size - 1, end_id)).bit_length())
        end = np.array([end_id], code.kind).tobytes()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            ids, lengths, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
            path = f"{folder}/{shard:06d}-{part:06d}.tok"
            put(path, [to_bytes(ids, lengths, tokens, bits)])
            values = {"path": pa.array([path]), "shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "first": pa.array([int(ids[0])]), "n_docs": pa.array([len(ids)]), "n_ids": pa.array([len(tokens)])}
            return pa.RecordBatch.from_pydict(values)

        for docs_of, texts in text_groups(batches):
            out = [x + end for x in code.encode(texts)]
            lengths = np.array([len(x) for x in out], np.int64) // code.kind.itemsize
            held.append((np.array(docs_of, np.int64), lengths, np.frombuffer(b"".join(out), code.kind)))
            if sum(len(x[2]) for x in held) >= SHARD_IDS:
                yield close()
                held, part = [], part + 1
        if held:
            yield close()

    return stored(ordered.mapInArrow(write, "path string, shard int, part int, first long, n_docs long, n_ids long"), "token-files")


def read_token_files(files: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the files: its id, start (ids of all documents before it), n_tokens, ids_crc32."""
    from pyspark.sql import Window

    before = F.sum("n_ids").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1))
    # one small row per file; dealt out again so that every core reads files
    placed = files.select("path", F.coalesce(before, F.lit(0)).cast("long").alias("before"))
    placed = placed.repartition(files.sparkSession.sparkContext.defaultParallelism * 2, "path")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["before"], strict=True):
                with opened(path) as f:

                    def at(offset: int, size: int, f=f) -> bytes:
                        f.seek(offset)
                        return f.read(size)

                    got = TokenFile(at)
                    starts = np.concatenate(([0], got.ends[:-1].astype(np.int64)))
                    yield pd.DataFrame({"id": got.doc_ids, "start": start + starts, "n_tokens": got.ends.astype(np.int64) - starts, "ids_crc32": _checks(got)})

    out = placed.mapInPandas(read, "id long, start long, n_tokens long, ids_crc32 long")
    return out.select(F.nullif(F.col("id"), F.lit(-(2**63))).alias(id_col), "start", "n_tokens", "ids_crc32")


def _checks(got: TokenFile, limit: int = 4_000_000) -> list[int]:
    """ids_crc32 of every document, reading runs of documents of about `limit` ids."""
    out, a, ends = [], 0, got.ends.astype(np.int64)
    while a < got.documents:
        base = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + limit, side="right")))
        ids = got.span(base, int(ends[b - 1])).astype("<u4")
        cuts = [0, *(ends[a:b] - base).tolist()]
        out += [ids_crc32(ids[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
        a = b
    return out
