"""WARC records in ZIP packages, read by ranges without extraction.

A package is a ZIP file with stored (uncompressed) members only: `archive/data-NNNNNN.warc.gz`, whose WARC records are
gzip members of their own, and `indexes/index.cdx`, one JSON line per record with its target, member, offset and length
in the member. The reader parses the end of the package (end record, ZIP64 locator and record), the central directory
with its ZIP64 fields and the local headers, finds where each stored member's bytes begin, and reads the index and then
single records by range.

Records with equal payloads are written once: of each group of at least `min_payload` bytes the record with the largest
page id is the response, the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import drop_stored, scratch, stored, whole
from lexloom.llm.token_file import opened, put

#: Bytes of records after which a package is closed.
PACKAGE_BYTES = 64 << 20
#: Payloads from this many bytes on are deduplicated.
MIN_PAYLOAD = 0
#: Groups of equal payloads that are broadcast at most (about 70 bytes each).
BROADCAST_GROUPS = 100_000
#: Bytes of neighbouring records that are read at once, but for a single larger record.
READ_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

_LOCAL, _CENTRAL, _END = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH")
_END64, _LOCATOR = struct.Struct("<4sQ2H2I4Q"), struct.Struct("<4sIQI")
_BIG, _MANY = 0xFFFFFFFF, 0xFFFF


def digest_of(payload: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- WARC records ----------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit (refers_to given) has the HTTP head and no payload."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if revisit else head + payload
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>",
        f"WARC-Date: {DATE}", *([f"WARC-Target-URI: {target}"] if target else []), f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}",
    ]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case, the version as `version`) and HTTP payload of a record's gzip member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {"version": version} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    if rest[size : size + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it says")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


# ---- ZIP packages ----------------------------------------------------------------------------------------------------


def zip_bytes(members: list[tuple[str, list[bytes]]], *, zip64: bool = False) -> list[bytes]:
    """A ZIP file of stored members, as parts. ZIP64 fields are used where sizes need them, or always on request."""
    out, central, at = [], [], 0
    for name, parts in members:
        size, crc, label = sum(map(len, parts)), 0, name.encode()
        for x in parts:
            crc = zlib.crc32(x, crc)
        big = zip64 or size >= _BIG or at >= _BIG
        extra = struct.pack("<2H2Q", 1, 16, size, size) if big else b""
        shown = _BIG if big else size
        local = _LOCAL.pack(b"PK\3\4", 45 if big else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(label), len(extra)) + label + extra
        extra = struct.pack("<2H3Q", 1, 24, size, size, at) if big else b""
        central.append(_CENTRAL.pack(b"PK\1\2", 45 if big else 20, 45 if big else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(label), len(extra), 0, 0, 0, 0, _BIG if big else at) + label + extra)
        out += [local, *parts]
        at += len(local) + size
    length, n = sum(map(len, central)), len(members)
    out += central
    big = zip64 or at >= _BIG or length >= _BIG or n >= _MANY
    if big:
        out.append(_END64.pack(b"PK\6\6", _END64.size - 12, 45, 45, 0, 0, n, n, length, at) + _LOCATOR.pack(b"PK\6\7", 0, at + length, 1))
    out.append(_END.pack(b"PK\5\6", 0, 0, _MANY if big else n, _MANY if big else n, _BIG if big else length, _BIG if big else at, 0))
    return out


class ZipPackage:
    """Directory of a ZIP file read by ranges: `read(offset, size)` gives bytes of it, `size` is its length."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        self.read = read
        tail_at = max(0, size - _END.size - _MANY)
        tail = read(tail_at, size - tail_at)
        k = tail.rfind(b"PK\5\6")
        # a comment may hold the sign too: the record must reach the end of the file with its comment
        while k >= 0 and (k + _END.size > len(tail) or k + _END.size + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
            k = tail.rfind(b"PK\5\6", 0, k)
        if k < 0:
            raise ValueError("no end of central directory")
        _, _, _, _, n, length, at, _ = _END.unpack_from(tail, k)
        if n == _MANY or length == _BIG or at == _BIG:
            sign, _, where, _ = _LOCATOR.unpack(read(tail_at + k - _LOCATOR.size, _LOCATOR.size))
            if sign != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            sign, _, _, _, _, _, _, n, length, at = _END64.unpack(read(where, _END64.size))
            if sign != b"PK\6\6":
                raise ValueError("no ZIP64 end record")
        self.members: dict[str, tuple[int, int, int, int]] = {}
        data, pos = read(at, length), 0
        for _ in range(n):
            sign, _, _, _, method, _, _, crc, packed, full, n_name, n_extra, n_note, _, _, _, offset = _CENTRAL.unpack_from(data, pos)
            if sign != b"PK\1\2":
                raise ValueError("a broken central directory")
            name = data[pos + _CENTRAL.size : pos + _CENTRAL.size + n_name].decode()
            extra, e = data[pos + _CENTRAL.size + n_name : pos + _CENTRAL.size + n_name + n_extra], 0
            while e + 4 <= len(extra):
                tag, n_field = struct.unpack_from("<2H", extra, e)
                if tag == 1:
                    field = iter(struct.unpack_from(f"<{n_field // 8}Q", extra, e + 4))
                    full = next(field) if full == _BIG else full
                    packed = next(field) if packed == _BIG else packed
                    offset = next(field) if offset == _BIG else offset
                e += 4 + n_field
            self.members[name] = (offset, packed, crc, method)
            pos += _CENTRAL.size + n_name + n_extra + n_note

    def start(self, name: str) -> int:
        """Where the bytes of a stored member begin; members that are compressed cannot be read by range."""
        offset, method = self.members[name][0], self.members[name][3]
        if method:
            raise ValueError(f"member {name} is not stored")
        head = _LOCAL.unpack(self.read(offset, _LOCAL.size))
        if head[0] != b"PK\3\4":
            raise ValueError("a broken local header")
        return offset + _LOCAL.size + head[9] + head[10]

    def member(self, name: str) -> bytes:
        data = self.read(self.start(name), self.members[name][1])
        if zlib.crc32(data) != self.members[name][2]:
            raise ValueError(f"member {name} is damaged")
        return data


# ---- tables ----------------------------------------------------------------------------------------------------------


def payload_groups(rows: DataFrame, *, min_payload: int = MIN_PAYLOAD) -> tuple[DataFrame, int]:
    """(sha, n, keeper, copies) of the payloads of at least `min_payload` bytes that several of the (page, sha, n) rows have, and the number of rows."""
    groups = rows.where(F.col("page").isNotNull() & (F.col("n") >= min_payload)).groupBy("sha", "n").agg(F.max("page").alias("keeper"), F.count(F.lit(1)).alias("copies"))
    return stored(groups.where("copies > 1"), "payloads"), rows.count()


def _with_keepers(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """rows with the keeper of their payload's group, null where there is none. Pages move only where there are very many groups.

    Up to BROADCAST_GROUPS groups are broadcast. Of more, those of over total / BROADCAST_GROUPS rows are, of which there
    cannot be more than BROADCAST_GROUPS; the others have no payload that is hot and are joined by shuffling.
    """
    groups = groups.select(F.col("sha").alias("__sha"), F.col("n").alias("__n"), "keeper", "copies")
    same = (F.col("sha") == F.col("__sha")) & (F.col("n") == F.col("__n"))
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), same, "left")
    large = F.col("copies") * BROADCAST_GROUPS > total
    first = rows.join(F.broadcast(groups.where(large)), same, "left")
    loose = F.col("keeper").isNull() & F.col("page").isNotNull()
    return first.where(~loose).unionByName(first.where(loose).drop("__sha", "__n", "keeper", "copies").join(groups.where(~large), same, "left"))


def write_packages(pages: DataFrame, *, min_payload: int = MIN_PAYLOAD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row into packages in the shared folder; returns (path, n_records, n_bytes).

    A null html is an empty payload; a row with a null id is a response, and nothing refers to it. Rows that repeat an id
    are records of their own: each is judged by its own payload, and rows of the largest id of a payload are all
    responses. An empty table gives no package. Other columns are not read. Texts stay where they are: payloads are
    grouped by digest and length, and the groups go to the pages (see `_with_keepers`).
    """
    folder = scratch(pages.sparkSession, "warc")
    payload = F.encode(whole(pages[html_col]), "UTF-8")
    own = [pages[id_col].cast("long").alias("page"), F.sha1(payload).alias("sha"), F.length(payload).alias("n")]
    groups, total = payload_groups(pages.select(*own), min_payload=min_payload)
    rows = _with_keepers(pages.select(*own, pages[url_col].alias("url"), whole(pages[html_col]).alias("html")), groups, total)
    rows = rows.select("page", "url", "html", F.when(F.col("page") < F.col("keeper"), F.col("keeper")).alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, number, records, index, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pd.DataFrame:
            name = f"archive/data-{number:06d}.warc.gz"
            path = f"{folder}/{task:06d}-{number:06d}.wacz"
            lines = "".join(json.dumps(x | {"filename": name}) + "\n" for x in index).encode()
            put(path, zip_bytes([(name, records), ("indexes/index.cdx", [lines])]))
            return pd.DataFrame({"path": [path], "n_records": [len(index)], "n_bytes": [size]})

        for batch in batches:
            ids, refers = batch["page"].astype(object).where(batch["page"].notna(), None), batch["refers_to"].astype(object).where(batch["refers_to"].notna(), None)
            for page, url, html, ref in zip(ids, batch["url"], batch["html"], refers, strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                page, ref = None if page is None else int(page), None if ref is None else int(ref)
                data = record(page, url, payload, digest_of(payload), ref)
                index.append({"url": url, "page": page, "offset": size, "length": len(data)})
                records.append(data)
                size += len(data)
                if size >= PACKAGE_BYTES:
                    yield close()
                    number, records, index, size = number + 1, [], [], 0
        if index:
            yield close()

    packages = stored(rows.mapInPandas(write, "path string, n_records long, n_bytes long"), "packages")
    drop_stored(groups)
    return packages


def _records(at: Callable[[int, int], bytes], places: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes at (offset, length) places in their order; neighbours are read together, READ_BYTES at a time."""
    k = 0
    while k < len(places):
        start = end = places[k][0]
        j = k
        while j < len(places) and places[j][0] == end and (j == k or end + places[j][1] - start <= READ_BYTES):
            end += places[j][1]
            j += 1
        data = memoryview(at(start, end - start))
        for offset, length in places[k:j]:
            yield bytes(data[offset - start : offset - start + length])
        k = j


def read_packages(packages: DataFrame, *, id_col: str = "page_id") -> DataFrame:
    """One row per record of the packages: its id, payload_bytes, payload_digest, record_type, refers_to.

    Each response's payload is read and held against its digest.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with opened(path) as f:

                    def at(offset: int, size: int, f=f) -> bytes:
                        f.seek(offset)
                        return f.read(size)

                    package, rows = ZipPackage(at, f.size()), []
                    starts = {name: package.start(name) for name in package.members if name.startswith("archive/")}
                    for name in (n for n in package.members if n.startswith("indexes/")):
                        index = [json.loads(line) for line in package.member(name).splitlines()]
                        for data in _records(at, [(starts[x["filename"]] + x["offset"], x["length"]) for x in index]):
                            head, payload = parse_record(data)
                            kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                            if kind == "response" and digest_of(payload) != digest:
                                raise ValueError(f"a damaged payload in {path}")
                            rows.append((_int(head.get("x-page-id")), int(head["x-payload-length"]), digest, kind, _int(head.get("x-refers-to-page"))))
                    out = pd.DataFrame(rows, columns=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                    yield out.astype({"id": "Int64", "refers_to": "Int64"})

    dealt = packages.select("path").repartition(packages.sparkSession.sparkContext.defaultParallelism * 2, "path")
    return dealt.mapInPandas(read, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long").withColumnRenamed("id", id_col)


def _int(x: str | None) -> int | None:
    return None if x is None else int(x)
