"""WARC records in ZIP packages: a writer, and a reader that takes records by range without extraction.

A package holds two stored (uncompressed) members: ``archive/data.warc`` and ``indexes/index.cdx``, one index line per record with its
offset and length in the archive. The reader parses the end-of-directory records (also ZIP64), the central directory and the local
headers by itself, locates the stored members, reads the index, and then each record by its own range. Packages are read and written
through pyarrow's file systems, at the paths that all executors share; a package is written under a name of its own and moved into place,
so a repeated task leaves one whole package.

Of records with equal payloads of ``MIN_REVISIT`` bytes or more the one with the largest page_id is written as a response; the others are
revisits that refer to it. Rows that share that largest page_id are responses each.

Defined results: a null html is an empty payload. A null url is ``urn:page:<id>``. Rows that repeat a page_id are records of their own, and
a response refers to nothing. An empty table gives no packages. Extra columns are not read.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import new_path, settle

ARCHIVE, INDEX, MIN_REVISIT, RANGES = "archive/data.warc", "indexes/index.cdx", 1000, 2000
#: Copied payloads that are sent to every task at most (about 100 bytes each).
BROADCAST_ROWS = 50_000
#: Sizes from which ZIP64 fields are needed.
LIMIT32, LIMIT16 = 0xFFFFFFFF, 0xFFFF
DATE = "2024-01-01T00:00:00Z"


# --- ZIP -------------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


def _zip64(extra: bytes, wanted: list[int], limits: list[int]) -> list[int]:
    """Values of the ZIP64 extra field for those that are at their limit."""
    at, field = 0, b""
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            field = extra[at + 4 : at + 4 + size]
        at += 4 + size
    out, k = [], 0
    for value, limit in zip(wanted, limits, strict=True):
        if value == limit and k + 8 <= len(field):
            value, k = struct.unpack_from("<Q", field, k)[0], k + 8
        out.append(value)
    return out


def directory(f: pa.NativeFile) -> list[Member]:
    """Members by the central directory of an open, seekable file."""
    size = f.size()
    tail_at = max(0, size - 22 - 65_535)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<10xHII", tail, end)
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        (at,) = struct.unpack_from("<8xQ", tail, locator)
        f.seek(at)
        record = f.read(56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<32xQQQ", record)
    f.seek(start)
    raw, at, out = f.read(length), 0, []
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        method, packed, full, n, m, k, header = struct.unpack_from("<10xH8xIIHHH8xI", raw, at)
        name, extra = raw[at + 46 : at + 46 + n].decode(), raw[at + 46 + n : at + 46 + n + m]
        full, packed, header = _zip64(extra, [full, packed, header], [LIMIT32] * 3)
        out.append(Member(name, method, full, header))
        at += 46 + n + m + k
    return out


def data_start(f: pa.NativeFile, member: Member) -> int:
    """Where a stored member's bytes begin: its local header tells how long its name and extra field are."""
    if member.method:
        raise ValueError(f"{member.name} is not stored")
    f.seek(member.header)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("bad local header")
    n, m = struct.unpack_from("<26xHH", head)
    return member.header + 30 + n + m


class Package:
    """Writes stored members one after the other; sizes and checksums follow the data, in ZIP64 descriptors."""

    def __init__(self, out: pa.NativeFile):
        self.out, self.at, self.entries = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, blocks: Iterator[bytes]) -> None:
        raw, header, crc = name.encode(), self.at, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0x0808, 0, 0, 0x21, 0, LIMIT32, LIMIT32, len(raw), len(extra)) + raw + extra)
        start = self.at
        for b in blocks:
            crc = zlib.crc32(b, crc)
            self._put(b)
        size = self.at - start
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", crc, size, size))
        self.entries.append((raw, crc, size, header))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, header in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, header)
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0x0808, 0, 0, 0x21, crc, LIMIT32, LIMIT32, len(raw), len(extra), 0, 0, 0, 0, LIMIT32) + raw + extra)
        length, end, n = self.at - start, self.at, len(self.entries)
        self._put(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, length, start))
        self._put(struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
        self._put(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, LIMIT16, LIMIT16, LIMIT32, LIMIT32, 0))


# --- WARC ------------------------------------------------------------------------------------------------------------------------


def record(page_id: int, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the headers alone."""
    target = re.sub(r"[\s\x00-\x1f]", lambda m: quote(m[0]), url or f"urn:page:{page_id}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[5:5] = [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8").split("\r\n")[1:])}


def parse(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    headers = _headers(head)
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(headers, _headers(http), payload)


# --- Packages on the cluster -----------------------------------------------------------------------------------------------------


def _write(target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, lines, done = TaskContext.get().partitionId(), [], [0]
        store, base = fs.FileSystem.from_uri(target)

        def records() -> Iterator[bytes]:
            for b in batches:
                for i, url, html, sha, ref in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                    raw = record(i, url, html or b"", bytes.fromhex(sha), ref)
                    lines.append(b"%d %d %d\n" % (i if i is not None else -1, done[0], len(raw)))
                    done[0] += len(raw)
                    yield raw

        rest = records()
        first = next(rest, None)
        if first is not None:
            store.create_dir(base, recursive=True)
            own = f"{base}/.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                package = Package(out)
                package.member(ARCHIVE, (x for y in ([first], rest) for x in y))
                package.member(INDEX, iter([b"".join(lines)]))
                package.close()
            final = f"{base}/part-{part:06d}.wacz"
            with contextlib.suppress(FileNotFoundError):
                store.delete_file(final)
            store.move(own, final)
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}.wacz"]), pa.array([len(lines)], pa.int64())], ["name", "records"])

    return run


def with_references(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, html (binary), sha1, refers_to: the largest page_id among equal payloads of MIN_REVISIT bytes or more, else null.

    A first pass groups digests alone. The payloads that occur more than once are counted: up to ``broadcast_rows`` of them are sent to
    every task and no page is shuffled; beyond that, pages meet them in an ordinary join, whose large partitions can be split.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn("sha1", F.sha1("html"))
    long = rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("sha1").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1")
    long = settle(long.select("sha1", "largest"), "copied")
    few = long.limit(broadcast_rows + 1).count() <= broadcast_rows
    joined = rows.join(F.broadcast(long) if few else long.hint("merge"), "sha1", "left")
    refers = F.when((F.octet_length("html") >= MIN_REVISIT) & (F.col("page_id") < F.col("largest")), F.col("largest"))
    return joined.select("page_id", "url", "html", "sha1", refers.alias("refers_to"))


def write(pages: DataFrame, target: str) -> DataFrame:
    """Write packages to the folder target; returns name, records of each (settled: the packages are there)."""
    return settle(with_references(pages).mapInArrow(_write(target), "name string, records long"), "packages")


def _ranges(target: str, records: int):
    """Index lines of packages, in runs of so many consecutive records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(target)
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_file(f"{base}/{name}") as f:
                    members = {m.name: m for m in directory(f)}
                    f.seek(data_start(f, members[INDEX]))
                    lines = [tuple(map(int, x.split())) for x in f.read(members[INDEX].size).splitlines()]
                    at = data_start(f, members[ARCHIVE])
                runs = [lines[k : k + records] for k in range(0, len(lines), records)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(runs), pa.string()), pa.array([[at + x[1] for x in r] for r in runs], pa.list_(pa.int64())), pa.array([[x[2] for x in r] for r in runs], pa.list_(pa.int64()))], ["name", "offsets", "sizes"])

    return run


def read(packages: DataFrame, target: str, fold, schema: str, records: int = RANGES) -> DataFrame:
    """fold(iterator of Record) -> record batches, over every record of the packages, each taken by its own range."""
    ranges = packages.select("name").mapInArrow(_ranges(target, records), "name string, offsets array<long>, sizes array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(target)

        def each() -> Iterator[Record]:
            for b in batches:
                for name, offsets, sizes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    with store.open_input_file(f"{base}/{name}") as f:
                        for at, size in zip(offsets, sizes, strict=True):
                            f.seek(at)
                            yield parse(f.read(size))

        yield from fold(each())

    return ranges.mapInArrow(run, schema)


FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(uri: str | None) -> int | None:
    last = uri.strip("<>").rpartition(":")[2] if uri else "None"
    return None if last == "None" else int(last)


def summaries(records: Iterator[Record]) -> Iterator[pa.RecordBatch]:
    """Per record what it says; a response's payload is digested anew and must agree with its header."""
    rows: list[tuple] = []
    names, types = zip(*(x.split(" ") for x in FOUND.split(", ")), strict=True)
    kinds = [{"long": pa.int64(), "string": pa.string()}[t] for t in types]

    def out() -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], list(names))

    for r in records:
        said = base64.b32decode(r.headers["warc-payload-digest"].partition(":")[2]).hex()
        if r.headers["warc-type"] == "response" and hashlib.sha1(r.payload).hexdigest() != said:
            raise ValueError(f"digest of {r.headers['warc-record-id']} differs")
        rows.append((_page(r.headers["warc-record-id"]), int(r.http["content-length"]), said, r.headers["warc-type"], _page(r.headers.get("warc-refers-to"))))
        if len(rows) >= 10_000:
            yield out()
            rows.clear()
    yield out()


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = new_path(spark, "packages")
    packages = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), target)
    return read(packages, target, summaries, FOUND)
