"""Web archives: WARC records in ZIP packages, written once and read by byte ranges.

A package is a ZIP file with stored members: archive/data.warc.gz (one gzip member for each record) and
indexes/index.cdxj (one line for each record: offset and length in the archive). The reader parses the end
record, the ZIP64 end record and the central directory, finds where a stored member's bytes lie, reads the
index alone, and then fetches ranges of records from inside the package without unpacking it.

Packages lie under spark.checkpoint.dir and are opened by pyarrow's file systems, so any store that those
know will do. A task writes to a name of its own attempt and moves the finished file to its final name, so
a repeated task leaves one package.

Records with equal payloads of at least `least` bytes: the one of the largest page_id is the response, the
others are revisits that name it and carry its digest and length in place of the payload.

Defined results: a null html is an empty payload; rows that share a payload's largest page_id are all responses;
a null page_id is smaller than any other (a group without any id has responses only); an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, over_tasks, shared_dir, staged, table
from .components import join_hot

LEAST, PACKAGE_BYTES, RANGE_BYTES = 1000, 64 << 20, 4 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
NONE = -(1 << 63)
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


# Writing


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; refers_to makes it a revisit without payload."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        *([f"WARC-Target-URI: {json.dumps(url)[1:-1]}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        f"Content-Length: {0 if revisit else len(payload)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


class Package:
    """A ZIP package that is being written, one record after another."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        self.zip = zipfile.ZipFile(_Stream(self.out), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, data: bytes) -> None:
        packed = gzip.compress(data, 3, mtime=0)
        self.lines.append(f'{{"offset": {self.size}, "length": {len(packed)}}}')
        self.member.write(packed)
        self.size += len(packed)

    def close(self) -> None:
        self.member.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as f:
            f.write("\n".join(self.lines).encode())
        self.zip.close()
        self.out.close()
        self.fs.move(self.part, self.path)


class _Stream:
    """What zipfile needs of a stream that cannot seek."""

    def __init__(self, out):
        self.out = out

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


def _writer(root: str, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, names, package, done = TaskContext.get().partitionId(), "page_id url payload digest refers_to".split(), None, []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if package is None:
                    uri = f"{root}/{task:06d}-{len(done):04d}.wacz"
                    package = Package(uri)
                package.add(record(*row))
                if package.size >= limit:
                    package.close()
                    done.append(uri)
                    package = None
        if package is not None:
            package.close()
            done.append(uri)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["package"])

    return run


def write_packages(pages: DataFrame, root: str, least: int = LEAST, limit: int = PACKAGE_BYTES) -> DataFrame:
    """Writes every row of pages as a record; the packages' names, as a table.

    What decides about revisits is shuffled without the pages: digests first, then the few digests that
    stand in several pages are joined to the pages.
    """
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # Digests that stand once cannot matter; those that do get the id of their response.
    groups = rows.filter(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    groups = staged(groups.filter("n > 1 and response is not null"), "groups")
    joined = join_hot(rows, groups, "digest", pages.count())
    other = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    records = joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("response")).alias("refers_to"))
    return staged(records.mapInArrow(_writer(root, limit), "package string"), "packages")


# Reading


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """(local header's offset, stored size) of each stored member, from the central directory."""
    tail_at = max(0, size - 65557)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file: no end record")
    count, length, start = struct.unpack_from("<10xHII", tail, end)
    locator = tail.rfind(b"PK\x06\x07", 0, end)
    if locator >= 0 and locator == end - 20:
        (at,) = struct.unpack_from("<8xQ", tail, locator)
        f.seek(at)
        head = f.read(56)
        if head[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is not where its locator says")
        count, length, start = struct.unpack_from("<32xQQQ", head)
    f.seek(start)
    directory, at, out = f.read(length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method, packed, full, name_n, extra_n, note_n, offset = struct.unpack_from("<10xH8xIIHHH8xI", directory, at)
        name = directory[at + 46 : at + 46 + name_n].decode("utf-8", "replace")
        extra, k = directory[at + 46 + name_n : at + 46 + name_n + extra_n], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # ZIP64: the values that did not fit, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                offset = next(values) if offset == 0xFFFFFFFF else offset
            k += 4 + n
        if method == 0:
            out[name] = (offset, packed)
        at += 46 + name_n + extra_n + note_n
    return out


def data_start(f, offset: int) -> int:
    """Where the member's bytes begin, after its local header."""
    f.seek(offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("a local header is not where the directory says")
    return offset + 30 + sum(struct.unpack_from("<HH", head, 26))


def _ranges(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbouring records of a package, about `most` bytes together."""
        for b in batches:
            out = []
            for uri in b.column("package").to_pylist():
                fs, path = file_system(uri)
                with fs.open_input_file(path) as f:
                    found = members(f, f.size())
                    base = data_start(f, found[ARCHIVE][0])
                    f.seek(data_start(f, found[INDEX][0]))
                    lengths, start, size = [], None, 0
                    for line in f.read(found[INDEX][1]).splitlines():
                        entry = json.loads(line)
                        if start is None:
                            start = base + entry["offset"]
                        lengths.append(entry["length"])
                        size += entry["length"]
                        if size >= most:
                            out.append((uri, start, lengths))
                            lengths, start, size = [], None, 0
                    if lengths:
                        out.append((uri, start, lengths))
            columns = zip(*out, strict=True) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["package", "start", "lengths"])

    return run


def parse(data: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    body = rest[: int(fields["Content-Length"])]
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").rstrip(">")) else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
        raise ValueError("a payload differs from its digest")
    url = json.loads(f'"{fields["WARC-Target-URI"]}"') if "WARC-Target-URI" in fields else None
    return number("WARC-Record-ID"), url, kind, number("WARC-Refers-To"), int(fields["Payload-Length"]), digest, body if kind == "response" else None


def _reader(with_payload: bool) -> Callable:
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start, lengths in zip(*(b.column(c).to_pylist() for c in ("package", "start", "lengths")), strict=True):
                fs, path = file_system(uri)
                with fs.open_input_file(path) as f:
                    f.seek(start)
                    data, at, out = f.read(sum(lengths)), 0, []
                for n in lengths:
                    row = parse(zlib.decompress(data[at : at + n], 31))
                    out.append(row if with_payload else (*row[:6], None))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def read_packages(packages: DataFrame, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the packages named in the column package; directories, and then ranges, are dealt over tasks before any is read."""
    n = packages.count()
    ranges = over_tasks(packages.select("package"), n * range_bytes, n).mapInArrow(_ranges(range_bytes), "package string, start long, lengths array<long>")
    ranges = staged(ranges, "ranges")
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda t, x: t + x)
    total = ranges.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return over_tasks(ranges, total["size"], total["n"]).mapInArrow(_reader(with_payload), READ)


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/quillstone/{uuid.uuid4().hex}/packages"
    packages = write_packages(table(spark, sf_dir, "pages"), root)
    return read_packages(packages, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op2_warc_zip": op2_warc_zip}
ORACLES: dict[str, str] = {
    # DuckDB's sha1 is over the same UTF-8 bytes.
    "op2_warc_zip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g"""
}
