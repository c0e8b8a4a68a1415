"""WARC archives as a Spark data source written in Python, with deduplicated payloads."""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition,
                                    IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage)
from pyspark.sql.types import StructType

from .storage import kept, new_path

SCHEMA = "record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary"
SPLIT_BYTES = 64 << 20
LEAST_BYTES = 100
_MAGIC = b"\x1f\x8b\x08\x04"
_HEADERS = {"record_type": "warc-type", "page_id": "x-page-id", "url": "warc-target-uri", "refers_to": "x-refers-to-page",
            "payload_bytes": "x-payload-length", "payload_digest": "warc-payload-digest"}
_NUMBERS = ("page_id", "refers_to", "payload_bytes")


def _safe(value: object) -> str:
    """A header's value on one line."""
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict) -> bytes:
    """One record as a gzip member of its own.

    The member's extra field ("sl") holds its compressed and plain length, so that a reader may
    pass over it after the headers. A revisit has the headers of its payload but no payload.
    """
    payload = row["payload"] or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_safe(row['url'])}")
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if row["refers_to"] is not None:
        lines += [f"X-Refers-To-Page: {row['refers_to']}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(http) + len(payload)}"]
    plain = "\r\n".join(lines).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(plain) + pack.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return (_MAGIC + b"\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(plain)) + body
            + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF))


class _Member:
    """A gzip member that is inflated only as far as it is asked for."""

    def __init__(self, file, at: int, size: int) -> None:
        self.file, self.at, self.end = file, at, at + size - 8
        self.inflate, self.plain = zlib.decompressobj(-15), bytearray()
        self.at += 24

    def until(self, stop: bytes) -> int:
        while (k := self.plain.find(stop)) < 0:
            if not self._more(4096):
                raise ValueError("a record without an end of its headers")
        return k

    def rest(self) -> bytearray:
        while self._more(1 << 20):
            pass
        return self.plain

    def _more(self, n: int) -> bool:
        n = min(n, self.end - self.at)
        if n <= 0:
            return False
        self.plain += self.inflate.decompress(self.file.read_at(n, self.at))
        self.at += n
        return True


def _size_at(file, at: int) -> int:
    """The size of the member that begins at ``at``, 0 if none does."""
    head = file.read_at(24, at)
    if len(head) < 24 or head[:4] != _MAGIC or head[12:14] != b"sl":
        return 0
    return struct.unpack("<I", head[16:20])[0]


def _first_member(file, start: int, end: int) -> int:
    """The first member that begins in [start, end), or ``end``: a member's length must lead to the next or to the end."""
    total, at, held = file.size(), start, b""
    while at < end:
        held = file.read_at(min(1 << 20, total - at), at)
        k = held.find(_MAGIC)
        while k >= 0 and at + k < end:
            size = _size_at(file, at + k)
            if size and (at + k + size == total or _size_at(file, at + k + size)):
                member = _Member(file, at + k, size)
                try:
                    while len(member.plain) < 5 and member._more(256):
                        pass
                    if member.plain.startswith(b"WARC/"):
                        return at + k
                except zlib.error:
                    pass
            k = held.find(_MAGIC, k + 1)
        at += max(1, len(held) - 3)
    return end


def _parsed(head: bytes | bytearray) -> dict[str, object]:
    raw = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        raw[name.strip().lower()] = value.strip()
    row = {column: raw.get(header) for column, header in _HEADERS.items()}
    for column in _NUMBERS:
        row[column] = int(row[column]) if row[column] is not None else None
    row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha256:") or None
    return row


_TESTS = {EqualTo: lambda x, y: x == y, In: lambda x, y: x in y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y,
          LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y, StringStartsWith: lambda x, y: x.startswith(y)}


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    """Ranges of files; predicates on headers are tested before a payload is inflated."""

    def __init__(self, path: str, split: int, payload: bool) -> None:
        self.path, self.split, self.payload = path, split, payload
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _HEADERS and type(f) in _TESTS:
                self.tests.append((column, type(f).__name__, f.value))
            elif column in _HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, "IsNotNull", None))
            else:
                yield f

    def _wanted(self, row: dict) -> bool:
        by_name = {t.__name__: test for t, test in _TESTS.items()}
        return all(row[c] is not None and (name == "IsNotNull" or by_name[name](row[c], value)) for c, name, value in self.tests)

    def partitions(self) -> list[InputPartition]:
        system, local = fs.FileSystem.from_uri(self.path)
        out = []
        with system.open_input_stream(f"{local}/_FILES") as index:
            names = [n for n in index.read().decode().split("\n") if n]
        for name in names:
            size = system.get_file_info(f"{local}/{name}").size
            out += [_Range(f"{self.path}/{name}", a, min(size, a + self.split)) for a in range(0, size, self.split)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, local = fs.FileSystem.from_uri(partition.path)
        file = system.open_input_file(local)
        at, held, size = _first_member(file, partition.start, partition.end), [], 0
        while at < partition.end:
            length = _size_at(file, at)
            if not length:
                raise ValueError(f"no record at {at} of {partition.path}")
            member = _Member(file, at, length)
            cut = member.until(b"\r\n\r\n")
            row = _parsed(member.plain[:cut])
            at += length
            if not self._wanted(row):
                continue
            row["payload"] = None
            if self.payload and row["record_type"] == "response":
                body = member.rest()
                row["payload"] = bytes(memoryview(body)[body.index(b"\r\n\r\n", cut + 4) + 4:-4])
                size += len(row["payload"])
            held.append(row)
            if len(held) >= 4096 or size >= 8 << 20:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)


_ARROW = pa.schema([("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()),
                    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


@dataclass
class _Written(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceArrowWriter):
    """A file per task under a name of its own; the list of files is written once all tasks are done."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, local = fs.FileSystem.from_uri(self.path)
        name, out = "", io.BytesIO()
        file = None
        for batch in iterator:
            for row in batch.to_pylist():
                if file is None:
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    system.create_dir(local, recursive=True)
                    file = system.open_output_stream(f"{local}/{name}", compression=None)
                out.write(record(row))
                if out.tell() >= 1 << 20:
                    file.write(out.getvalue())
                    out = io.BytesIO()
        if file is not None:
            file.write(out.getvalue())
            file.close()
        return _Written(name)

    def commit(self, messages) -> None:
        system, local = fs.FileSystem.from_uri(self.path)
        system.create_dir(local, recursive=True)
        with system.open_output_stream(f"{local}/_FILES") as out:
            out.write("\n".join(sorted(m.name for m in messages if m and m.name)).encode())

    def abort(self, messages) -> None:
        system, local = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{local}/{m.name}")


class WarcSource(DataSource):
    """``warc``: options path, split (bytes of a partition), payload (``false`` reads headers only)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"].rstrip("/"), int(self.options.get("split", SPLIT_BYTES)), self.options.get("payload", "true") != "false")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"].rstrip("/"))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    """Archive every row of ``pages`` (page_id, url, html); the payload is the html in UTF-8, none for null.

    Of equal payloads of ``least`` bytes or more the smallest page_id is the response, pages of larger ids
    revisit it. Rows that share the smallest id are all responses, and so are rows of a null id.
    Payloads are compared by SHA-256. The first page of each digest comes from an aggregate; only
    digests of several pages are kept, as a table of known size, and joined back. Payloads are
    shuffled only where that table is too large to be sent to all. Other columns are not archived.
    """
    spark = pages.sparkSession
    register(spark)
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    firsts = (rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
              .where(F.col("first") < F.col("last")).drop("last"))
    firsts = kept(firsts, "firsts")  # of known size: joined without moving the payloads where it is small
    again = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    out = rows.join(firsts, "payload_digest", "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), "page_id", "url", F.when(again, F.col("first")).alias("refers_to"),
        "payload_bytes", "payload_digest", F.when(~again, F.col("payload")).alias("payload"))
    out.write.format("warc").option("path", path).mode("append").save()


def read(spark: SparkSession, path: str, payload: bool = True, split: int = SPLIT_BYTES) -> DataFrame:
    """The records of an archive folder. Filters on header columns are pushed down to the reader."""
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).option("split", split).load()


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as read back from its archive.

    Two scans of the source, each with its record type pushed down: responses with their payloads, from which length and
    digest are computed, and revisits from headers alone, so that no payload is inflated for them and none of the other
    scan's records goes beyond its headers. An empty table makes an archive without records.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    responses = read(spark, path).where("record_type = 'response'").select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")
    revisits = read(spark, path, payload=False).where("record_type = 'revisit'")
    return responses.unionByName(revisits.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
