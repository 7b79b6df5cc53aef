"""WARC 1.1 archives as a Spark data source: `spark.read.format("windrow_warc")` and `df.write.format("windrow_warc")`.

Reading: one partition a file (writers roll files at `roll_bytes`); filters on `type` and equality filters on
`target_uri` and `record_id` are pushed down; a record's header is parsed first, and the payload of an unwanted record
is skipped by a seek over its gzip member, whose length stands in the member's extra field `sl`. Members without that
field are read through. Option payload=false leaves payloads undecoded for all records.

Writing: each task writes files under names of its own, and the driver's commit writes `_manifest.json` with those of
the successful tasks; readers follow the manifest, so files of lost or repeated attempts are never seen.

Paths go through pyarrow's file systems (file:, hdfs:, s3:, ...), on executors and driver alike.

Null payloads are empty. Control characters in header values are percent-encoded. Records of a null id have no
X-Record-Key header. Empty tables make an archive without files and read back as no rows.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from windrow.llm.common import new_path, read, stored

READ_SCHEMA = (
    "type string, record_id string, target_uri string, date string, content_type string, record_key string, refers_to_key string, "
    "payload_digest string, payload_length long, payload binary"
)
WRITE_SCHEMA = "record_key string, target_uri string, payload binary, refers_to_key string, payload_digest string, payload_length long"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_FIXED_DATE = "1970-01-01T00:00:00Z"


def _fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (pyarrow.fs.LocalFileSystem(), path)


def _plain(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: quote(m[0]), value)


def _id(key: str) -> str:
    return f"<urn:x-record:{quote(key, safe='-')}>"


def gzip_member(data: bytes) -> bytes:
    """One gzip member whose extra field `sl` has its own length and that of the data."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    length = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, length, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, key: str | None, uri: str | None, payload: bytes, refers_to: str | None, digest: str, length: int, date: str = _FIXED_DATE) -> bytes:
    """One response or revisit record; a revisit keeps the HTTP header and leaves the payload out."""
    block = _HTTP + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(key) if key is not None else f'<urn:uuid:{uuid.uuid4()}>'}", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_plain(uri)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    head.append(f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}")
    head.append(f"X-Payload-Length: {length}")
    if key is not None:
        head.append(f"X-Record-Key: {_plain(key)}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}", f"X-Refers-To-Key: {_plain(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class _Done(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, roll_bytes: int):
        self.path, self.roll_bytes = path, roll_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        files: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for row in range(batch.num_rows):
                    key, uri, payload, refers, digest, length = (batch.column(c)[row].as_py() for c in ("record_key", "target_uri", "payload", "refers_to_key", "payload_digest", "payload_length"))
                    if out is None or size >= self.roll_bytes:
                        if out is not None:
                            out.close()
                        files.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                        first = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {_FIXED_DATE}\r\nWARC-Filename: {files[-1]}\r\nContent-Type: application/warc-fields\r\nContent-Length: 23\r\n\r\nformat: WARC File 1.1\r\n\r\n\r\n"
                        out.write(gzip_member(first.encode()))
                    data = gzip_member(record("response" if refers is None else "revisit", key, uri, payload or b"", refers, digest, length))
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return _Done(files)

    def commit(self, messages: list) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_manifest.json", compression=None) as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())

    def abort(self, messages: list) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            for f in m.files if m else ():
                if fs.get_file_info(f"{root}/{f}").type != pyarrow.fs.FileType.NotFound:
                    fs.delete_file(f"{root}/{f}")


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.wanted: dict[str, set[str]] = {}
        if options.get("types"):
            self.wanted["type"] = set(options["types"].split(","))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if isinstance(f, (EqualTo, In)) and column in ("type", "target_uri", "record_id", "record_key"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            elif not (isinstance(f, IsNotNull) and column == "type"):
                yield f

    def partitions(self) -> list[_File]:
        fs, root = _fs(self.path)
        manifest = f"{root}/_manifest.json"
        if fs.get_file_info(manifest).type == pyarrow.fs.FileType.File:
            with fs.open_input_stream(manifest, compression=None) as f:
                return [_File(f"{self.path}/{x}") for x in json.loads(f.read())]
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        return [_File(self.path + x.path[len(root) :]) for x in found if re.search(r"\.warc(\.gz)?$", x.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not isinstance(partition, _File):
            return
        fs, path = _fs(partition.path)
        with fs.open_input_file(path) as f:
            for head, body in (_gzip_records if path.endswith(".gz") else _plain_records)(f, f.size()):
                if any(head.get(_HEADERS[c]) not in v for c, v in self.wanted.items()):
                    continue
                payload = None
                if self.payload:
                    payload = body()
                    if "application/http" in head.get("content-type", ""):
                        payload = payload.partition(b"\r\n\r\n")[2]
                    if head.get("warc-type") == "revisit":
                        payload = None
                digest = head.get("warc-payload-digest", "")
                if re.fullmatch(r"sha1:[A-Z2-7]{32}", digest):
                    digest = base64.b32decode(digest[5:]).hex()
                length = head.get("x-payload-length")
                yield (
                    head.get("warc-type"), head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), head.get("content-type"),
                    head.get("x-record-key"), head.get("x-refers-to-key"), digest or None, int(length) if length else None, payload,
                )


_HEADERS = {"type": "warc-type", "target_uri": "warc-target-uri", "record_id": "warc-record-id", "record_key": "x-record-key"}
_FIRST = 4096


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _gzip_records(f, size: int) -> Iterator[tuple]:
    """(header, a function for the block) of each record; only what the header needs is inflated before it is asked for."""
    at = 0
    while at < size:
        f.seek(at)
        start = f.read(_FIRST)
        known = struct.unpack("<I", start[16:20])[0] if start[3:4] == b"\x04" and start[12:14] == b"sl" else 0
        unpack = zlib.decompressobj(31)
        data = unpack.decompress(start)
        while b"\r\n\r\n" not in data and not unpack.eof and (more := f.read(_FIRST)):
            data += unpack.decompress(more)
        head, _, rest = data.partition(b"\r\n\r\n")
        parsed, place = _parse(head), f.tell()

        def body(rest=rest, unpack=unpack, place=place, at=at, known=known, length=int(parsed.get("content-length", 0))) -> bytes:
            if not unpack.eof:
                f.seek(place)
                got = [rest, unpack.decompress(f.read(at + known - place))] if known > place - at else [rest]
                while not unpack.eof and (more := f.read(1 << 16)):
                    got.append(unpack.decompress(more))
                rest = b"".join(got)
            return rest[:length]

        yield parsed, body
        if known:
            at += known
        else:
            f.seek(place)
            while not unpack.eof and (more := f.read(1 << 16)):
                unpack.decompress(more)
            at = f.tell() - len(unpack.unused_data)


def _plain_records(f, size: int) -> Iterator[tuple]:
    at = 0
    while at < size:
        f.seek(at)
        data = f.read(_FIRST)
        while b"\r\n\r\n" not in data and (more := f.read(_FIRST)):
            data += more
        head = data.partition(b"\r\n\r\n")[0]
        parsed = _parse(head)
        begin, length = at + len(head) + 4, int(parsed.get("content-length", 0))

        def body(begin=begin, length=length) -> bytes:
            f.seek(begin)
            return f.read(length)

        yield parsed, body
        at = begin + length + 4


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "windrow_warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("roll_bytes", 64 << 20)))


def _registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    return _registered(spark).read.format("windrow_warc").option("payload", str(payload).lower()).load(path)


def write_warc(records: DataFrame, path: str, roll_bytes: int = 64 << 20) -> None:
    """records: WRITE_SCHEMA's columns; rows with refers_to_key become revisits."""
    _registered(records.sparkSession)
    records.select("record_key", "target_uri", "payload", "refers_to_key", "payload_digest", "payload_length").write.format("windrow_warc").option("path", path).option("roll_bytes", roll_bytes).mode("append").save()


def mark_revisits(pages: DataFrame, min_bytes: int = 1000, broadcast_rows: int = 100_000) -> DataFrame:
    """(id, uri, payload) rows with digest, length and, for later copies of large payloads, the id that they refer to.

    The copy with the largest id stays a response; equal rows of that id all do. Groups without an id have no revisits.
    Only digests that occur twice are joined back: broadcast if they are at most broadcast_rows, else by a shuffle.
    """
    sized = pages.select("id", "uri", F.coalesce("payload", F.lit(b"")).alias("payload"))
    sized = sized.withColumns({"digest": F.sha1("payload"), "length": F.octet_length("payload").cast("long")})
    groups = stored(sized.where(F.col("length") >= min_bytes).groupBy("digest").agg(F.max("id").alias("newest"), F.count("*").alias("n")).where("n > 1 and newest is not null").select("digest", "newest"), "warc")
    groups = F.broadcast(groups) if groups.count() <= broadcast_rows else groups
    return sized.join(groups, "digest", "left").withColumn("refers_to", F.when(F.col("id").isNull() | (F.col("id") < F.col("newest")), F.col("newest"))).drop("newest")


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("id"), F.col("url").alias("uri"), F.encode(F.col("html"), "UTF-8").alias("payload"))
    path = new_path(spark, "archive")
    write_warc(mark_revisits(pages).select(F.col("id").cast("string").alias("record_key"), F.col("uri").alias("target_uri"), "payload", F.col("refers_to").cast("string").alias("refers_to_key"), F.col("digest").alias("payload_digest"), F.col("length").alias("payload_length")), path)
    back = read_warc(spark, path).where(F.col("type").isin("response", "revisit"))
    response = F.col("type") == "response"
    return back.select(
        F.col("record_key").cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to_key").cast("long").alias("refers_to"),
    )


OP3_SQL = """
WITH sized AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), marked AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM sized)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN newest END AS refers_to
FROM marked
"""
