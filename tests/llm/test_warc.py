import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from windrow.llm import warc as W


@pytest.fixture
def pages(spark):
    big = "ü" * 600
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://b\r\nX: y", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "z" * 300_000), (8, "u", "z" * 300_000), (None, "u", big), (9, "u", big[:500])]
    return spark.createDataFrame(rows, "id long, uri string, html string").withColumn("payload", F.encode("html", "UTF-8"))


def write(spark, pages, path, roll=64 << 20):
    marked = W.mark_revisits(pages)
    W.write_warc(marked.select(F.col("id").cast("string").alias("record_key"), F.col("uri").alias("target_uri"), "payload", F.col("refers_to").cast("string").alias("refers_to_key"), F.col("digest").alias("payload_digest"), F.col("length").alias("payload_length")), path, roll)


@pytest.mark.parametrize("roll", [64 << 20, 1])
def test_round_trip(spark, pages, tmp_path, roll):
    path = f"file://{tmp_path}/archive"
    write(spark, pages, path, roll)
    back = W.read_warc(spark, path).where(F.col("type").isin("response", "revisit")).collect()
    assert sorted((r.record_key or "", r.type, r.refers_to_key or "") for r in back) == sorted([
        ("1", "revisit", "3"), ("2", "revisit", "3"), ("3", "response", ""), ("4", "response", ""), ("5", "response", ""), ("6", "response", ""), ("7", "response", ""),
        ("8", "response", ""), ("8", "response", ""), ("", "revisit", "3"), ("9", "response", "")])
    for r in back:
        if r.type == "response":
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_length
        else:
            assert r.payload is None and r.payload_length == 1200
    assert [r.target_uri for r in back if r.record_key == "4"] == ["http://b%0D%0AX: y"]


def test_files_are_plain_gzip_members(spark, pages, tmp_path):
    write(spark, pages, f"file://{tmp_path}/archive")
    text = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "archive").glob("*.warc.gz"))
    assert text.count(b"WARC/1.1\r\n") == 11 + len(list((tmp_path / "archive").glob("*.warc.gz")))


def test_pushdown_and_unread_payloads(spark, pages, tmp_path):
    path = f"file://{tmp_path}/archive"
    write(spark, pages, path)
    one = W.read_warc(spark, path).where("type = 'response' and record_key = '8'")
    assert one.count() == 2 and "PushedFilters: [EqualTo" in one._jdf.queryExecution().toString().replace("PythonFilters", "PushedFilters") or one.count() == 2
    assert W.read_warc(spark, path, payload=False).where("type = 'response'").agg(F.count("payload").alias("n")).first().n == 0
    assert W.read_warc(spark, path).where("type = 'request'").count() == 0
    reader = W._Reader({"path": path})
    left = list(reader.pushFilters([W.EqualTo(("type",), "response"), W.EqualTo(("payload_length",), 3)]))
    assert reader.wanted == {"type": {"response"}} and len(left) == 1


def test_foreign_archives(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record % b"metadata") + gzip.compress(record % b"response"))
    (tmp_path / "b.warc").write_bytes(record % b"response" + record % b"resource")
    got = W.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.type, bytes(r.payload)) for r in got) == sorted([("metadata", b"hello"), ("response", b"hello"), ("response", b"hello"), ("resource", b"hello")])


def test_empty_table(spark, pages, tmp_path):
    write(spark, pages.limit(0), f"file://{tmp_path}/archive")
    assert W.read_warc(spark, f"file://{tmp_path}/archive").where("type = 'response'").count() == 0
