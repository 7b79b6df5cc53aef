"""Directory trees, in-memory texts and tables as documents with roles.

A document has path, name, leaf (its folder), text, and the roles is_test, is_ref and is_boilerplate. Files are listed on the driver
(hidden and underscore names included, which Spark's own listing leaves out) and read by the executors; files whose
bytes are no text of the codec go to a quarantine instead.
"""

from __future__ import annotations

import codecs
import logging
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions.text import path_name, path_parent

log = logging.getLogger("windrow")
FILE_SCHEMA = "path string, is_test boolean, is_ref boolean, is_boilerplate boolean"
ROLES = {"testref": ("is_test", "is_ref"), "test": ("is_test",), "ref": ("is_ref",), "boilerplate": ("is_boilerplate",)}


def list_files(roots: Iterable[str], extensions: Iterable[str]) -> tuple[list[str], list[str]]:
    """Sorted distinct regular files below the roots with one of the extensions ("*": all), and roots without any."""
    ends = [e if e == "*" else "." + e.lstrip(".") for e in extensions]
    found: set[str] = set()
    bare = []
    for root in roots:
        here = {os.path.join(d, f) for d, _, files in os.walk(root) for f in files if any(e == "*" or f.endswith(e) for e in ends)}
        here = {f for f in here if os.path.isfile(f)}
        if not here:
            bare.append(root)
            log.warning("No files found in %s", root)
        found |= here
    return sorted(found), bare


def file_table(spark: SparkSession, test: Iterable[str], ref: Iterable[str], boilerplate: Iterable[str]) -> DataFrame:
    """One row a path with its roles."""
    test, ref, boilerplate = set(test), set(ref), set(boilerplate)
    rows = [(p, p in test, p in ref, p in boilerplate) for p in sorted(test | ref | boilerplate)]
    return spark.createDataFrame(rows, FILE_SCHEMA)


def add_file(files: DataFrame, path: str, role: str) -> DataFrame:
    """files with one more path, or more roles for a known one."""
    if role not in ROLES:
        raise ValueError(f"role must be one of {', '.join(ROLES)}")
    row = files.sparkSession.createDataFrame([(path, *(r in ROLES[role] for r in ("is_test", "is_ref", "is_boilerplate")))], FILE_SCHEMA)
    return files.unionByName(row).groupBy("path").agg(*(F.max(r).alias(r) for r in ("is_test", "is_ref", "is_boilerplate")))


def decode(data: bytes, encoding: str) -> tuple[str | None, str | None]:
    """(text, None) or (None, why not). DETECT tries byte-order marks, UTF-8 and Latin-1. Line ends become newlines."""
    try:
        if encoding.upper() == "DETECT":
            for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
                if data.startswith(mark):
                    text = data.decode(name)
                    break
            else:
                try:
                    text = data.decode("utf-8")
                except UnicodeDecodeError:
                    text = data.decode("latin-1")
        else:
            text = data.decode(encoding)
    except UnicodeDecodeError as e:
        return None, str(e)
    return text.replace("\r\n", "\n").replace("\r", "\n"), None


def decoded(files: DataFrame, encoding: str, data_col: str = "content") -> DataFrame:
    """files (any columns, binary content) with text and problem; the content stays out."""
    fields = [f for f in files.schema.fields if f.name not in (data_col, "text", "problem")]
    names = [f.name for f in fields]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "text string, problem string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [decode(x or b"", encoding) for x in batch.column(data_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([t for t, _ in done], pa.string()), pa.array([p for _, p in done], pa.string())], [*names, "text", "problem"])

    return files.select(*names, data_col).mapInArrow(run, schema)


def read_files(files: DataFrame, encoding: str = "utf-8") -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine): contents are read where the tasks run."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                with open(one.column("path")[0].as_py(), "rb") as f:
                    yield pa.RecordBatch.from_arrays([*one.columns, pa.array([f.read()], pa.binary())], [*one.schema.names, "content"])

    texts = decoded(files.mapInArrow(load, FILE_SCHEMA + ", content binary"), encoding)
    good = texts.where("problem is null").select("path", path_name(F.col("path")).alias("name"), path_parent(F.col("path")).alias("leaf"), "text", "is_test", "is_ref", "is_boilerplate")
    return good, texts.where("problem is not null").select("path", "problem")


def from_texts(spark: SparkSession, texts: Iterable[tuple[str, str]], role: str = "testref") -> DataFrame:
    """Documents from (path, text) pairs in memory."""
    flags = [r in ROLES[role] for r in ("is_test", "is_ref", "is_boilerplate")]
    rows = spark.createDataFrame([(p, t, *flags) for p, t in texts], "path string, text string, is_test boolean, is_ref boolean, is_boilerplate boolean")
    return rows.select("path", path_name(F.col("path")).alias("name"), path_parent(F.col("path")).alias("leaf"), "text", "is_test", "is_ref", "is_boilerplate")


def from_table(table: DataFrame, id_col: str, text_col: str = "text", name_col: str | None = None, leaf_col: str | None = None, role: str = "testref") -> DataFrame:
    """Documents from a table's columns."""
    flags = [F.lit(r in ROLES[role]).alias(r) for r in ("is_test", "is_ref", "is_boilerplate")]
    none = F.lit(None).cast("string")
    return table.select(
        F.col(id_col).cast("string").alias("path"), (F.col(name_col).cast("string") if name_col else none).alias("name"),
        (F.col(leaf_col).cast("string") if leaf_col else none).alias("leaf"), F.col(text_col).alias("text"), *flags)
