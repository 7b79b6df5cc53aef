"""Shared pieces of the corpus operators: durable intermediate tables, byte-level word hashing, connected components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 500_000


# ---------------------------------------------------------------- tables

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes that Spark hands a Python worker at once, in this session; smaller settings stay."""
    for name, most in (("maxRecordsPerBatch", 2_000), ("maxBytesPerBatch", 4_000_000)):
        key = f"spark.sql.execution.arrow.{name}"
        now = str(spark.conf.get(key, None))
        if not re.fullmatch("[0-9]+", now) or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a session on one machine (tests) that names none gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master or 'the cluster'} share")
        found = f"file://{tempfile.mkdtemp(prefix='windrow-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(_remove, found.removeprefix("file://"))
    return found


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/windrow-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    rows: about how many there are, where that is known; a small table then gets few files.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // 200_000)
    path = new_path(spark, label)
    df.write.option("compression", "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes a table that stored() wrote, once nothing lazy reads it any more."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps: it does so once the driver's objects for them are collected."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(name: str, taken: list[str]) -> str:
    """A column name like `name` that none of `taken` has, whatever their case."""
    low = {x.lower() for x in taken}
    while name in low:
        name += "_"
    return name


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


# ---------------------------------------------------------------- arrow batches

def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, giving freed memory back to the system when a task ends: an idle worker then holds little."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def trim() -> None:
    """Returns freed memory of this process to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of whole rows with about `limit` bytes of text, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = text_buffers(batch.column(column))[1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
            stop = max(start + 1, min(stop, batch.num_rows))
            yield batch.slice(start, stop - start)
            start = stop


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off.astype(np.int64) - int(off[0])


# ---------------------------------------------------------------- hashing

_WRAP = 64
_UP = np.cumprod(np.full(_WRAP, 0x9E3779B97F4A7C15 | 5, np.uint64), dtype=np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit."""
    x = x + np.uint64(seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(1, 257, dtype=np.uint64), 17)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ([^ \\t-\\r]+, A-Z lower-cased) of all rows, and the n+1 offsets of each row's words.

    A word's hash adds up a code for each byte, weighted by its place in the word, so no string is made.
    keep: bytes outside this table of 256 flags also part words.
    """
    n_rows = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    inside = ~_SPACE[raw] if keep is None else keep[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    begins[heads] |= inside[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    own = np.flatnonzero(inside)
    first = np.searchsorted(own, starts)
    lengths = np.diff(np.append(first, len(own)))
    place = np.arange(len(own)) - np.repeat(first, lengths)
    terms = _CODES[_LOWER[raw[own]]] * _UP[place % _WRAP]
    if lengths.max() > _WRAP:
        terms *= (2 * (place // _WRAP) + 1).astype(np.uint64)
    hashes = mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(16)]


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order; of the whole sequence where there are fewer (none without words)."""
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * _STEP[i]
    return mix(total, 3)


# ---------------------------------------------------------------- components

def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(a, b) links of ids to (id, component): the smallest id reachable, for every id with a link.

    Alternating large-star and small-star steps; each reduces neighbourhoods with aggregates before it shuffles
    and is written to the shared folder, so no component is ever gathered in one place.
    """
    def directed(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def smallest(pairs: DataFrame) -> DataFrame:
        """For each a: the least of a and its neighbours."""
        return pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))

    def step(e: DataFrame, large: bool) -> DataFrame:
        if large:
            pairs = directed(e)
            out = pairs.join(smallest(pairs), "a").where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        else:
            pairs = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            low = smallest(pairs)
            out = pairs.join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).union(low.select(F.col("a").alias("x"), F.col("m").alias("y")))
        return out.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()

    def digest(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return tuple(row)

    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = digest(now)
    while seen[0]:
        middle = stored(step(now, True), label, seen[0])
        after = stored(step(middle, False), label, seen[0])
        drop_stored(middle)
        drop_stored(now)
        now, before = after, seen
        seen = digest(now)
        if seen == before:
            break
    out = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return out.union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
