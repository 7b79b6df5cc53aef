"""Fingerprints as a table (doc_id, pos, h): distinct forms, boilerplate removal, coverage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.hashing import fingerprint_rows, gram_rows


def fingerprint(
    docs: DataFrame, k: int, window: int = 1, boilerplate: DataFrame | None = None, remove_duplicates: bool = False,
    compat_boilerplate: bool = False, text_col: str = "text", id_col: str = "doc_id", method: str = "rolling",
) -> DataFrame:
    """(doc_id, pos, h) of docs: kept by winnowing, without the hashes of boilerplate (h)."""
    if remove_duplicates or (compat_boilerplate and boilerplate is not None):
        grams = gram_positions(docs, k, window, text_col, id_col, method)
        rows = grams.select("doc_id", F.col("first_pos" if remove_duplicates else "last_pos").alias("pos"), "h")
    else:
        rows = fingerprint_rows(docs, k, window, text_col, id_col, method)
    return rows if boilerplate is None else without_boilerplate(rows, boilerplate)


def gram_positions(docs: DataFrame, k: int, window: int = 1, text_col: str = "text", id_col: str = "doc_id", method: str = "rolling", broadcast_rows: int = 200_000) -> DataFrame:
    """(doc_id, h, n, first_pos, last_pos) of each document's distinct hashes; rows with one id are one document.

    A document's grams are counted where its text is read. Only those of ids that several rows have are shuffled.
    """
    repeated = docs.groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1").select("__id")
    several = repeated.count()
    if not several:
        return gram_rows(docs, k, window, text_col, id_col, method)
    repeated = F.broadcast(repeated) if several <= broadcast_rows else repeated
    same = F.col(id_col).eqNullSafe(F.col("__id"))
    once, more = (gram_rows(docs.join(repeated, same, how), k, window, text_col, id_col, method) for how in ("left_anti", "left_semi"))
    return once.union(more.groupBy("doc_id", "h").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos")))


def first_positions(rows: DataFrame) -> DataFrame:
    """Each document's hashes once, at their first position."""
    return rows.groupBy("doc_id", "h").agg(F.min("pos").alias("pos")).select("doc_id", "pos", "h")


def boilerplate_hashes(docs: DataFrame, k: int, text_col: str = "text", id_col: str = "doc_id", method: str = "rolling") -> DataFrame:
    """The distinct hashes (h) of all k-grams of boilerplate texts; no winnowing."""
    return fingerprint_rows(docs, k, 1, text_col, id_col, method).select("h").distinct()


def without_boilerplate(rows: DataFrame, hashes: DataFrame, compat: bool = False) -> DataFrame:
    """rows whose hash is none of hashes (h). compat: then only the last position of each hash stays."""
    kept = rows.join(hashes, "h", "left_anti").select("doc_id", "pos", "h")
    if compat:
        last = kept.groupBy("doc_id", "h").agg(F.max("pos").alias("pos"))
        kept = last.select("doc_id", "pos", "h")
    return kept


def hash_positions(rows: DataFrame) -> DataFrame:
    """(doc_id, h, positions): the sorted positions of each hash in each document."""
    return rows.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def covered(pos: Column, end: Column, following: Column, k: int) -> Column:
    """Characters that grams at pos..end cover before the next gram: touching grams count once."""
    return (end - pos + F.least(F.lit(k), F.coalesce(following - end, F.lit(k)))).cast("bigint")


def runs(rows: DataFrame) -> DataFrame:
    """(doc_id, start, end): rows that follow one another at neighbouring positions of a document as one row.

    Rows that come in another order make shorter runs, none is lost.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, pos = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(ids) != 0) | (np.diff(pos) != 1)]))
            ends = np.append(starts[1:], len(pos)) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), pa.array(pos[starts]), pa.array(pos[ends])], ["doc_id", "start", "end"])

    return rows.select("doc_id", F.col("pos").cast("int").alias("pos")).mapInArrow(run, f"doc_id {kind}, start int, end int")


def coverage(rows: DataFrame, k: int) -> DataFrame:
    """(doc_id, coverage): characters under any k-gram of rows."""
    before = F.max("end").over(Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)) + k
    fresh = F.greatest(F.lit(0), F.col("end") + k - F.greatest("start", F.coalesce(before, "start")))
    return runs(rows).withColumn("n", fresh.cast("bigint")).groupBy("doc_id").agg(F.sum("n").alias("coverage"))
