"""k-gram hashes of texts and the winnowing selection, on arrays inside Arrow batches; SQL forms of both for tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BASE = 0x5851F42D4C957F2D
_MASK = (1 << 64) - 1


def spread(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def kgram_hashes(text: str, k: int) -> np.ndarray:
    """Hashes of all k-grams of code points, position by position; none where the text is shorter than k.

    Doubling builds the hash of 2^i characters from two of 2^(i-1), so a text takes n log k steps and no strings.
    """
    return point_hashes(code_points(text), k)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def point_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """kgram_hashes of a text given as code points."""
    points = points.astype(np.uint64)
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        block, width = spread(points + np.uint64(1)), 1
        total, done, rest = np.zeros(n, np.uint64), 0, k
        while rest:
            if rest & 1:
                total = total * np.uint64(pow(_BASE, width, 1 << 64)) + block[done : done + n]
                done += width
            rest >>= 1
            if rest:
                block = block[: len(block) - width] * np.uint64(pow(_BASE, width, 1 << 64)) + block[width:]
                width *= 2
        return spread(total).view(np.int64)


def kgram_md5(text: str, k: int) -> np.ndarray:
    """The first 60 bits of each k-gram's MD5: a hash that any SQL engine can reproduce."""
    return np.array([int(hashlib.md5(text[i : i + k].encode()).hexdigest()[:15], 16) for i in range(len(text) - k + 1)], np.int64)


def winnow_positions(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions kept by robust winnowing.

    From a kept position p the next is the first strictly smaller hash within the window, else the rightmost minimum of
    the next window-full, as long as one is complete. The walk starts at position 0.
    """
    n = len(hashes)
    if window < 1:
        raise ValueError("the window must be at least 1")
    if window == 1 or n == 0:
        return np.arange(n)
    far = np.full(n, -1, np.int64)  # rightmost minimum of (p, p + window]
    if n > window:
        views = np.lib.stride_tricks.sliding_window_view(hashes[1:], window)
        far[: len(views)] = np.arange(1, len(views) + 1) + (window - 1 - np.argmin(views[:, ::-1], axis=1))
    near = np.full(n, -1, np.int64)  # first smaller within (p, p + window)
    for step in range(min(window, n) - 1, 0, -1):
        smaller = np.flatnonzero(hashes[step:] < hashes[: n - step])
        near[smaller] = smaller + step
    following = np.where(near >= 0, near, far).tolist()
    kept, p = [], 0
    while p >= 0:
        kept.append(p)
        p = following[p]
    return np.array(kept)


def density(window: int) -> float:
    """Expected share of positions kept."""
    return 2 / (window + 1)


def _hasher(k: int, window: int, method: str) -> Callable[[str | None], tuple[np.ndarray, np.ndarray]]:
    """A function of a text: positions and hashes of its kept k-grams."""
    if window < 1:
        raise ValueError("the window must be at least 1")
    hasher = {"rolling": kgram_hashes, "md5": kgram_md5}[method]

    def kept(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        hashes = hasher(text or "", k)
        at = winnow_positions(hashes, window)
        return at, hashes[at]

    return kept


def fingerprint_rows(docs: DataFrame, k: int, window: int, text_col: str = "text", id_col: str = "doc_id", method: str = "rolling") -> DataFrame:
    """(doc_id, pos, h) of the kept k-grams of every whole text; null texts have none."""
    kept = _hasher(k, window, method)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                rows, places, found = [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    at, hashes = kept(text)
                    rows.append(np.full(len(at), row))
                    places.append(at)
                    found.append(hashes)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.concatenate(rows).astype(np.int64))), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(found).astype(np.int64)),
                ], ["doc_id", "pos", "h"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, pos int, h long")


def gram_rows(docs: DataFrame, k: int, window: int, text_col: str = "text", id_col: str = "doc_id", method: str = "rolling") -> DataFrame:
    """(doc_id, h, n, first_pos, last_pos) of the distinct kept k-grams of every whole text, found where the text is read."""
    kept = _hasher(k, window, method)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column(1).to_pylist()):
                at, hashes = kept(text)
                if not len(at):
                    continue
                order = np.argsort(hashes, kind="stable")
                starts = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0]))
                ends = np.append(starts[1:], len(order))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.full(len(starts), row))), pa.array(hashes[order[starts]]), pa.array(ends - starts), pa.array(at[order[starts]].astype(np.int32)), pa.array(at[order[ends - 1]].astype(np.int32)),
                ], ["doc_id", "h", "n", "first_pos", "last_pos"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, h long, n long, first_pos int, last_pos int")


def kgram_hashes_sql(text: Column, k: int) -> Column:
    """The array of xxhash64 of all k-grams, with built-in functions only; nulls and short texts give an empty array."""
    characters = F.split(text, "")
    grams = F.transform(F.sequence(F.lit(1), F.char_length(text) - k + 1), lambda i: F.xxhash64(F.array_join(F.slice(characters, i, F.lit(k)), "")))
    return F.when(F.char_length(text) >= k, grams).otherwise(F.array().cast("array<bigint>"))


def winnow_sql(hashes: Column, window: int) -> Column:
    """Kept positions of an array of hashes as a fold with built-in functions: the slow form that tests compare with."""
    none = F.array().cast("array<int>")

    def following(p: Column) -> Column:
        ahead = F.slice(hashes, p + 2, F.lit(window))
        here = F.get(hashes, p)
        smaller = F.array_position(F.transform(F.slice(ahead, F.lit(1), F.lit(max(1, window - 1))), lambda x: x < here), True)
        rightmost = F.size(ahead) - F.array_position(F.reverse(ahead), F.array_min(ahead)) + 1
        return F.when(F.lit(window > 1) & (smaller > 0), p + smaller).when(F.size(ahead) == window, p + rightmost).otherwise(F.lit(-1)).cast("int")

    def step(state: Column, i: Column) -> Column:
        hit = i == state["next"]
        return F.struct(
            F.when(hit, following(i)).otherwise(state["next"]).alias("next"),
            F.when(hit, F.array_append(state["kept"], i)).otherwise(state["kept"]).alias("kept"),
        )

    fold = F.aggregate(F.sequence(F.lit(0), F.size(hashes) - 1), F.struct(F.lit(0).alias("next"), none.alias("kept")), step, lambda s: s["kept"])
    return F.when(F.size(hashes) > 0, fold).otherwise(none)
