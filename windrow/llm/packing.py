"""Best-fit packing of token pieces into sequences, under several capacities at once.

Texts become token ids and an end id; documents over the token capacity are cut into full pieces, the first of which
may be shorter. Pieces are packed by vector best fit: longest first, each into the open sequence that takes it within
every capacity (tokens, documents, attention cost as the sum of squared lengths) and is best by the residual's weighted
norm or by the weighted dot product of demand and residual.

Pieces of one length are alike, so the plan is made over the counts of lengths (at most `capacity` numbers, whatever
the corpus) and says: ranks a..b of length L fill sequences s..t from offset o on. Ranks come from a window over
(length, bucket) groups, with as many buckets as keep groups small; no task sees all pieces.

Null and empty texts are the end id alone. Repeated rows are packed once each. Empty tables give no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.llm.common import read, slices, stored, trimmed

_CACHE_UNITS = 150_000
_SLICE = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def _units(path: str) -> tuple[tiktoken.Encoding, dict[str, int], np.ndarray]:
    """An encoder of plain text with the file's vocabulary, the ids of its special strings, and the bytes of each id."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    # Byte-level files write a byte as itself where it prints, else as the next character from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(x) for x in ranks]
    import public_tokenizers

    return tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), special, sizes


class UnitEncoder:
    """Token ids by a byte-level BPE file, with a bounded cache of encoded words.

    The pre-tokenizer never joins across a space but for one space in front of a word, so a text's ids are those of its
    space-led words. Only where a space stands between two white-space characters is this not so; such texts, and those
    with one of the file's special strings, are encoded whole by the tokenizers library.
    """

    def __init__(self, path: str, end_id: int = 2):
        self.path, self.end_id = path, end_id
        units, self.special, self.sizes = _units(path)
        self.encode_unit = units.encode_ordinary
        self.whole = None
        self.reset()

    def reset(self) -> None:
        self.places: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths, self.odd = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool)
        self.used = self.count = 0
        self.end = self._add([self.end_id], [1])

    def _add(self, ids: np.ndarray | list[int], lengths: np.ndarray | list[int], odd: bool = False) -> int:
        """Keeps the ids of some units, given their lengths; the first unit's place."""
        k, n = self.count, len(lengths)
        while k + n > len(self.starts):
            self.starts, self.lengths, self.odd = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.odd))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.lengths[k : k + n], self.odd[k : k + n] = lengths, odd
        self.starts[k : k + n] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(ids)] = ids
        self.used, self.count = self.used + len(ids), k + n
        return k

    def _one(self, unit: str, odd: bool = False) -> int:
        ids = self.encode_unit(unit)
        return self._add(ids, [len(ids)], odd or any(x in unit for x in self.special))

    def _learn(self, words: list[str]) -> None:
        """Encodes unknown space-led words as one text; where a word ends is seen from the bytes of its tokens."""
        odd = [w for w in words if not w or w[0].isspace() or any(x in w for x in self.special)]
        for w in odd:
            self.places[w] = self._one(" " + w, True)
        if odd:
            words = [w for w in words if w not in self.places]
        if not words:
            return
        ids = np.array(self.encode_unit(" " + " ".join(words)), np.uint32)
        ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)))
        last = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
        first = self._add(ids, np.diff(last, prepend=0))
        self.places.update(zip(words, range(first, first + len(words))))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, with the end id."""
        if self.count > _CACHE_UNITS:
            self.reset()
        parts = [t.split(" ") for t in texts]
        self._learn(list(set().union(*parts).difference(self.places)))
        counts = np.array([len(p) + 1 for p in parts], np.int64)
        edges = np.concatenate([[0], np.cumsum(counts)])
        k = np.full(edges[-1], self.end, np.int64)
        inner = np.ones(edges[-1], bool)
        inner[edges[1:] - 1] = False
        k[inner] = np.fromiter(map(self.places.__getitem__, chain.from_iterable(parts)), np.int64, edges[-1] - len(parts))
        k[edges[:-1]] = [self._one(p[0]) for p in parts]
        n = self.lengths[k]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.starts[k] - ends[:-1], n) + np.arange(ends[-1])]
        odd = np.logical_or.reduceat(self.odd[k], edges[:-1])
        for row, text in enumerate(texts):
            yield self._whole(text) if odd[row] else ids[ends[edges[row]] : ends[edges[row + 1]]]

    def _whole(self, text: str) -> np.ndarray:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return np.array([*self.whole.encode(text, add_special_tokens=False).ids, self.end_id], np.uint32)


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or min(n, capacity)
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def token_pieces(docs: DataFrame, capacity: int = 1024, vocabulary: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder(path, end_id)
        for part in slices(batches, "text", _SLICE):
            rows, out = [], []
            for row, ids in enumerate(encoder.encode([x or "" for x in part.column("text").to_pylist()])):
                whole = ids.astype("<u4", copy=False)
                for k, (start, n) in enumerate(cut(len(whole), capacity)):
                    rows.append(row)
                    out.append((k, start, n, zlib.crc32(whole[start : start + n].tobytes())))
            table = np.array(out, np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows)), *(pa.array(table[:, c]) for c in range(4))], names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), f"doc_id {kind}, piece long, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class Capacities:
    """Limits of a sequence; the defaults of documents and attention never bind before tokens do."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    by: str = "norm"  # or "dot"


def plan(counts: dict[int, int], limit: Capacities = Capacities()) -> np.ndarray:
    """Rows (length, first rank, pieces, pieces a sequence, first sequence, offset) that place every piece."""
    size = np.array([limit.tokens, limit.documents, limit.attention], float)
    weight = np.array(limit.weights)
    bins = np.zeros((0, 5), np.int64)  # residual tokens, documents and attention; first sequence; sequences
    runs, made = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        demand = np.array([length, 1, length * length])
        if (demand > size).any():
            raise ValueError(f"a piece of {length} tokens exceeds a sequence's capacities")
        room = np.minimum.reduce([bins[:, i] // demand[i] for i in range(3)]) if len(bins) else np.zeros(0, np.int64)
        fits = np.flatnonzero(room > 0)
        rest, asked = bins[fits, :3] / size, demand / size
        if limit.by == "dot":
            order = fits[np.argsort(-(rest * asked * weight).sum(axis=1), kind="stable")]
        else:
            order = fits[np.argsort(((rest - asked) ** 2 * weight).sum(axis=1), kind="stable")]
        fresh = [int(min(size // demand)), 0]
        added, gone = [], []

        def fill(residual: np.ndarray, first: int, n_bins: int, each: int) -> None:
            nonlocal left, rank
            for bins_now, k in ((min(n_bins, left // each), each), (1, left % each if left // each < n_bins else 0)):
                if bins_now and k:
                    runs.append((length, rank, bins_now * k, k, first, limit.tokens - residual[0]))
                    added.append((*(residual - k * demand), first, bins_now))
                    first, n_bins, left, rank = first + bins_now, n_bins - bins_now, left - bins_now * k, rank + bins_now * k
            if n_bins:
                added.append((*residual, first, n_bins))

        for k in order:
            if not left:
                break
            gone.append(k)
            fill(bins[k, :3], int(bins[k, 3]), int(bins[k, 4]), int(room[k]))
        if left:
            each = fresh[0]
            n = -(-left // each)
            fill(size.astype(np.int64), made, n, each)
            made += n
        bins = np.concatenate([np.delete(bins, gone, axis=0), np.array(added, np.int64).reshape(-1, 5)])
        bins = bins[(bins[:, 0] > 0) & (bins[:, 1] > 0) & (bins[:, 2] > 0)]
    return np.array(runs, np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, limit: Capacities = Capacities(), rows_per_bucket: int = 200_000) -> DataFrame:
    """pieces (stored; doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    total = pieces.count()
    buckets = max(16, -(-total // rows_per_bucket))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = stored(keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")), "counts")
    by_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(by_length, limit)
    table = {length: runs[runs[:, 0] == length] for length in by_length}
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(own) - 1).join(before, ["length", "bucket"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for n in np.unique(length):
                mine, rows = length == n, table[int(n)]
                j = rank[mine]
                r = rows[np.searchsorted(rows[:, 1], j, side="right") - 1]
                j = j - r[:, 1]
                sequence[mine], offset[mine] = r[:, 4] + j // r[:, 3], r[:, 5] + (j % r[:, 3]) * n
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(trimmed(run), f"doc_id {kind}, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stored(token_pieces(read(spark, sf_dir, "documents")), "pieces"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(stored(token_pieces(docs), "pieces"))
