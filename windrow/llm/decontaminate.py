"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits, case-folded by Unicode (so ß is ss) and in NFC. A mask such as 11011 hashes the words at its 1s and ignores those at
its 0s, so a seed survives substitutions at ignored places. The seeds of all benchmark items form a table and a small
Bloom filter; each task hashes every position of its whole texts under every mask, keeps positions that the filter
lets through and as many words around them as the longest item has. Those few are joined with the seed table, and each
(place, item, alignment) is verified word by word over the whole item: an item is found where at least `similarity` of all
its words stand in the text, in place.

Items of 10 words or more have masks of weight 5, shorter ones every mask of their own length that ignores one word, and
those of one to four words, of which none may be replaced, the mask of all their words.
Wherever a fifth of an item's words was replaced, some mask still hits. Null and empty texts have no hits, items without words are
never found. Repeated rows of a document give one row with their id; rows with a null doc_id are reported together under null.
Repeated items are reported each. Ids may be of any type.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import fresh, mix, read, slices, stored, text_buffers, trimmed, word_hashes

_FIVES = ("11111", "1101011", "11100011", "110010101", "1010110001")
#: Masks for items of at least this many words. By enumeration of all placements one hits every item of 10 to 31 words of
#: which a fifth was replaced; a longer item is a row of pieces of 16 to 31 words, one of which lost a fifth at most.
MASKS = {11: _FIVES, 10: (*_FIVES, "110111")}
_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FACTOR = [np.uint64(pow(0xA0761D6478BD642F, i + 1, 1 << 64)) for i in range(64)]


def masks_for(n: int) -> tuple[str, ...]:
    """The masks of an item of n words."""
    for least, masks in MASKS.items():
        if n >= least:
            return masks
    if n < 5:
        return ("1" * n,)
    # One word may be replaced, or missing where a text begins or ends: there the mask of the others is shorter.
    return ("1" * (n - 1), *("1" * i + "0" + "1" * (n - 1 - i) for i in range(1, n - 1)))


def folded(column: pa.Array) -> pa.Array:
    """Texts without differences of case or composition."""
    return pa.array([None if x is None else unicodedata.normalize("NFC", x.casefold()) for x in column.to_pylist()], column.type)


def seeds(words: np.ndarray, masks: tuple[str, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """For each mask that fits: its span, and the hash at every position."""
    for mask in masks:
        n = len(words) - len(mask) + 1
        if n > 0:
            total = np.zeros(n, np.uint64)
            for at, c in enumerate(mask):
                if c == "1":
                    total += words[at : at + n] * _FACTOR[at]
            yield len(mask), mix(total, zlib.crc32(mask.encode()))


def _bits(hashes: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << log2) - 1)
    return hashes & low, (hashes >> np.uint64(32)) & low


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words array<long>) of (item_id, text)."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words, at = word_hashes(*text_buffers(folded(part.column("text"))), _KEEP)
            yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.ListArray.from_arrays(at.astype(np.int32), pa.array(words.view(np.int64)))], ["item_id", "words"])

    return items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), f"item_id {kind}, words array<long>")


def item_seeds(words: DataFrame, min_words: int) -> DataFrame:
    """(seed, item_id, item_pos, item_words) of (item_id, words)."""
    kind = words.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, own in enumerate(batch.column(1).to_pylist()):
                if len(own) < max(1, min_words):
                    continue
                found = [h for _, h in seeds(np.array(own, np.int64).view(np.uint64), masks_for(len(own)))]
                at = np.concatenate([np.arange(len(h), dtype=np.int32) for h in found])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(found).view(np.int64)), batch.column(0).take(pa.array([row] * len(at), pa.int32())), pa.array(at), pa.array(np.full(len(at), len(own), np.int32)),
                ], ["seed", "item_id", "item_pos", "item_words"])

    return words.select("item_id", "words").mapInArrow(trimmed(run), f"seed long, item_id {kind}, item_pos int, item_words int").distinct()


def bloom(seed_table: DataFrame, n: int, max_log2: int = 27, bits_each: int = 512) -> tuple[np.ndarray, int]:
    """A bit set of at most 2^max_log2 bits (16 MB), from at most 8 partial sets.

    False positives only cost a stored stretch and a join row: at 512 bits a seed there are about 15 in a million places.
    """
    log2 = int(min(max_log2, max(16, np.ceil(np.log2(max(1, n) * bits_each)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << log2, bool)
        for batch in batches:
            for part in _bits(batch.column(0).to_numpy().view(np.uint64), log2):
                bits[part.astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["bits"])

    whole = np.zeros(1 << max(0, log2 - 3), np.uint8)
    for row in seed_table.select("seed").coalesce(8).mapInArrow(trimmed(run), "bits binary").toLocalIterator():
        whole |= np.frombuffer(row.bits, np.uint8)
    return whole, log2


def segments(docs: DataFrame, filter_bits, log2: int, masks: tuple[str, ...], reach: int) -> DataFrame:
    """(doc_id, words, hits array<struct<seed, pos>>): stretches of texts with possible hits, and reach words around them."""
    span = max(map(len, masks), default=1)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = filter_bits.value
        for part in slices(batches, "text"):
            words, at = word_hashes(*text_buffers(folded(part.column("text"))), _KEEP)
            row_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
            place, seed = [], []
            for width, h in seeds(words, masks):
                one, two = _bits(h, log2)
                ok = (whole[(one >> np.uint64(3)).astype(np.int64)] >> (one & np.uint64(7)).astype(np.uint8)) & 1
                k = np.flatnonzero(ok)
                two = two[k]
                k = k[((whole[(two >> np.uint64(3)).astype(np.int64)] >> (two & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
                k = k[row_of[k] == row_of[k + width - 1]]
                place.append(k)
                seed.append(h[k])
            if not place:
                continue
            place, seed = np.concatenate(place), np.concatenate(seed).view(np.int64)
            if not len(place):
                continue
            order = np.lexsort((seed, place))
            place, seed = place[order], seed[order]
            row = row_of[place]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] - place[:-1] > reach)]))
            stop = np.append(new[1:], len(place))
            low = np.maximum(at[row[new]], place[new] - reach)
            high = np.minimum(at[row[new] + 1], place[stop - 1] + span + reach)
            count = high - low
            spread = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            edges = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            own = np.concatenate([new, [len(place)]]).astype(np.int32)
            pos = (place - np.repeat(low, stop - new)).astype(np.int32)
            hits = pa.StructArray.from_arrays([pa.array(seed), pa.array(pos)], ["seed", "pos"])
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").take(pa.array(row[new])), pa.ListArray.from_arrays(edges, pa.array(words[spread].view(np.int64))), pa.ListArray.from_arrays(own, hits),
            ], ["doc_id", "words", "hits"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), f"doc_id {kind}, words array<long>, hits array<struct<seed:long,pos:int>>")


def find_contamination(docs: DataFrame, items: DataFrame, similarity: float = 0.8, min_words: int = 1) -> DataFrame:
    """One row a document and benchmark item found in it: doc_id, item_id, matched_words, item_words.

    min_words: items with fewer words are left out, by choice of the caller; by default none is.
    """
    spark = docs.sparkSession
    known = stored(item_words(items), "items")
    size = F.size("words")
    sizes = known.agg(F.max(size).alias("longest"), F.collect_set(F.least(size, F.lit(max(MASKS)))).alias("lengths")).first()
    masks = tuple(sorted({m for n in sizes.lengths if n >= max(1, min_words) for m in masks_for(n)}))
    table = stored(item_seeds(known, min_words), "seeds")
    whole, log2 = bloom(table, table.count())
    # A stretch is known by its document and words, so equal stretches of repeated rows are one.
    parts = stored(segments(docs, spark.sparkContext.broadcast(whole), log2, masks, max(1, sizes.longest or 0)).withColumn("segment", F.xxhash64("doc_id", "words")), "segments")
    hits = parts.select("segment", F.explode("hits").alias("hit")).select("segment", F.col("hit.seed").alias("seed"), F.col("hit.pos").alias("pos"))
    aligned = hits.join(table, "seed").select("segment", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_words").distinct()
    pairs = aligned.join(parts.dropDuplicates(["segment"]).select("segment", "doc_id", "words"), "segment")
    # Only the stretch that faces the item goes on, if enough of the item faces any text at all.
    skipped = F.greatest(-F.col("shift"), F.lit(0))
    pairs = pairs.select("doc_id", "item_id", skipped.alias("skipped"), F.expr("slice(words, greatest(shift, 0) + 1, item_words - greatest(-shift, 0))").alias("words"), "item_words")
    pairs = pairs.where(size >= similarity * F.col("item_words")).join(known.select(F.col("item_id").alias("known_id"), F.col("words").alias("item")).distinct(), F.col("item_id").eqNullSafe(F.col("known_id")))
    pairs = pairs.where(F.size("item") == F.col("item_words"))
    facing = F.zip_with("words", F.expr("slice(item, skipped + 1, size(words))"), lambda a, b: F.when(a == b, 1))
    found = pairs.select("doc_id", "item_id", F.size(F.array_compact(facing)).cast("long").alias("matched_words"), F.col("item_words").cast("long").alias("item_words"))
    found = found.where(F.col("matched_words") >= similarity * F.col("item_words"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("matched_words") / F.col("item_words"), "matched_words", "item_words")).alias("best"))
    return best.select("doc_id", "item_id", "best.matched_words", "best.item_words")


def op6_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_rows: int = 100_000) -> DataFrame:
    """Rows in whose text no benchmark item is found, whatever their ids. Up to broadcast_rows hashes of texts to drop are broadcast, more are joined by a shuffle."""
    bad = fresh("bad_text", docs.columns)
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = stored(find_contamination(texts, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(bad)).distinct(), "leaks")
    found = F.broadcast(found) if found.count() <= broadcast_rows else found
    return docs.join(found, F.xxhash64("text") == F.col(bad), "left_anti").select(docs.columns)
