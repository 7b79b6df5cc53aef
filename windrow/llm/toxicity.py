"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are hashed bytes between spaces and ASCII marks, lower-cased; features are the distinct words, pairs, triples and
pairs with one word skipped, hashed to 2^bits coordinates. FTRL keeps a learning rate for each coordinate and its L1
term leaves most weights at exactly zero, so the model is a short list of (coordinate, weight) that travels in the
task closure.

Training reads at most `max_train` labelled documents, those with the smallest hash of their id, in one task: that bound
is a parameter and does not depend on the corpus. Scoring reads every whole text. Null and empty texts score by the
intercept alone. A doc_id with several labels counts once, as the majority says (ties: 1). Without labels every score
is 0.5 or below by the intercept's start of 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import fold, mix, read, slices, text_buffers, trimmed, word_hashes
from windrow.llm.quality import clean_labels

_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 39, 95]] = True
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass(frozen=True)
class FtrlParams:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 0.01
    epochs: int = 5
    max_train: int = 16_000


def coordinates(words: np.ndarray, bits: int) -> list[np.ndarray]:
    """Coordinates of one text's words, pairs, triples and skip-pairs; repeats included."""
    shift = np.uint64(64 - bits)
    out = [mix(words, 1) >> shift]
    if len(words) > 1:
        out.append(mix(words[:-1] * _A + words[1:] * _B, 2) >> shift)
    if len(words) > 2:
        out.append(mix(words[:-2] * _A + words[2:] * _B, 4) >> shift)
        out.append(mix(words[:-2] * _A + words[1:-1] * _B + words[2:] * _C, 5) >> shift)
    return out


def training_features(docs: DataFrame, bits: int) -> DataFrame:
    """(label, features array<int>) of (label, text) rows: each distinct coordinate once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            raw, offsets = text_buffers(part.column("text"))
            words, at = word_hashes(raw, offsets, _KEEP)
            rows = [np.unique(np.concatenate(coordinates(words[s:e], bits))).astype(np.int32) for s, e in zip(at[:-1], at[1:])]
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows)))], ["id", "label", "features"])

    return docs.select("id", "label", "text").mapInArrow(trimmed(run), "id long, label int, features array<int>")


def ftrl(rows: list[tuple[int, np.ndarray]], p: FtrlParams) -> tuple[np.ndarray, np.ndarray, float]:
    """Runs FTRL-proximal over the rows; the non-zero coordinates, their weights, and the intercept."""
    size = 1 << p.bits
    z, n = np.zeros(size), np.zeros(size)
    bias = np.zeros(2)  # z and n of the intercept, which has no L1

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= p.l1, 0.0, -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))

    def intercept() -> float:
        return -bias[0] / ((p.beta + np.sqrt(bias[1])) / p.alpha)

    order = np.random.default_rng(7)
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)):
            label, i = rows[k]
            w, b = weights(i), intercept()
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
            ni = n[i]
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha * w
            n[i] = ni + g * g
            bias += (g - (np.sqrt(bias[1] + g * g) - np.sqrt(bias[1])) / p.alpha * b, g * g)
    used = np.flatnonzero(np.abs(z) > p.l1)
    return used, weights(used), intercept()


@dataclass
class ToxicityModel:
    bits: int
    coordinates: np.ndarray
    weights: np.ndarray
    intercept: float


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams()) -> ToxicityModel:
    """docs: (doc_id, text); labels: (id, label). The ids of the sample are bounded by max_train, hence broadcast."""
    sample = labels.orderBy(F.xxhash64("id"), "id").limit(params.max_train)
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(sample), "id").select(F.col("id").cast("long"), "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[int, np.ndarray]] = {}
        for batch in batches:
            flat, ends = batch.column(2).flatten().to_numpy(), batch.column(2).offsets.to_numpy()
            ends = ends - ends[0]
            for k, (key, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                one = flat[ends[k] : ends[k + 1]]
                found.setdefault((key, len(one), int(one.sum(dtype=np.int64))), (label, one.copy()))
        kept = [found[k] for k in sorted(found)]
        i, w, b = ftrl(kept, params)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1).astype(np.int64)), pa.array(np.append(w, b))], ["i", "w"])

    got = training_features(rows, params.bits).repartition(1).mapInArrow(trimmed(run), "i long, w double").collect()
    table = sorted((r.i, r.w) for r in got)
    if not table:
        return ToxicityModel(params.bits, np.zeros(0, np.int64), np.zeros(0), 0.0)
    return ToxicityModel(params.bits, np.array([i for i, _ in table[1:]], np.int64), np.array([w for _, w in table[1:]]), table[0][1])


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row; each distinct weighted coordinate of the whole text counts once."""
    kind = docs.schema[id_col].dataType.simpleString()
    bits, used, weights, intercept = model.bits, model.coordinates, model.weights, model.intercept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << bits, -1, np.int32)
        place[used] = np.arange(len(used))
        for part in slices(batches, "text"):
            raw, offsets = text_buffers(part.column("text"))
            words, at = word_hashes(raw, offsets, _KEEP)
            row_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
            hits = []
            for span, found in zip((1, 2, 3, 3), coordinates(words, bits)):
                k = place[found.astype(np.int64)]
                first, last = row_of[: len(k)], row_of[span - 1 :]
                good = (k >= 0) & (first == last)
                hits.append(first[good].astype(np.int64) * max(1, len(used)) + k[good])
            pairs = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
            total = np.bincount(pairs // max(1, len(used)), weights[pairs % max(1, len(used))] if len(pairs) else None, minlength=part.num_rows)
            score = 1 / (1 + np.exp(-np.clip(total[: part.num_rows] + intercept, -35, 35)))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score)], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), f"id {kind}, score double")


def op2_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = clean_labels(read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0), "toxic")
    model = fit_toxicity(docs, labels)
    return score_toxicity(docs, model).select(
        F.col("id").alias("doc_id"), (fold(F.col("id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
