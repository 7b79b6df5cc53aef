"""Document quality by regularised quadratic discriminant analysis over transformed text statistics.

fit_quality learns class means and shrinkage covariances from moments that Spark adds up; the driver sees two
moment matrices only. Each class keeps the inverse of its covariance's Cholesky factor, so a score is two products with a triangle
and a difference of Mahalanobis log-densities, squashed to 0..1.

Training reads the texts of at most `max_train` labelled ids, those with the smallest hash: the bound is a parameter and
does not depend on the corpus. Scoring reads every whole text, once.

Null and empty texts have defined statistics (all zero counts) and a score like any other. Repeated doc_ids give a
row each, in training too. An id with several labels has the one that the majority says (ties: 1). With one class or none
among the labels, the score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import fold, read, slices, trimmed

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "letter_share", "upper_share", "digit_share",
    "mark_share", "symbol_share", "wide_share", "line_length", "repeated_lines", "distinct_words", "distinct_pairs",
    "top_word", "symbol_words", "upper_words", "stop_share",
)

_LETTERS = [*range(65, 91), *range(97, 123)]
_MARKS = [ord(c) for c in ".,;:?'\"()-"]
_SYMBOLS = [c for c in range(33, 127) if c not in _LETTERS and c not in _MARKS and not 48 <= c <= 57]
_SYMBOL_SET = frozenset(map(chr, _SYMBOLS))
_EMPTY = np.zeros(len(FEATURES))


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of one whole text: logs of sizes, square roots of shares."""
    words = text.split()
    if not words:
        return _EMPTY
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    n, size = len(words), len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    share = [
        counts[_LETTERS].sum() / size, counts[65:91].sum() / size, counts[48:58].sum() / size, counts[_MARKS].sum() / size,
        counts[_SYMBOLS].sum() / size, counts[128:].sum() / size,
    ]
    distinct = len(seen)
    symbol = sum(k for w, k in seen.items() if w[-1] in _SYMBOL_SET) / n
    upper = sum(k for w, k in seen.items() if w.isupper()) / n
    short = sum(k for w, k in seen.items() if len(w) <= 3) / n
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    return np.array([
        np.log1p(size), np.log1p(n), np.log1p(lengths.mean()), np.log1p(lengths.std()), *np.sqrt(share),
        np.log1p(size / max(1, len(lines))), np.sqrt(1 - len(set(lines)) / max(1, len(lines))),
        np.log1p(distinct) / np.log1p(n), np.sqrt(pairs), np.sqrt(max(seen.values()) / n), np.sqrt(symbol), np.sqrt(upper), np.sqrt(short),
    ])


def batch_statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text; null is empty."""
    return np.stack([statistics(x or "") for x in texts.to_pylist()])


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats array<double>) for every row of docs."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            flat = pa.array(batch_statistics(part.column("text")).ravel())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * len(FEATURES), flat)], ["id", "stats"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(run), f"id {kind.simpleString()}, stats array<double>")


def moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """(label, text) rows to the sum of (1, x)(1, x)^T by label; the driver gets one matrix a class."""
    d = len(FEATURES) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for part in slices(batches, "text"):
            x = np.ones((part.num_rows, d))
            x[:, 1:] = batch_statistics(part.column("text"))
            label = part.column("label").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                rows_of = x[label == c]
                total[c] = total.get(c, 0) + rows_of.T @ rows_of
        for c, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, c, np.int32)), pa.array(np.arange(d * d, dtype=np.int32)), pa.array(m.ravel())], ["label", "cell", "value"])

    sums = rows.select(F.col("label").cast("int").alias("label"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), "label int, cell int, value double").groupBy("label", "cell").agg(F.sum("value").alias("value")).collect()
    out = {c: np.zeros(d * d) for c in (0, 1)}
    for r in sums:
        out[r.label][r.cell] = r.value
    return {c: m.reshape(d, d) for c, m in out.items()}


class QualityModel:
    """Means, Cholesky factors and priors of the two classes."""

    def __init__(self, sums: dict[int, np.ndarray], pooling: float = 0.3, ridge: float = 0.02):
        """pooling: weight of the pooled covariance in each class; ridge: weight of the identity, on standardised axes."""
        n = {c: m[0, 0] for c, m in sums.items()}
        self.constant = None
        if min(n.values()) < 2:
            total = sum(n.values())
            self.constant = float(n[1] / total) if total else 0.5
            return
        whole = sum(sums.values())
        count = whole[0, 0]
        self.centre = whole[0, 1:] / count
        spread = np.sqrt(np.maximum(np.diag(whole)[1:] / count - self.centre**2, 0))
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        cov, mean = {}, {}
        for c, m in sums.items():
            raw = m[0, 1:] / n[c]
            cov[c] = (m[1:, 1:] / n[c] - np.outer(raw, raw)) / np.outer(self.scale, self.scale)
            mean[c] = (raw - self.centre) / self.scale
        pooled = (cov[0] * n[0] + cov[1] * n[1]) / count
        self.classes = {}
        for c in (0, 1):
            s = (1 - pooling) * cov[c] + pooling * pooled
            s = (1 - ridge) * s + ridge * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            inverse = np.linalg.inv(factor)
            self.classes[c] = (mean[c], inverse, -np.log(np.diag(factor)).sum() + np.log(n[c] / count))

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        z = (stats - self.centre) / self.scale
        density = []
        for c in (0, 1):
            mean, inverse, constant = self.classes[c]
            density.append(constant - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def clean_labels(labels: DataFrame, column: str) -> DataFrame:
    """One 0/1 label for each doc_id that has any."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg((F.avg(F.col(column).cast("double")) >= 0.5).cast("int").alias("label")).withColumnRenamed("doc_id", "id")


def fit_quality(docs: DataFrame, labels: DataFrame, pooling: float = 0.3, ridge: float = 0.02, max_train: int = 20_000) -> QualityModel:
    """docs: (doc_id, text); labels: (id, label), one row an id. The sample of ids is bounded, hence broadcast."""
    sample = labels.orderBy(F.xxhash64("id"), "id").limit(max_train).withColumnRenamed("id", "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id").cast("string") == F.col("labelled").cast("string"))
    return QualityModel(moments(rows), pooling, ridge)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(model.score(batch_statistics(part.column("text"))))], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(run), f"id {kind}, score double")


def train_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    return clean_labels(labels.where(fold(F.col("doc_id"), 3) != 1), "quality")


def op9_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, fit_quality(docs, train_labels(spark, sf_dir))).select(
        F.col("id").alias("doc_id"), (fold(F.col("id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.5, with their columns as they are."""
    model = fit_quality(docs, train_labels(spark, sf_dir))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield part.filter(pa.array(model.score(batch_statistics(part.column("text"))) >= 0.5))

    return docs.mapInArrow(trimmed(run), docs.schema)
