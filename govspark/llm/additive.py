"""Quality classifier: a generalised additive model with pairwise interactions.

Features are cut into bins at quantiles of the training rows. Boosting goes round the features in turn; each step fits a
shallow tree (up to ``SPLITS`` cuts of one feature) to the gradient of the log loss and adds its small step to that
feature's lookup table. Then the pairs that explain most of what is left get tables of two dimensions in the same way
(one cut along each). A score is the sum of the tables' entries at the row's bins.

Training takes at most ``TRAIN_ROWS`` labelled rows, by the hash of their id, and only their features; texts never leave the
executors. Each text is read once; scoring is a vectorised sum over rows of features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.llm.common import Scratch, table
from govspark.llm.registry import query
from govspark.llm.textstats import DOC_FEATURES, document_features

#: Bound of the training sample: the driver gets so many rows of 17 numbers at most.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, SPLITS = 32, 8, 3
ROUNDS, PAIR_ROUNDS, RATE, PAIRS, LEAST = 60, 40, 0.1, 6, 5.0
THRESHOLD = 0.3


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def coarse(self, bins: np.ndarray, i: int) -> np.ndarray:
        return bins[:, i] * PAIR_BINS // (len(self.edges[i]) + 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for i, t in enumerate(self.tables):
            total += t[b[:, i]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[self.coarse(b, i), self.coarse(b, j)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _shallow_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A step function over the bins with at most SPLITS cuts, each where the loss falls most."""
    parts = [(0, len(gradient))]
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    value = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + LEAST)
    for _ in range(SPLITS):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = value(a, cut) + value(cut, b) - value(a, b)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], k, int(cut[at]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + LEAST)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Four leaves from one cut along each side; the gain, and the leaves' values as a table."""
    n = len(gradient)
    g, h = np.zeros((n + 1, n + 1)), np.zeros((n + 1, n + 1))
    g[1:, 1:], h[1:, 1:] = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    best, table_ = 0.0, np.zeros_like(gradient)
    whole = g[n, n] ** 2 / (h[n, n] + LEAST)
    for a in range(1, n):
        for b in range(1, n):
            gs = np.array([g[a, b], g[a, n] - g[a, b], g[n, b] - g[a, b], g[n, n] - g[a, n] - g[n, b] + g[a, b]])
            hs = np.array([h[a, b], h[a, n] - h[a, b], h[n, b] - h[a, b], h[n, n] - h[a, n] - h[n, b] + h[a, b]])
            gain = (gs**2 / (hs + LEAST)).sum() - whole
            if gain > best:
                best, v = gain, gs / (hs + LEAST)
                table_ = np.zeros_like(gradient)
                table_[:a, :b], table_[:a, b:], table_[a:, :b], table_[a:, b:] = v
    return best, table_


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fit to rows in a stated order, so that reruns agree. Without rows every score is 0.5; with one label, near it."""
    d = len(DOC_FEATURES)
    if not len(x):
        return AdditiveModel([np.zeros(0)] * d, 0.0, [np.zeros(1)] * d)
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(d)]
    rate = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(edges, float(np.log(rate / (1 - rate))), [np.zeros(len(e) + 1) for e in edges])
    b = model.bins(x)
    total = np.full(len(y), model.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for i in range(d):
            r, w = slope()
            n = len(model.tables[i])
            step = RATE * _shallow_tree(np.bincount(b[:, i], r, n), np.bincount(b[:, i], w, n) * 1.0)
            model.tables[i] += step
            total += step[b[:, i]]
    c = np.stack([model.coarse(b, i) for i in range(d)], 1)

    def cells(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(c[:, i] * PAIR_BINS + c[:, j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    r, w = slope()
    gains = sorted(((_pair_tree(cells(i, j, r), cells(i, j, w))[0], i, j) for i in range(d) for j in range(i + 1, d)), key=lambda g: (-g[0], g[1:]))
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            r, w = slope()
            step = RATE * _pair_tree(cells(i, j, r), cells(i, j, w))[1]
            model.pair_tables[k] += step
            total += step[c[:, i], c[:, j]]
    return model


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and features of every whole text, in one pass; a null text is an empty one."""

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [document_features(t or "") for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(measure, "doc_id long, x array<double>")


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def train(features: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit to labelled rows outside fold 0. An id with two marks counts as good if one is; marks other than 0 and 1 don't count."""
    marks = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(fold(F.col("doc_id")) != 0)
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = features.join(F.broadcast(sample), "doc_id").orderBy("doc_id", "x").limit(rows).collect()
    return fit(np.array([r["x"] for r in found]).reshape(-1, len(DOC_FEATURES)), np.array([float(r["quality"]) for r in found]))


def score(features: DataFrame, model: AdditiveModel) -> DataFrame:
    """``features`` with score in place of the numbers; rows stay as many as they are."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = np.array(part["x"].to_pylist(), np.float64).reshape(-1, len(DOC_FEATURES))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(model.scores(x))], ["doc_id", "score"])

    return features.mapInArrow(add, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text; other columns are left alone).

    Null and empty texts get the score of a text without words; repeated rows get equal scores; an empty table gives no
    rows. A null id is in the fold of the empty string.
    """
    work = Scratch(docs.sparkSession, "quality-model")
    features = work.write(with_features(docs), "features")
    scored = score(features, train(features, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op5_quality_scores")
def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document by a model fitted to the labelled ones."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
