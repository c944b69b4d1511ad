"""Operator 3: quality classifier, histogram gradient-boosted trees over document statistics.

A bounded sample of labelled documents is turned into statistics on the executors and learned
from on the driver: features are cut into quantile bins once, each tree grows level by level on
gradient histograms. The ensemble is flattened into arrays of complete binary trees, so a batch
of documents walks down all trees with a few numpy gathers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_arrow, hashed_share, held_out, map_arrow, table

#: About so many labelled documents are learned from (a hash of the id chooses them).
SAMPLE = 8000
TREES, DEPTH, BINS, RATE, L2, LEAST_WEIGHT = 60, 4, 64, 0.2, 1.0, 2.0

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_spread", "distinct_words", "upper", "digit",
    "non_ascii", "blank", "comma_stop", "symbol", "bang", "bar", "bracket", "log_lines", "line_bytes",
    "repeated_lines", "lines_with_stop", "upper_words", "symbol_words", "top_line", "single_words",
)

_UPPER, _LOWER, _DIGIT = (np.array([c in s for c in range(256)], float) for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"))
_HIGH = (np.arange(256) >= 128).astype(float)
_SET = lambda s: np.array([c in s for c in range(256)], float)
_CLASSES = np.stack(
    [_UPPER, _DIGIT, _HIGH, _SET(b" \t\r\n\x0b\x0c"), _SET(b".,"), _SET(b"#$%&*@^~=+<>\\/_"), _SET(b"!?"), _SET(b"|"), _SET(b"{}[]()"), _LOWER]
).T


def statistics(text: str | None) -> np.ndarray:
    """The features of one whole text; a null text counts as empty, an empty one is all zeros."""
    out = np.zeros(len(FEATURES))
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return out
    n = len(data)
    share = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASSES) / n
    words, lines = data.split(), data.split(b"\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    filled = [x for x in map(bytes.strip, lines) if x]
    distinct = set(filled)
    m, k = max(1, len(words)), max(1, len(filled))
    out[:5] = np.log1p(n), np.log1p(len(words)), sizes.mean() if len(words) else 0, sizes.std() if len(words) else 0, len(set(words)) / m
    out[5:14] = share[:9]
    out[14:18] = np.log1p(len(lines)), np.log1p(n / k), 1 - len(distinct) / k, sum(x[-1:] in b".?!" for x in filled) / k
    out[18] = sum(map(bytes.isupper, words)) / m
    out[19] = sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:!?" for w in words) / m
    out[20] = max((len(x) for x in distinct), default=0) / n
    out[21] = float((sizes == 1).sum()) / m
    return out


@dataclass(frozen=True)
class BoostedTrees:
    """Complete binary trees of one depth as arrays (trees x nodes); ``base`` is in log odds."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        trees, inner = self.feature.shape
        total = np.full(len(x), self.base)
        if trees and len(x):
            at = np.zeros((len(x), trees), np.int64)
            row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
            total = total + self.value[tree, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> BoostedTrees:
    """Boosted trees for labels 0 and 1 by Newton steps on the logistic loss. Without rows, or
    with one label only, the score is the smoothed share of label 1."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    mean = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(mean / (1 - mean)))
    empty = BoostedTrees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if len(y) == 0 or y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    margin = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            width, first = 2**depth, 2**depth - 1
            best_gain, best = np.full(width, 1e-6), [None] * width
            for f, b in enumerate(binned):
                if not len(cuts[f]):
                    continue
                key = node * BINS + b
                sg = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                sh = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + L2) + (tg - sg) ** 2 / (th - sh + L2) - tg**2 / (th + L2)
                gain[(sh < LEAST_WEIGHT) | (th - sh < LEAST_WEIGHT)] = 0
                gain = gain[:, : len(cuts[f])]
                at = gain.argmax(axis=1)
                for i in np.flatnonzero(gain[np.arange(width), at] > best_gain):
                    best_gain[i], best[i] = gain[i, at[i]], (f, int(at[i]))
            right = np.zeros(len(y), bool)
            for i, split in enumerate(best):
                if split:
                    feature[first + i], threshold[first + i] = split[0], cuts[split[0]][split[1]]
                    right |= (node == i) & (binned[split[0]] > split[1])
            node = 2 * node + right
        value = -RATE * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + L2)
        margin = margin + value[node]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return BoostedTrees(base, np.stack(features), np.stack(thresholds), np.stack(values))


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([statistics(t) for t in batch.column("text").to_pylist()])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> BoostedTrees:
    """Trees learned from about ``sample`` labelled documents that are not held out.

    Null labels and ids are left out, a document with several labels counts with the lowest, an id
    with several texts with the first in order. The chosen ids are at most a few thousand, so they
    are broadcast to the scan of documents, and as many rows of statistics are collected.
    """
    usable = labels.select("doc_id", "quality").where(
        F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))
    )
    n = usable.count()
    share = F.lit(min(1.0, sample / max(n, 1)))
    chosen = usable.where(hashed_share(F.col("doc_id"), share)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    wanted = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    wanted = wanted.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def stats(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "x": _stats_of(batch).tolist()}

    rows = map_arrow(wanted, stats, "doc_id bigint, quality int, x array<double>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return fit(x, (rows["quality"].to_numpy() > 0).astype(float))


def predict(docs: DataFrame, model: BoostedTrees) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. Null and empty texts are scored by
    their all-zero statistics; a null doc_id stays null and is not held out; repeated rows give
    repeated results; very long texts are read whole; an empty table gives none. Other columns are
    not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> dict:
        p = shared.value.score(_stats_of(batch))
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": p, "predicted": (p >= 0.5).astype(np.int32)}

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_arrow(rows, score, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: BoostedTrees, least: float = 0.5) -> DataFrame:
    """Documents that score ``least`` or more, a tie with the limit included; all columns stay as they
    are. Null and empty texts are judged by their all-zero statistics, repeated rows alike, very long
    texts as a whole; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_arrow(docs, lambda batch: shared.value.score(_stats_of(batch)) >= least)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labelled documents not held out."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs, table(spark, sf_dir, "labels")))
