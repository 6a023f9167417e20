"""Document quality: histogram gradient-boosted trees over document statistics.

Statistics of the whole text (lengths, character classes, repetition of words and lines, symbols) are binned by
quantiles; trees of fixed depth are grown level by level from histograms of gradients, in numpy on the driver. All trees
are flattened into arrays of features, thresholds and leaf values, and a batch of documents walks all trees at once.

The classifier is fitted on at most `sample` labelled documents (the first by hash of their id); their statistics, not
their texts, come to the driver.

Defined results: null texts count as empty, and empty texts are scored from statistics that are all zero; null labels are
not learnt from; without a labelled row every score is 0.5; a label repeated is learnt from as often as it stands there;
null ids are scored, with held_out null; an empty table gives an empty result. Columns other than id and text are not
read by the scorer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, read, remainder, texts

BINS, DEPTH = 64, 4

_CLASS = np.zeros(256, np.int64)
for _low, _high, _k in ((97, 123, 1), (65, 91, 2), (48, 58, 3), (128, 256, 4), (33, 48, 5), (58, 65, 5), (91, 97, 5), (123, 127, 5)):
    _CLASS[_low:_high] = _k
_CLASS[[32, 9, 11, 12, 13]] = 6
_CLASS[10] = 7
#: Marks that end or part sentences; other marks count as symbols.
_SENTENCE = np.frombuffer(b".,;:?'\"()-", np.uint8)
FEATURES = 26


def statistics(text: bytes | None) -> np.ndarray:
    """FEATURES numbers of one whole text."""
    out = np.zeros(FEATURES)
    text = text or b""
    n = len(text)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = np.bincount(_CLASS, weights=counts, minlength=8) / n
    sentence = counts[_SENTENCE].sum() / n
    present = counts[counts > 0] / n
    out[0], out[1:8] = np.log1p(n), classes[1:8]
    out[8], out[9] = sentence, classes[5] - sentence
    out[10] = -(present * np.log(present)).sum()
    out[11] = counts[33:127][_CLASS[33:127] == 5].max() / n
    out[24] = counts[33] / n
    out[25] = counts[124] / n
    words = text.split()
    if words:
        m = len(words)
        lengths = np.fromiter(map(len, words), np.int64, m)
        distinct = len(set(words))
        out[12], out[13], out[14], out[15] = np.log1p(m), lengths.mean(), lengths.std(), lengths.max()
        out[16] = distinct / m
        out[17] = (lengths == 1).mean()
        out[18] = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128) / m
        out[19] = 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / max(m - 2, 1) if m > 2 else 0.0
        out[20] = sum(1 for w in words if w.isupper()) / m
    lines = text.split(b"\n")
    out[21], out[22], out[23] = np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), n / len(lines)
    return out


@dataclass
class Forest:
    """Trees in heap order: features and thresholds (trees, 2^depth - 1), leaves (trees, 2^depth)."""

    base: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        if len(self.features):
            trees = np.arange(len(self.features))[None, :]
            at = np.zeros((len(x), len(self.features)), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (np.take_along_axis(x, self.features[trees, at], axis=1) > self.thresholds[trees, at])
            z = z + self.leaves[trees, at - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 150, rate: float = 0.1, smoothing: float = 1.0, least: float = 1.0) -> Forest:
    """Logistic boosting. Each level of a tree takes one histogram of gradients and curvatures per feature."""
    n, f = x.shape
    if not n:
        return Forest(0.0, np.zeros((0, 15), np.int64), np.zeros((0, 15)), np.zeros((0, 16)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    p0 = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(p0 / (1 - p0)))
    z = np.full(n, base)
    inner, leafs = 2**DEPTH - 1, 2**DEPTH
    features, thresholds, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leafs))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            local = node - first
            gains, where = np.full((width, f), -np.inf), np.zeros((width, f), np.int64)
            for j in range(f):
                cell = local * BINS + binned[:, j]
                gl = np.bincount(cell, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hl = np.bincount(cell, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + smoothing) + (gt - gl) ** 2 / (ht - hl + smoothing) - gt**2 / (ht + smoothing)
                gain[(hl < least) | (ht - hl < least)] = -np.inf
                gain[:, len(cuts[j]) :] = -np.inf
                where[:, j] = gain.argmax(axis=1)
                gains[:, j] = gain.max(axis=1)
            best = gains.argmax(axis=1)
            for k in range(width):
                if gains[k, best[k]] > 1e-9:
                    j = best[k]
                    features[t, first + k], thresholds[t, first + k] = j, cuts[j][where[k, j]]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > thresholds[t, node])
        leaf = node - inner
        leaves[t] = rate * np.bincount(leaf, g, leafs) / (np.bincount(leaf, h, leafs) + smoothing)
        z += leaves[t][leaf]
    return Forest(base, features, thresholds, leaves)


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep and `x`, the statistics of the text."""
    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [statistics(t) for t in texts(batch.column(len(keep)))]
            return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

        return step

    return map_texts(docs.select(*keep, F.col(text_col).cast("string").alias("text")), make, f"{fields}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 40_000, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Fit on at most `sample` rows of labels, the first by hash of the id; rows held out must not be in `labels`."""
    some = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id"), F.col(label).cast("double").alias("__y"))
    some = some.orderBy(F.xxhash64("__id"), "__id", "__y").limit(sample)
    joined = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(some), "__id")
    got = with_statistics(joined, ["__id", "__y"]).toPandas().sort_values(["__id", "__y"], kind="stable")
    return grow(np.array(got["x"].tolist()).reshape(-1, FEATURES), got["__y"].to_numpy())


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def make():
        own = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([statistics(t) for t in texts(batch.column(1))])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores(x), pa.float64())], ["doc_id", "score"])

        return step

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "doc_id long, score double")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    forest = fit(docs, read(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    return score(docs, forest).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
