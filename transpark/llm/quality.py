"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text are counts that numpy takes from its bytes, words and lines. The trees are
fitted on a bounded sample of labelled rows of the training folds (``SAMPLE_ROWS``, chosen by a hash of
the id): features are binned by quantiles, every node's gradient histograms give its best split, and
all trees have one depth, so that a forest is four arrays and a batch walks it level by level.

Null and empty texts have all statistics zero and are scored like any other text. Without labels, or
with labels of one class only, the score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transpark.llm.common import fold_of, map_batches, table, texts, word_hashes

SAMPLE_ROWS = 20_000  # labelled rows to fit on, in expectation
FOLDS, HELD_OUT = 3, 1  # rows with crc32(doc_id as text) % 3 = 1 are never learnt from

_CLASSES = {
    "lower": bytes(range(97, 123)),
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "stop": b".!?",
    "comma": b",;:",
    "quote": b"\"'`()-",
    "markup": b"<>{}[]=/\\_",
    "symbol": b"#$%&*+@^~",
    "bar": b"|",
    "high": bytes(range(128, 256)),
}
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _i, _chars in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_chars)] = _i
FEATURES = [
    "log_bytes", "log_words", "log_lines", "byte_entropy", *(f"share_{k}" for k in _CLASSES),
    "word_length", "word_length_spread", "distinct_words", "top_word", "word_after_itself", "distinct_pairs",
    "line_length", "longest_line", "repeated_lines", "finished_lines", "long_words",
]


def statistics(text: str) -> list[float]:
    """The features of one text, in the order of ``FEATURES``."""
    data = text.encode("utf-8", "surrogatepass")
    tokens = data.split()
    if not tokens:
        return [0.0] * len(FEATURES)
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = np.bincount(_CLASS_OF, counts, len(_CLASSES) + 1)[:-1] / n
    p = counts[counts > 0] / n
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    h = word_hashes(tokens)
    w = len(tokens)
    _, times = np.unique(h, return_counts=True)
    pairs = len(np.unique(h[1:] * np.uint64(3) + h[:-1])) if w > 1 else 1
    lines = data.split(b"\n")
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines)
    return [
        math.log1p(n), math.log1p(w), math.log1p(len(lines)), float(-(p * np.log2(p)).sum()), *shares,
        float(lengths.mean()), float(lengths.std()), len(times) / w, times.max() / w, float((h[1:] == h[:-1]).mean()) if w > 1 else 0.0, pairs / max(1, w - 1),
        n / len(lines), max(map(len, lines)) / n, 1 - len(set(lines)) / len(lines), ends / len(lines), float((lengths > 25).mean()),
    ]


@dataclass
class Forest:
    """Complete trees of one depth: node i has the children 2i+1 (value <= cut) and 2i+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row of ``x``."""
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1] if len(self.feature) else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:  # all rows are on one level
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, weight: float = 1.0, least: float = 2.0) -> Forest:
    """Boosted trees for labels 0/1: second-order gains on binned features, ridge ``weight`` on leaves,
    at least ``least`` of hessian in a child."""
    n, m = x.shape
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if n else 0.5
    base = math.log(share / (1 - share))
    inner, leaves = 2**depth - 1, 2**depth
    if n == 0 or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # bin b: value <= edges[b]
    margin = np.full(n, base)
    out = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)  # position within the level
        for level in range(depth):
            k = 2**level
            best = np.full(k, 1e-9)
            feature, cut_bin, cut = np.zeros(k, np.int64), np.full(k, bins), np.full(k, np.inf)
            for j in range(m):
                if not len(edges[j]):
                    continue
                cell = at * bins + binned[:, j]
                gl = np.cumsum(np.bincount(cell, g, k * bins).reshape(k, bins), 1)
                hl = np.cumsum(np.bincount(cell, h, k * bins).reshape(k, bins), 1)
                ga, ha = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + weight) + (ga - gl) ** 2 / (ha - hl + weight) - ga**2 / (ha + weight)
                gain[(hl < least) | (ha - hl < least)] = 0
                gain = gain[:, : len(edges[j])]
                top = gain.argmax(1)
                better = gain[np.arange(k), top] > best
                best[better] = gain[np.arange(k), top][better]
                feature[better], cut_bin[better], cut[better] = j, top[better], edges[j][top][better]
            first = k - 1
            out[0][t, first : first + k], out[1][t, first : first + k] = feature, cut
            at = 2 * at + (binned[np.arange(n), feature[at]] > cut_bin[at])
        gs, hs = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
        out[2][t] = -rate * gs / (hs + weight)
        margin += out[2][t][at]
    return Forest(base, *out)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, text, label`` of about ``rows`` labelled documents of the training folds, chosen by a
    hash of the id (all of them where there are fewer)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold_of("doc_id", FOLDS) != HELD_OUT)).distinct()
    share = min(1.0, rows / max(1, known.count()))
    chance = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / float(1 << 53)  # of any share, however small
    known = known.where(chance < share) if share < 1 else known
    # at most about SAMPLE_ROWS rows of two numbers: broadcast
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([statistics(t) for t in texts(batch)], float).reshape(-1, len(FEATURES))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Forest:
    """Fit the trees on the bounded sample; only its features (some 30 doubles a row) come to the driver."""
    sample = labelled_sample(docs, labels, label, rows)
    got = map_batches(sample, lambda b: {"label": b.column("label"), "x": list(_features(b))}, "label int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, got["label"].to_numpy()])  # the same sums whatever order rows came in
    return fit_forest(x[order], got["label"].to_numpy(float)[order])


def score_quality(docs: DataFrame, model: Forest, columns: list[str] | None = None) -> DataFrame:
    """``doc_id`` (or ``columns``) and ``score`` of every document."""
    columns = columns or ["doc_id"]
    keep = docs.select(*columns, *([] if "text" in columns else ["text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema) + ", score double"
    return map_batches(keep, lambda b: {c: b.column(c) for c in columns} | {"score": model.predict(_features(b))}, schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
