"""Quality classifier: histogram gradient-boosted trees over document statistics, in flat arrays.

Statistics are counts over the whole text (bytes by class, words, repeats, lines); see ``STATISTICS``. Trees are grown
on at most ``max_rows`` labelled documents (those with the smallest hashes of their ids, so any cluster takes the
same): values are put in quantile bins once, each level sums gradients per node and bin, and each tree is laid out as
a complete binary tree in three arrays. Scoring walks all rows of a batch down all trees at once by numpy indexing.

Defined cases: null and empty texts have statistics of zero and a score like any other; rows without a label, and
rows held out, are never learned from; without any label of one of the two classes the score is the share of label 1
(0.5 if there is none at all); repeated rows each count; an empty table gives an empty result; columns other than
doc_id and text are left out, or kept by ``keep_good``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free_names, held_out, text_slices, texts_of

MAX_ROWS = 20_000
THRESHOLD = 0.3
BINS = 64

_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LOWER = np.isin(np.arange(256), np.arange(97, 123))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_HIGH = np.arange(256) >= 128
_SIGN = (np.arange(256) > 32) & (np.arange(256) < 127) & ~(_UPPER | _LOWER | _DIGIT)
_PLAIN = np.isin(np.arange(256), list(b".,;:'\"()-?"))
STATISTICS = [
    "log_bytes", "log_words", "bytes_per_word", "longest_word", "upper", "digit", "space", "high", "sign", "odd_sign", "top_odd_sign", "line_breaks", "distinct_bytes", "entropy",
    "distinct_words", "top_word", "repeats", "distinct_pairs", "distinct_lines", "top_line", "words_per_line", "capital_words", "upper_words", "sign_words", "stops", "short_words",
]


def statistics(text: str) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    if not words:
        return [math.log1p(len(raw))] + [0.0] * (len(STATISTICS) - 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, m = len(raw), len(words)
    letters = max(1, int(counts[_UPPER].sum() + counts[_LOWER].sum()))
    odd = counts * (_SIGN & ~_PLAIN)
    share = counts[counts > 0] / n
    lines = [x for x in text.split("\n") if x]
    seen, seen_lines = Counter(words), Counter(lines)
    repeats = sum(map(str.__eq__, words, words[1:]))
    return [
        math.log1p(n), math.log1p(m), n / m, min(200, max(map(len, seen))), counts[_UPPER].sum() / letters, counts[_DIGIT].sum() / n, counts[_SPACE].sum() / n, counts[_HIGH].sum() / n,
        counts[_SIGN].sum() / n, odd.sum() / n, odd.max() / n, counts[10] / n, len(share), float(-(share * np.log2(share)).sum()),
        len(seen) / m, max(seen.values()) / m, repeats / m, len(set(zip(words, words[1:]))) / m, len(seen_lines) / max(1, len(lines)), max(seen_lines.values(), default=0) / max(1, len(lines)), m / max(1, len(lines)),
        sum(map(str.istitle, words)) / m, sum(map(str.isupper, words)) / m, sum(not w[-1].isalnum() and w[-1] not in ".,;:'\"()-?!" for w in words) / m, (text.count(". ") + text.count(".\n")) / m, sum(len(w) < 4 for w in words) / m,
    ]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(STATISTICS))


class Trees:
    """Boosted complete trees of one depth in flat arrays: node k has children 2k+1 and 2k+2."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, depth: int):
        self.base, self.feature, self.threshold, self.leaf, self.depth = base, feature, threshold, leaf, depth

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        n, trees = len(rows), len(self.leaf)
        if not trees or not n:
            return np.full(n, 1 / (1 + math.exp(-self.base)))
        tree = np.arange(trees)[None, :]
        at, row = np.zeros((n, trees), np.int64), np.arange(n)[:, None]
        for _ in range(self.depth):
            at = 2 * at + 1 + (rows[row, self.feature[tree, at]] > self.threshold[tree, at])
        margin = self.base + self.leaf[tree, at - (2**self.depth - 1)].sum(1)
        return 1 / (1 + np.exp(-margin))


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, ridge: float = 5.0, bins: int = BINS) -> Trees:
    """Newton boosting of the logistic loss on binned columns."""
    share = float(labels.mean()) if len(labels) else 0.5
    if len(labels) == 0 or share in (0.0, 1.0):
        share = min(max(share, 1e-4), 1 - 1e-4)
        return Trees(math.log(share / (1 - share)), np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0)), depth)
    n, width = rows.shape
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)])
    base = math.log(share / (1 - share))
    margin = np.full(n, base)
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = labels - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            nodes = 2**level
            total = None
            best = np.full(nodes, 1e-6), np.zeros(nodes, np.int64), np.full(nodes, bins)
            for f in range(width):
                key = node * bins + binned[f]
                gs = np.bincount(key, g, nodes * bins).reshape(nodes, bins).cumsum(1)
                hs = np.bincount(key, h, nodes * bins).reshape(nodes, bins).cumsum(1)
                total = gs[:, -1:], hs[:, -1:]
                left, right = gs**2 / (hs + ridge), (total[0] - gs) ** 2 / (total[1] - hs + ridge)
                gain = left + right - total[0] ** 2 / (total[1] + ridge)
                gain[(hs < 1) | (total[1] - hs < 1)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(nodes), top] > best[0] + 1e-12
                best[0][better], best[1][better], best[2][better] = gain[np.arange(nodes), top][better], f, top[better]
            for k in range(nodes):
                if best[2][k] < len(edges[best[1][k]]):
                    feature[t, nodes - 1 + k], threshold[t, nodes - 1 + k] = best[1][k], edges[best[1][k]][best[2][k]]
            at = nodes - 1 + node
            node = 2 * node + (rows[np.arange(n), feature[t, at]] > threshold[t, at])
        leaf[t] = rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + ridge)
        margin += leaf[t][node]
    return Trees(base, feature, threshold, leaf, depth)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(text, label) of at most ``max_rows`` rows of ``labels`` that aren't held out, by the hash of their ids.

    Of several documents with a labelled id the one with the smallest hash of its text is taken, so the sample is no
    larger than the labels; partial results are combined before they are shuffled, and no task holds the whole sample.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("_l_id"), F.col(label).cast("double").alias("_l_label")).distinct()
    rows = rows.filter(F.col("_l_id").isNotNull() & F.col("_l_label").isin(0.0, 1.0) & ~held_out(F.col("_l_id")))
    rows = rows.orderBy(F.xxhash64("_l_id"), "_l_id", "_l_label").limit(max_rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most max_rows rows of two numbers
    found = own.join(F.broadcast(rows), F.col("doc_id") == F.col("_l_id"))
    return found.groupBy("_l_id", "_l_label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", F.col("_l_label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Trees:
    """Trees for ``label``; only the statistics of the sampled documents come to the driver."""

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            values = matrix(texts_of(batch).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(values)), batch.column("label")], ["stats", "label"])

    found = labelled_sample(docs, labels, label, max_rows).mapInArrow(compute, "stats array<double>, label double").toPandas()
    rows = np.stack(found["stats"].to_numpy()) if len(found) else np.zeros((0, len(STATISTICS)))
    order = np.lexsort([*rows.T, found["label"].to_numpy()]) if len(found) else []
    return fit(rows[order], found["label"].to_numpy(np.float64)[order])


def with_score(docs: DataFrame, model: Trees, column: str) -> DataFrame:
    """``docs``, all columns, with the score of each whole text."""

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(matrix(texts_of(batch).to_pylist())))], [*batch.schema.names, column])

    return docs.mapInArrow(compute, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """A row per document: doc_id, held_out, score (higher: label 1 likelier), predicted."""
    rows = with_score(docs.select("doc_id", "text"), train(docs, labels, max_rows=max_rows), "score")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """``docs``, all columns, without the documents that are predicted 0."""
    (column,) = free_names(docs, "score")
    return with_score(docs, train(docs, labels, max_rows=max_rows), column).filter(F.col(column) >= threshold).select(*docs.columns)
