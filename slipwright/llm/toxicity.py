"""Toxicity: a logistic model of words and word beginnings, regularised by counterfactuals.

A text's features are the presence of words and of their first 3 to 7 bytes. Over at most ``max_rows`` labelled
documents (those with the smallest hashes of their ids) Spark counts the features, and the ``max_features`` that tell
the labels apart best are kept; only these, and which of them each sampled text has, come to the driver. Labelled
sentences that name a group are copied with the identity term swapped for another one of its line, and the squared
change of the margin is added to the loss (a term in an empty context stands in for those that no labelled text has):
what the model says must not depend on which group is named. The penalty is quadratic, w' (D'D) w for the rows D of
changed features, so tasks add up D'D, a table of at most (max_features + 1) squared numbers whatever the number of
swaps, and Newton steps solve the whole. Terms are of the four languages English, German, French and Spanish.

Defined cases: null and empty texts have no feature and get the score of the intercept; held-out and unlabelled rows
are never learned from; without labels of both classes the score is the share of label 1 (0 if there is none);
repeated rows each count; an empty table gives an empty result; columns other than doc_id and text are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stored, text_slices, texts_of
from .decontaminate import words_of
from .quality import labelled_sample

MAX_ROWS = 20_000
MAX_FEATURES = 384
MIN_ROWS = 3
THRESHOLD = 0.5
BEGINNINGS = range(3, 8)

# Words that name groups of people; any of a line may stand for any other of it.
IDENTITY_TERMS = [
    "women men girls boys female male woman man".split(),
    "muslim christian jewish hindu buddhist atheist catholic protestant".split(),
    "black white asian african latino arab european american".split(),
    "gay straight lesbian bisexual transgender heterosexual".split(),
    "old young elderly disabled blind deaf".split(),
    "immigrant refugee foreigner citizen".split(),
    "frauen männer mädchen jungen frau mann".split(),
    "muslime christen juden hindus buddhisten atheisten".split(),
    "einwanderer flüchtlinge ausländer bürger".split(),
    "femmes hommes filles garçons femme homme".split(),
    "musulmans chrétiens juifs hindous bouddhistes athées".split(),
    "immigrés réfugiés étrangers citoyens".split(),
    "mujeres hombres niñas niños mujer hombre".split(),
    "musulmanes cristianos judíos hindúes budistas ateos".split(),
    "inmigrantes refugiados extranjeros ciudadanos".split(),
]
SENTENCE_ENDS = re.compile(r"[.!?\n。！？]+")


def features_of(word: bytes) -> list[bytes]:
    return [b"=" + word, *(word[:k] for k in BEGINNINGS if k <= len(word))]


class Model:
    """Weights of features; remembers which features a word has."""

    def __init__(self, names: list[bytes], weights: np.ndarray, intercept: float):
        self.index = {name: k for k, name in enumerate(names)}
        self.weights, self.intercept, self.known = weights, intercept, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def of_word(self, word: bytes) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            found = self.known[word] = tuple(self.index[f] for f in features_of(word) if f in self.index)
        return found

    def rows(self, words: Iterable[bytes]) -> set[int]:
        out: set[int] = set()
        for found in map(self.of_word, words):
            if found:
                out.update(found)
        return out

    def score(self, text: str) -> float:
        margin = self.intercept + sum(self.weights[k] for k in sorted(self.rows(set(words_of(text)))))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, margin))))


def swaps(words: set[bytes], terms: list[list[str]] = IDENTITY_TERMS) -> Iterator[tuple[bytes, bytes]]:
    """(term among the words, each other term of its line)."""
    for line in terms:
        for a in line:
            if a.encode() in words:
                yield from ((a.encode(), b.encode()) for b in line if b != a)


def changes(plain: Model, text: str) -> Iterator[tuple[list[int], list[int]]]:
    """For each sentence of a text and each swap of its identity terms: the features that go and that come."""
    for sentence in SENTENCE_ENDS.split(text):
        words = set(words_of(sentence))
        own = None
        for a, b in swaps(words):
            own = plain.rows(words) if own is None else own
            other = plain.rows((words - {a}) | {b})
            if other != own:
                yield sorted(own - other), sorted(other - own)


def add_changes(gram: dict[tuple[int, int], float], found: Iterable[tuple[list[int], list[int]]]) -> None:
    """Adds each change's outer product to the sparse table ``gram``."""
    for less, more in found:
        signed = [(k, -1.0) for k in less] + [(k, 1.0) for k in more]
        for i, x in signed:
            for j, y in signed:
                gram[i, j] = gram.get((i, j), 0.0) + x * y


def fit(names: list[bytes], rows: list[list[int]], labels: np.ndarray, gram: dict[tuple[int, int], float], ridge: float = 0.3, fair: float = 20.0, steps: int = 25) -> Model:
    """A model of the features ``names``; rows: the features of each text; gram: the sum over all swaps of the outer
    product of what they change; ``fair`` weighs the penalty on it."""
    n, positive, width = len(rows), float(labels.sum()), len(names)
    if n == 0 or positive in (0.0, float(n)):
        share = min(max(positive / n if n else 0.0, 1e-6), 1 - 1e-6)
        return Model([], np.zeros(0), math.log(share / (1 - share)))
    x = np.zeros((n, width + 1), np.float32)
    x[:, width] = 1
    for k, row in enumerate(rows):
        x[k, row] = 1
    penalty = np.eye(width + 1) * ridge
    penalty[width, width] = 1e-6
    for (i, j), value in gram.items():
        penalty[i, j] += fair * value
    w = np.zeros(width + 1)
    w[width] = math.log(positive / (n - positive))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30).astype(np.float64)))
        slope = (p - labels).astype(np.float32) @ x + penalty @ w
        curve = np.zeros_like(penalty)
        for k in range(0, n, 2048):
            part = x[k : k + 2048]
            curve += (part * (p[k : k + 2048] * (1 - p[k : k + 2048]) + 1e-6)[:, None].astype(np.float32)).T @ part
        step = np.linalg.solve(curve + penalty, slope)
        w -= step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-4:
            break
    return Model(names, w[:width], float(w[width]))


def telling_features(sample: DataFrame, max_features: int = MAX_FEATURES, min_rows: int = MIN_ROWS) -> list[bytes]:
    """The features whose share of label 1 is furthest from that of all rows, in standard errors."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        for batch in text_slices(batches):
            for text, label in zip(texts_of(batch).to_pylist(), batch.column("label").to_pylist()):
                for f in {f for w in set(words_of(text)) for f in features_of(w)}:
                    found = seen.setdefault(f, [0, 0])
                    found[0] += 1
                    found[1] += int(label)
            if len(seen) > 300_000:
                yield _counted(seen)
                seen = {}
        yield _counted(seen)

    counts = sample.mapInArrow(count, "feature binary, n long, y long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    share, rows = sample.agg(F.avg("label"), F.count("*")).first()
    if not rows or share in (0.0, 1.0):
        return []
    rank = F.abs(F.col("y") - share * F.col("n")) / F.sqrt(F.col("n") * (share * (1 - share)))
    best = counts.filter(F.col("n") >= min_rows).orderBy(rank.desc(), "feature").limit(max_features)
    return sorted(bytes(r["feature"]) for r in best.collect())  # at most max_features


def _counted(seen: dict[bytes, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))], ["feature", "n", "y"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    sample = stored(labelled_sample(docs, labels, "toxic", max_rows), "labelled")
    names = telling_features(sample, max_features)
    plain = Model(names, np.zeros(len(names)), 0.0)

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The kept features of each text."""
        for batch in text_slices(batches):
            own = [sorted(plain.rows(set(words_of(text)))) for text in texts_of(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), batch.column("label")], ["own", "label"])

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The table of changes of a task's texts."""
        gram: dict[tuple[int, int], float] = {}
        for batch in text_slices(batches):
            for text in texts_of(batch).to_pylist():
                add_changes(gram, changes(plain, text))
        cells = sorted(gram.items())
        columns = [[i for (i, _), _ in cells], [j for (_, j), _ in cells]]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array([v for _, v in cells], pa.float64())], ["i", "j", "v"])

    # at most max_rows rows of at most max_features numbers, and max_features squared cells
    found = sorted((r["own"], r["label"]) for r in sample.mapInArrow(compute, "own array<int>, label double").collect())
    cells = sample.mapInArrow(add_up, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    gram = {(r["i"], r["j"]): r["v"] for r in cells}
    # a term in an empty context stands in for the terms that no labelled text has
    add_changes(gram, ((sorted(plain.rows([a.encode()])), sorted(plain.rows([b.encode()]))) for line in IDENTITY_TERMS for a in line for b in line if b > a))
    return fit(names, [own for own, _ in found], np.array([y for _, y in found], np.float64), gram)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """A row per document: doc_id, held_out, score (higher: label 1 likelier), predicted."""
    model = train(docs, labels, max_rows)

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.score(t) for t in texts_of(batch).to_pylist()], pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(compute, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
