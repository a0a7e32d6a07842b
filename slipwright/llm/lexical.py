"""Ranked lexical search: maximum inner products by buckets of norms, rescored exactly in whole numbers.

A document is a vector of impacts, one for each of its terms; a query is a vector of term weights times repeats; a
score is their inner product. Documents that come to a task are ordered by the length of their vectors and cut into
buckets of similar length. For a query with a known twentieth best score t

* a bucket whose longest vector times the query's length stays below t is skipped (Cauchy-Schwarz), and so are all
  behind it;
* inside a bucket each of the query's terms has a bound, its weight times the bucket's largest impact of the term. Terms
  with the smallest bounds, whose sum stays below t, can't bring a document there alone, so documents without any other
  term are left out. The others' impacts are added up term by term, from the largest bound down, and those whose sum
  and the bounds still open stay below t go;
* the survivors' scores are whole numbers, and the best are kept for the next bucket.

Lengths are of vectors scaled by the square roots of the weights, which leaves inner products as they are. Bounds in
doubles are widened by a millionth, so rounding prunes nothing that belongs to the result.

Queries go to executors in blocks of at most ``block_bytes`` of text (or one item), so no broadcast grows with the
benchmark; every block is two scans of the documents, one for the counts and one for the scores. Documents aren't
shuffled: a task returns at most ``k`` rows for each item, and these are combined in two steps.

Defined cases: null and empty texts have no terms, and are in no result; items without terms, or whose terms occur
nowhere, have no rows; every row of the benchmark is an item of its own, repeated or not; documents of equal score
are ranked by doc_id, null first; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored, text_slices, texts_of
from .decontaminate import words_of as terms_of

K = 20
BLOCK_BYTES = 4 << 20
ITEM_BYTES = 64
#: Documents of a norm bucket, and of the vectors that a task holds at a time.
BUCKET = 1024
HELD = 8192
HELD_TERMS = 4_000_000
WIDER = 1 + 1e-6


def weight(n_docs: int, df: int) -> int:
    """A term's weight: floor(1000 ln((2 N + 2) / (2 df + 1))), at least 0 as df is at most N."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: int, n_docs: int, n_terms: int) -> int:
    """The m of a document with n terms."""
    return 100 - 25 + 25 * n * n_docs // n_terms


class Block:
    """The queries of a block: their terms by number and, once weighted, their vectors."""

    def __init__(self, items: list[tuple[int, str | None]]):
        number: dict[bytes, int] = {}
        self.items = []
        for key, text in items:
            counted = Counter(terms_of(text or ""))
            self.items.append((key, [(number.setdefault(t, len(number)), c) for t, c in counted.items()]))
        self.vocabulary = number

    def vectors(self, weights: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(key, term numbers, weights times repeats) of the items that have a term of weight above 0."""
        out = []
        for key, terms in self.items:
            ids = np.array([t for t, _ in terms], np.int64)
            q = weights[ids] * np.array([c for _, c in terms], np.int64) if len(ids) else ids
            if (q > 0).any():
                out.append((key, ids[q > 0], q[q > 0]))
        return out


class Vectors:
    """Documents of a task as sparse vectors over the block's vocabulary, ordered by length, longest first."""

    def __init__(self, ids: list[int | None], rows: list[dict[int, int]], m: list[int], weights: np.ndarray):
        sizes = np.array([len(r) for r in rows])
        term = np.fromiter((t for r in rows for t in r), np.int64, int(sizes.sum()))
        tf = np.fromiter((c for r in rows for c in r.values()), np.int64, int(sizes.sum()))
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(np.array(m, np.int64), sizes))
        doc = np.repeat(np.arange(len(rows)), sizes)
        norm = np.sqrt(np.bincount(doc, weights[term] * impact.astype(np.float64) ** 2, len(rows)))
        order = np.argsort(-norm, kind="stable")
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        self.norm, self.ids = norm[order], np.array([d or 0 for d in ids], np.int64)[order]
        self.named = np.array([d is not None for d in ids], bool)[order]
        # impacts by bucket, then term, then document
        doc = place[doc]
        bucket = doc // BUCKET
        by = np.lexsort((doc, term, bucket))
        self.doc, self.term, self.impact = doc[by], term[by], impact[by]
        self.edges = np.searchsorted(bucket[by], np.arange(-(-len(rows) // BUCKET) + 1))

    def search(self, terms: np.ndarray, q: np.ndarray, weights: np.ndarray, best: list[tuple], k: int) -> list[tuple]:
        """The ``k`` best of (score, doc_id is not null, doc_id) in ``best`` and these documents."""
        length = math.sqrt(float((q.astype(np.float64) ** 2 / weights[terms]).sum()))
        for b in range(len(self.edges) - 1):
            least = best[-1][0] if len(best) == k else 0
            if self.norm[b * BUCKET] * length * WIDER < max(least, 1):
                break
            best = self._bucket(b, terms, q, best, least, k)
        return best

    def _bucket(self, b: int, terms: np.ndarray, q: np.ndarray, best: list, least: int, k: int) -> list[tuple]:
        lo, hi = self.edges[b], self.edges[b + 1]
        own = self.term[lo:hi]
        first, last = lo + np.searchsorted(own, terms), lo + np.searchsorted(own, terms, side="right")
        held = last > first
        if not held.any():
            return best
        first, last, q = first[held], last[held], q[held]
        bound = q * np.array([self.impact[x:y].max() for x, y in zip(first, last)])
        order = np.argsort(-bound, kind="stable")
        left = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # bounds of a term and all behind it
        size = min(BUCKET, len(self.ids) - b * BUCKET)
        score, alive, opened = np.zeros(size, np.int64), np.zeros(size, bool), True
        for at, j in enumerate(order):
            opened = opened and left[at] >= max(least, 1)
            docs = self.doc[first[j] : last[j]] - b * BUCKET
            score[docs] += q[j] * self.impact[first[j] : last[j]]
            if opened:
                alive[docs] = True
            elif at and not at % 8:
                alive &= score + left[at + 1] >= least
                if not alive.any():
                    return best
        found = np.flatnonzero(alive & (score >= max(least, 1)))
        if not len(found):
            return best
        if len(found) > k:  # all that reach the k-th best score
            found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
        at = b * BUCKET + found
        best = best + list(zip(score[found].tolist(), self.named[at].tolist(), self.ids[at].tolist()))
        return sorted(best, key=lambda x: (-x[0], *x[1:]))[:k]


_built: dict[str, Block] = {}


def _block(shared) -> Block:
    """The block of a broadcast, built once in a process."""
    name, items = shared.value
    if name not in _built:
        _built.clear()
        _built[name] = Block(items)
    return _built[name]


def _counter(shared):
    """Per task: the documents with each term, and under -1 and -2 those with any term, and all terms."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, seen, docs, total = _block(shared).vocabulary.get, Counter(), 0, 0
        for batch in text_slices(batches):
            for text in texts_of(batch).to_pylist():
                if terms := terms_of(text):
                    docs, total = docs + 1, total + len(terms)
                    seen.update(map(get, set(terms)))
        seen.pop(None, None)
        rows = [*seen.items(), (-1, docs), (-2, total)]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.int64())], ["term", "n"])

    return count


def _searcher(shared, counts, k: int):
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _block(shared)
        n_docs, n_terms, weights = counts.value
        get, queries, best = block.vocabulary.get, block.vectors(weights), {}
        ids, rows, m, held = [], [], [], 0

        def flush() -> None:
            vectors = Vectors(ids, rows, m, weights)
            for key, terms, q in queries:
                best[key] = vectors.search(terms, q, weights, best.get(key, []), k)
            ids.clear(), rows.clear(), m.clear()

        for batch in text_slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch).to_pylist()):
                terms = terms_of(text)
                known = Counter(map(get, terms))
                known.pop(None, None)
                if known:
                    ids.append(doc_id), rows.append(known), m.append(length_norm(len(terms), n_docs, n_terms))
                    held += len(known)
                if len(ids) >= HELD or held >= HELD_TERMS:
                    flush()
                    held = 0
        if ids:
            flush()
        found = [(key, d if named else None, s) for key, pairs in best.items() for s, named, d in pairs]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["item", "doc_id", "score"])

    return search


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[tuple[int, str | None]], list[object]]]:
    """The items in blocks of bounded size, numbered within the block; the driver holds one block at a time."""
    items, names, size = [], [], 0
    for name, text in benchmark.select("item_id", F.col("text").cast("string")).toLocalIterator():
        if items and size + len(text or "") + ITEM_BYTES > block_bytes:
            yield items, names
            items, names, size = [], [], 0
        items.append((len(items), text))
        names.append(name)
        size += len(text or "") + ITEM_BYTES
    if items:
        yield items, names


def search(docs: DataFrame, benchmark: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, with scores above 0."""
    spark = docs.sparkSession
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind, parts = benchmark.schema["item_id"].dataType.simpleString(), []
    for items, names in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, items))
        counted = bare.select("text").mapInArrow(_counter(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        counts = {r["term"]: r["n"] for r in counted.collect()}  # at most a row for each term of the block
        n_docs, n_terms = counts.pop(-1, 0), counts.pop(-2, 0)
        weights = np.zeros(max(1, len(Block(items).vocabulary)), np.int64)
        for term, df in counts.items():
            weights[term] = weight(n_docs, df)
        known = spark.sparkContext.broadcast((n_docs, n_terms, weights))
        found = bare.mapInArrow(_searcher(shared, known, k), "item long, doc_id long, score long")
        # a task's best, then those of a 64th of the tasks, then of all
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
        found = found.withColumn("lot", F.spark_partition_id() % 64)
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("item", "lot").orderBy(*order))).filter(F.col("rank") <= k)
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"own long, item_id {kind}")
        out = stored(found.join(ids, F.col("item") == F.col("own")).select("item_id", "rank", "doc_id", "score"), "ranked")
        parts.append(out)
        shared.unpersist(), known.unpersist()
    empty = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.union, parts, empty)
