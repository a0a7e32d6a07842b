"""Benchmark decontamination: a broadcast set of normalised benchmark n-grams, scanned over all token windows.

Words are maximal runs of characters outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. A window is
``n`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A document's word
inside any occurrence of a window is hit; a document is contaminated if hit words are at least one in ``one_in``.

The benchmark goes to executors in blocks of at most ``block_bytes`` of text (or one item), so no broadcast grows with
it. A block is two arrays of numbers a word and one a window (about 20 bytes for each word, besides its distinct words),
built once in a worker process. A benchmark of one block is found by one map over the documents. Of a larger one each
block is a job of its own over the documents, whose hits are written to the shared folder before its broadcast is
dropped; at last the hits of all blocks are united by document and joined to the documents.
Window hashes only nominate; each hit is verified by the words themselves.

Defined cases: null and empty texts have no words and are clean; an empty benchmark leaves all clean; benchmark items
without words have no window; repeated documents each have their own row; repeated item_ids count once; null item_ids
count as the item "null" if their windows occur. Other columns of ``docs`` are kept by ``remove_contaminated`` and
``remove_spans`` whatever their names are (working columns take names that are free).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import free_names, stored, text_slices, texts_of

N = 13
ONE_IN = 20
BLOCK_BYTES = 16 << 20
#: Windows that are held as whole rows at a time.
CHUNK = 100_000

#: Byte by byte: A-Z to lower case, other ASCII but digits and letters to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class Windows:
    """All windows of a block of benchmark items: their words as one array of numbers, and by window length the sorted
    hashes of the distinct windows, where each stands in it, and the items that have it.

    Equal windows are one, however many items share a passage or however often an item repeats a word, so a document's
    word sequence is compared once."""

    def __init__(self, items: list[tuple[str, str | None]], n: int = N):
        self.vocabulary: dict[bytes, int] = {}
        number, self.names, parts, by_size, at = self.vocabulary.setdefault, [], [], {}, 0
        for name, text in items:
            ids = np.array([number(w, len(self.vocabulary)) for w in words_of(text or "")], np.int32)
            if len(ids):
                by_size.setdefault(min(n, len(ids)), []).append((at, len(ids), len(self.names)))
                parts.append(ids)
                at += len(ids)
                self.names.append(name)
        self.words = np.concatenate([np.zeros(0, np.int32), *parts])
        del parts
        rng = np.random.default_rng(20)
        codes = rng.integers(1, 2**63, max(1, len(self.vocabulary)), dtype=np.uint64)
        self.codes, self.sizes = codes, []
        for size, found in sorted(by_size.items()):
            starts = np.concatenate([np.arange(a, a + m - size + 1) for a, m, _ in found])
            owners = np.repeat(np.array([k for _, _, k in found], np.int32), [m - size + 1 for _, m, _ in found])
            views = np.lib.stride_tricks.sliding_window_view(self.words, size)
            hashes = np.concatenate([self.hash(views[s].T) for s in np.array_split(starts, 1 + len(starts) // CHUNK)])
            order = np.argsort(hashes, kind="stable")
            hashes, starts, owners = hashes[order], starts[order], owners[order]
            # a window is new if it isn't the one before; windows of one hash that differ may be listed more than once
            same = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
            equal = [(views[starts[s]] == views[starts[s - 1]]).all(1) for s in np.array_split(same, 1 + len(same) // CHUNK)]
            new = np.ones(len(hashes), bool)
            new[same] = ~np.concatenate(equal)
            window, owner = np.divmod(np.unique((np.cumsum(new) - 1) * len(self.names) + owners), len(self.names))
            first = np.searchsorted(window, np.arange(int(new.sum()) + 1))
            self.sizes.append((size, hashes[new], starts[new].astype(np.int32), first, owner.astype(np.int32)))

    def hash(self, columns: np.ndarray) -> np.ndarray:
        out = np.zeros(columns.shape[1], np.uint64)
        for c in columns:
            out = out * np.uint64(0x9E3779B97F4A7C15) + self.codes[c]
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Stretches [start, end) of hit words, in order and apart, and the items that occur."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))
        known = np.flatnonzero(ids >= 0)
        if not len(known):
            return [], set()
        edge = np.flatnonzero(np.diff(known) > 1)
        starts, ends = known[np.concatenate([[0], edge + 1])], known[np.concatenate([edge, [len(known) - 1]])] + 1
        opens, items = np.zeros(len(words) + 1, np.int64), []
        for size, hashes, places, first, owners in self.sizes:
            held = []
            for a, b in zip(starts[ends - starts >= size].tolist(), ends[ends - starts >= size].tolist()):
                for x in range(a, b - size + 1, CHUNK):
                    at, windows = self._found(ids[x : min(b, x + CHUNK + size - 1)], size, hashes, places)
                    np.add.at(opens, x + at, 1)
                    np.add.at(opens, x + at + size, -1)
                    held.append(np.unique(windows))
            for w in np.unique(np.concatenate([np.zeros(0, np.int64), *held])).tolist():
                items.append(owners[first[w] : first[w + 1]])
        hit = np.concatenate([[False], np.cumsum(opens)[:-1] > 0, [False]])
        turns = np.flatnonzero(hit[1:] != hit[:-1])
        names = np.unique(np.concatenate(items)).tolist() if items else []
        return list(zip(turns[::2].tolist(), turns[1::2].tolist())), {self.names[j] for j in names}

    def _found(self, ids: np.ndarray, size: int, hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` a window stands, and which: hashes nominate, words decide."""
        view = np.lib.stride_tricks.sliding_window_view(ids, size)
        own = self.hash(view.T)
        low = np.searchsorted(hashes, own)
        at = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == own)
        low, found, which = low[at], [], []
        while len(at):  # once, but for windows of one hash that differ
            same = (self.words[places[low, None] + np.arange(size)] == view[at]).all(1)
            found.append(at[same]), which.append(low[same])
            low, more = low + 1, low + 1 < len(hashes)
            more[more] = hashes[low[more]] == own[at[more]]
            at, low = at[more], low[more]
        return np.concatenate([np.zeros(0, np.int64), *found]), np.concatenate([np.zeros(0, np.int64), *which])


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's items in blocks of bounded size; the driver holds one block at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text").cast("string"))
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        if block and size + len(text or "") > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text or "")
    if block:
        yield block


_STATE = "array<struct<a:long,b:long>>"
_built: dict[str, Windows] = {}


def _windows(shared) -> Windows:
    """The windows of a broadcast block, built once in a process; it keeps those of the last block alone."""
    name, block, n = shared.value
    if name not in _built:
        _built.clear()
        _built[name] = Windows(block, n)
    return _built[name]


class Names:
    """Names of working columns that ``docs`` doesn't have."""

    def __init__(self, docs: DataFrame):
        self.words, self.runs, self.items, self.id, self.hash = free_names(docs, "words", "runs", "items", "id", "hash")


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, Names]:
    """``docs`` with three columns more, and what they are called: the number of words, the stretches of hit words
    [a, b) in words, and the ids of the items that occur, sorted as strings.

    One block of benchmark is a map over rows, without a shuffle. With more blocks rows are joined with the hits by
    doc_id and hash of the text: documents without a hit go through the join as they are.
    """
    names, spark = Names(docs), docs.sparkSession
    blocks = benchmark_blocks(benchmark, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    new = [StructField(names.words, LongType()), StructField(names.runs, _type(_STATE)), StructField(names.items, _type("array<string>"))]
    share = spark.sparkContext.broadcast
    if second is None:
        return docs.mapInArrow(_scanner(share((uuid.uuid4().hex, first, n)), [f.name for f in new]), StructType([*docs.schema.fields, *new])), names
    key = {names.id: F.col("doc_id").cast("long"), names.hash: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))}
    bare = docs.select(F.col("text").cast("string").alias("text"), *[c.alias(k) for k, c in key.items()])
    parts = []
    for block in chain([first, second], blocks):
        shared = share((uuid.uuid4().hex, block, n))
        own = bare.mapInArrow(_scanner(shared, [f.name for f in new]), StructType([*bare.schema.fields, *new])).filter(F.size(names.items) > 0)
        parts.append(stored(own.drop("text", names.words).distinct(), "hits"))
        shared.unpersist()
    hits = reduce(DataFrame.union, parts).groupBy(names.id, names.hash)
    spans = hits.agg(F.flatten(F.collect_list(names.runs)).alias(names.runs), F.array_sort(F.array_distinct(F.flatten(F.collect_list(names.items)))).alias(names.items))
    spans = spans.withColumn(names.runs, _united(F.col(names.runs))).withColumnsRenamed({names.id: "own_id", names.hash: "own_hash"})
    rows = docs.withColumns(key)
    joined = rows.join(spans, rows[names.id].eqNullSafe(spans.own_id) & (rows[names.hash] == spans.own_hash), "left")
    none = {names.runs: F.coalesce(spans[names.runs], F.array().cast(_STATE)), names.items: F.coalesce(spans[names.items], F.array().cast("array<string>"))}
    counted = joined.select(*[rows[c] for c in docs.columns], n_words(rows["text"]).alias(names.words), *[c.alias(k) for k, c in none.items()])
    return counted, names


def _type(text: str):
    return StructType.fromDDL(f"x {text}")["x"].dataType


def n_words(text: Column) -> Column:
    """The number of words of a text."""
    words = F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.size(F.filter(words, lambda w: w != "")).cast("long")


def _united(runs: Column) -> Column:
    """Stretches in order and apart: those of other blocks may overlap."""
    start = F.array().cast(_STATE)

    def step(done: Column, r: Column) -> Column:
        meets = (F.size(done) > 0) & (r["a"] <= F.try_element_at(done, F.lit(-1))["b"])
        longer = F.struct(F.try_element_at(done, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(done, F.lit(-1))["b"], r["b"]).alias("b"))
        return F.when(meets, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(runs), start, step)


def _scanner(shared, columns: list[str]):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(shared)
        for batch in text_slices(batches):
            counts, runs, items = [], [], []
            for text in texts_of(batch).to_pylist():
                words = words_of(text)
                hit, found = windows.scan(words)
                counts.append(len(words))
                runs.append([{"a": a, "b": b} for a, b in hit])
                items.append(sorted(found))
            new = [pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *columns])

    return scan


_RUNS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def n_hit(runs: str) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])


def _contaminated(names: Names, one_in: int) -> Column:
    return (n_hit(names.runs) > 0) & (n_hit(names.runs) * one_in >= F.col(names.words))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, one_in: int = ONE_IN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, runs (hit words)."""
    found, names = find_hits(docs.select("doc_id", "text"), benchmark, n, block_bytes)
    return found.select(
        "doc_id",
        F.col(names.words).alias("n_words"),
        n_hit(names.runs).alias("n_hit"),
        F.size(names.items).cast("long").alias("n_items"),
        F.sha2(F.array_join(names.items, ",").cast("binary"), 256).alias("items_sha256"),
        _contaminated(names, one_in).alias("contaminated"),
        F.col(names.runs).alias("runs"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, one_in: int = ONE_IN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without its contaminated documents, all columns kept."""
    found, names = find_hits(docs, benchmark, n, block_bytes)
    return found.filter(~_contaminated(names, one_in)).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the hit stretches cut out of their texts (from a stretch's first word to its last); n_chars follows."""
    found, names = find_hits(docs, benchmark, n, block_bytes)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = batch.column("text").to_pylist()
            for i, runs in enumerate(batch.column(names.runs).to_pylist()):
                if runs:
                    texts[i] = without(texts[i], [(r["a"], r["b"]) for r in runs])
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    kept = found.mapInArrow(cut, found.schema).select(*docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def without(text: str, runs: list[tuple[int, int]]) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    folded, places, at = raw.translate(FOLD), [], 0
    for word in folded.split():
        at = folded.index(word, at)
        places.append((at, at := at + len(word)))
    out, last = [], 0
    for a, b in runs:
        out.append(raw[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")

