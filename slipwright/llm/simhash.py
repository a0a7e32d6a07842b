"""SimHash near-duplicates: exact tiled comparison by exclusive-or and bit counts.

A text's A-Z are lower-cased; its words are runs of characters other than space and \\t-\\r; its shingles are all
stretches of three words (all its words if there are fewer), joined by a space. Bit b of the fingerprint is set if it
is set in more than half of the shingles' XXH64 values (seed 42). Texts without words have fingerprint zero and link
like any other. Documents link if their fingerprints differ in at most three bits.

All distinct fingerprints against each other would grow with the square of the corpus, so tiles are taken inside
buckets: of five parts of the 64 bits, three differing bits leave at least two parts equal, so every link lies in one
of the ten tables keyed by two parts. A bucket is compared exactly: its fingerprints are sorted by bit count, cut into
tiles, and tile pairs whose bit counts differ by more than the radius are skipped. A bucket beyond ``tile_rows`` is
first dealt to tile pairs of its own (same rule), which go to different tasks. A bucket or tile pair returns a
spanning forest of its links, never all pairs, and the forests are joined into components.

Defined cases: a null text is an empty one; equal fingerprints are one node however many documents share them (null
doc_ids have a component, but never name it unless all its ids are null); an empty table gives an empty result; other
columns are left out, or kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, stored, text_slices, texts_of
from .components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Bits of the five parts, lowest first.
PARTS = (13, 13, 13, 13, 12)
TILE_ROWS = 4096


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= size:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[k:] for k in range(size)))))
    total = np.zeros(64, np.int64)
    for k in range(0, len(grams), 1 << 16):
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams[k : k + (1 << 16)]), np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(grams), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp): the fingerprint as a signed long, with the text's XXH64."""

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            prints = np.array([fingerprint(t) for t in texts_of(batch).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(prints)], ["doc_id", "h", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(compute, "doc_id long, h long, fp long")


def _buckets() -> list[Column]:
    """For each pair of parts: (table, the bits of both parts)."""
    starts = [sum(PARTS[:k]) for k in range(len(PARTS))]
    out = []
    for t, pair in enumerate(combinations(range(len(PARTS)), 2)):
        mask = sum(((1 << PARTS[p]) - 1) << starts[p] for p in pair)
        mask -= (mask >> 63) << 64
        out.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    return out


class Forest:
    """Components of the rows of one bucket, as the smallest row number of each."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[u], root[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root[:] = up


def tiled_links(prints: np.ndarray, split: int | None = None, tile: int = 512, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of a spanning forest of the links among ``prints`` (uint64), by tiles sorted by bit count.

    With ``split`` only rows before it are compared with rows from it on.
    """
    n = len(prints)
    ones = np.bitwise_count(prints)
    parts = [np.arange(n)] * 2 if split is None else [np.arange(split), np.arange(split, n)]
    sides = [[p[o] for o in np.array_split(np.argsort(ones[p], kind="stable"), max(1, -(-len(p) // tile)))] for p in parts]
    forest = Forest(n)
    for i, a in enumerate(sides[0]):
        for b in sides[1] if split is not None else sides[1][i:]:
            if not len(a) or not len(b) or int(ones[b[0]]) - int(ones[a[-1]]) > radius or int(ones[a[0]]) - int(ones[b[-1]]) > radius:
                continue
            x, y = np.nonzero(np.bitwise_count(prints[a][:, None] ^ prints[b][None, :]) <= radius)
            forest.link(a[x], b[y])
    child = np.flatnonzero(forest.root != np.arange(n))
    return child, forest.root[child]


def _bucket_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket (t, key, pair) and side come in; a spanning forest of each bucket's links goes out.

    Only one bucket's rows are held at a time, and a bucket has at most two tiles.
    """
    rest = None
    for batch in _with_end(batches):
        table = batch if rest is None else (rest if batch is None else pa.concat_batches([rest, batch]))
        if table is None or not table.num_rows:
            continue
        t, key, pair, side, fp = (table.column(c).to_numpy(zero_copy_only=False) for c in ("t", "key", "pair", "side", "fp"))
        new = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0) | (np.diff(pair) != 0)) + 1
        edge = np.concatenate([[0], new, [len(fp)]])
        whole = len(edge) - 1 if batch is None else len(edge) - 2
        rest = None if batch is None else table.slice(edge[-2])
        u, v, prints = [], [], fp.view(np.uint64)
        size = np.diff(edge)[:whole]
        # buckets of two rows at once, larger ones one by one
        at = edge[:whole][size == 2]
        near = at[(np.bitwise_count(prints[at] ^ prints[at + 1]) <= RADIUS) & ((pair[at] == 0) | (side[at] != side[at + 1]))]
        u.append(fp[near]), v.append(fp[near + 1])
        for k in np.flatnonzero(size > 2).tolist():
            a, b = edge[k], edge[k + 1]
            x, y = tiled_links(prints[a:b], None if pair[a] == 0 else int(np.searchsorted(side[a:b], 1)))
            u.append(fp[a:b][x]), v.append(fp[a:b][y])
        u, v = np.concatenate(u), np.concatenate(v)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _with_end(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(nodes: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(u, v): for each bucket a spanning forest of the links among the distinct fingerprints ``nodes`` (fp).

    Its components are those of all links: no link is lost, and there are fewer rows than bucket entries.
    """
    rows = nodes.select("fp", F.explode(F.array(*_buckets())).alias("b")).select("b.t", "b.key", "fp")
    large = rows.groupBy("t", "key").count().filter(F.col("count") > tile_rows)
    rows = rows.join(large, ["t", "key"], "left")
    # tiles of a large bucket: by bit count, and by hash where many rows share one
    deal = F.ceil(4 * F.col("count") / tile_rows).cast("int")
    ones = F.bit_count("fp")
    own = ones * 1024 * 1024 + F.pmod(F.xxhash64("fp"), deal).cast("int")
    other = F.flatten(F.transform(F.sequence(ones - RADIUS, ones + RADIUS), lambda p: F.transform(F.sequence(F.lit(0), deal - 1), lambda h: p * 1024 * 1024 + h)))
    tiles = F.transform(other, lambda o: F.struct(F.concat_ws("/", F.least(own, o).cast("string"), F.greatest(own, o).cast("string")).alias("name"), F.when(own < o, 0).when(own > o, 1).otherwise(-1).alias("side")))
    dealt = F.when(F.col("count").isNull(), F.array(F.struct(F.lit("").alias("name"), F.lit(-1).alias("side")))).otherwise(tiles)
    rows = rows.select("t", "key", "fp", F.explode(dealt).alias("d"))
    rows = rows.select("t", "key", F.when(F.col("d.side") < 0, 0).otherwise(1).alias("pair"), F.col("d.name").alias("name"), F.col("d.side").alias("side"), "fp")
    rows = rows.select("t", F.xxhash64("key", "name").alias("key"), "pair", "side", "fp")
    rows = rows.repartition("t", "key", "pair").sortWithinPartitions("t", "key", "pair", "side", "fp")
    return rows.mapInArrow(_bucket_links, "u long, v long")


def _grouped(docs: DataFrame, tile_rows: int) -> DataFrame:
    """(doc_id, h, fp, root, component_id) of each document; root is the component's smallest fingerprint."""
    prints = stored(fingerprints(docs), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(nodes.select("fp"), tile_rows))
    groups = stored(nodes.join(found, nodes.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "groups")
    # a component of one fingerprint has its name already; the others' names are combined before they are shuffled, and
    # no aggregation hangs on the join's partitions, so that adaptive execution may split those of large components
    least = groups.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    named = groups.join(least, "root", "left").select("fp", "root", F.coalesce("least", "first").alias("component_id"))
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its component)."""
    return _grouped(docs, tile_rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``docs``, all columns, with one document of each component: the one whose doc_id names it (a null doc_id only
    if all are null). Of several rows with that doc_id the one with the smallest hash of its text stays, once."""
    own_id, own_hash = free_names(docs, "id", "hash")
    named = _grouped(docs, tile_rows).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = named.groupBy("doc_id", "root").agg(F.min("h").alias("h")).select(_key("doc_id").alias(own_id), F.col("h").alias(own_hash)).distinct()
    rows = docs.withColumns({own_id: _key("doc_id"), own_hash: F.xxhash64("text")})
    return rows.join(keep, [own_id, own_hash], "left_semi").dropDuplicates([own_id, own_hash]).select(*docs.columns)


def _key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(-(1 << 63)))
