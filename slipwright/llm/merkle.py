"""Merkle manifest of a dataset: a root that commits to every document, and a proof for each.

A document is a leaf, the SHA-256 of its fields. The leaves of a language ascend by doc_id, and runs of eight become
the hash of their members until one node, the subroot, is left; the subroots, by language, are put together in the same
way. Digests are hashed as lowercase hexadecimal text.

A leaf's coordinate is the rank of its doc_id, found without sorting the documents. Every task turns its ids into
bitmaps by (language, range of 4096 ids), compressed as the bits or as the list of those set, and the bitmaps of all
tasks are merged by or. Their counts are summed up along a directory of four levels, each entry of which has at most
8192 children, so no task holds a language. A rank query is a directory sum plus the number of bits below, for which a
bitmap has running popcounts of its own.

The tree is reduced by blocks of 512 places (three levels): members are put into the slots that their coordinates name,
and the blocks' nodes are the places of the next round. Paths come down the same way: a node's path is its siblings
inside the block, and then its block's path.

Defined cases: null fields are written ``-``; an empty table has no rows; null languages are a language, which comes
first, and null doc_ids come first in theirs; rows of one doc_id follow each other by leaf, and it can't be told which
of wholly equal rows has which place (their ids are numbered apart by ``sums_before``, so that a doc_id with very many
rows isn't gathered in a task); other columns are left out. Texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored
from .prefix import sums_before

FAN_OUT = 8
#: Levels that one block reduces, and its places.
LEVELS = 3
BLOCK_BITS = 9
#: Ids of one bitmap, as a power of two, and the children of a directory entry.
LOW_BITS = 12
DIRECTORY_BITS = 13
#: Comes before every range of ids.
NULL_RANGE = -(1 << (63 - LOW_BITS)) - 1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# leaves


def leaf_hash(fields: list[Column]) -> Column:
    """Lowercase hexadecimal SHA-256 of all fields, each as its number of bytes, a colon and its value, or as ``-``."""

    def field(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256)


def lowered(fields: list[Column]) -> list[Column]:
    """The fields with A-Z of the last one, the text, in lower case."""
    return [*fields[:-1], F.translate(fields[-1].cast("string"), UPPER, LOWER)]


def every_third(doc_id: Column) -> Column:
    """3 divides the crc32 of the id as decimal text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


# ranks


def _group_edges(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(new[1:]) + 1, [n]]) if n else np.zeros(1, np.int64)


def packed(held: np.ndarray) -> bytes:
    """A bitmap, given as booleans: the places of its bits if these take less room, else the bits."""
    at = np.flatnonzero(held)
    return b"a" + at.astype("<u2").tobytes() if 2 * len(at) < len(held) // 8 else b"b" + np.packbits(held).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    held = np.zeros(1 << LOW_BITS, bool)
    if raw[:1] == b"a":
        held[np.frombuffer(raw, "<u2", offset=1)] = True
    else:
        held[:] = np.unpackbits(np.frombuffer(raw, np.uint8, offset=1))
    return held


_PARTIAL = "lang string, range long, bits binary, lows array<int>, extras array<long>"
_MERGED = "lang string, range long, bits binary, lows array<int>, copies array<long>, places array<long>, n long"


def _bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, range, low) to bitmaps, one for each batch and range; ids met twice are counted beside them."""
    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        code = lang.indices.fill_null(-1).to_numpy()
        rng, low = batch.column("range").to_numpy(), batch.column("low").to_numpy()
        order = np.lexsort((rng, code))
        edges, out = _group_edges(code[order], rng[order]), []
        for a, b in zip(edges, edges[1:]):
            count = np.bincount(low[order[a:b]], minlength=1 << LOW_BITS)
            twice = np.flatnonzero(count > 1)
            k = order[a]
            out.append((None if code[k] < 0 else lang.dictionary[int(code[k])].as_py(), int(rng[k]), packed(count > 0), twice.tolist(), (count[twice] - 1).tolist()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _types(_PARTIAL))], ["lang", "range", "bits", "lows", "extras"])


def _types(ddl: str) -> list[pa.DataType]:
    names = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return [names[part.split()[1]] for part in ddl.split(", ")]


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps sorted by (lang, range) come in; their union goes out, with the ids that have several rows: how many, and
    the rank of the first. One bitmap is held at a time."""
    key, held, extra, done = None, None, None, []

    def finish() -> tuple:
        count = held + extra
        rank = np.cumsum(count) - count
        several = np.flatnonzero(extra)
        return (*key, packed(held), several.tolist(), count[several].tolist(), rank[several].tolist(), int(count.sum()))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _types(_MERGED))], ["lang", "range", "bits", "lows", "copies", "places", "n"])

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:2] != key:
                if key is not None:
                    done.append(finish())
                if len(done) >= 1000:
                    yield batch_of(done)
                    done = []
                key, held, extra = row[:2], np.zeros(1 << LOW_BITS, bool), np.zeros(1 << LOW_BITS, np.int64)
            own = unpacked(row[2])
            extra += held & own
            held |= own
            extra[np.array(row[3], np.int64)] += np.array(row[4], np.int64)
    if key is not None:
        yield batch_of([*done, finish()])


def bitmaps(rows: DataFrame) -> DataFrame:
    """The merged bitmaps of a table (lang, range, low), with directory sums: lang, range, bits, lows, copies, places,
    base (rows of the language before the range), total (rows of the language)."""
    parts = rows.select("lang", "range", "low").mapInArrow(_bitmaps, _PARTIAL)
    merged = stored(parts.repartition("lang", "range").sortWithinPartitions("lang", "range").mapInArrow(_merge, _MERGED), "bitmaps")
    sums = directory(merged.select("lang", "range", "n")).select(F.col("lang").alias("d_lang"), F.col("range").alias("d_range"), "base", "total")
    same = merged["lang"].eqNullSafe(sums["d_lang"]) & (merged["range"] == sums["d_range"])
    return stored(merged.join(sums, same).select("lang", "range", "bits", "lows", "copies", "places", "base", "total"), "ranks")


def directory(counts: DataFrame) -> DataFrame:
    """(lang, range, base, total) of a table (lang, range, n): sums of the counts before each range, by levels.

    An entry of a level stands for 8192 entries of the one below, and a window sums up the children of one entry; the
    top level has the ranges of a language that differ in their highest 13 bits.
    """
    rows, levels = counts.withColumn("k0", F.col("range")), 4
    for k in range(1, levels):
        rows = rows.withColumn(f"k{k}", F.shiftright("range", DIRECTORY_BITS * k))
    rows = rows.withColumn(f"k{levels}", F.lit(0).cast("long"))
    level, tables = rows, []
    for k in range(levels):
        up = [f"k{j}" for j in range(k + 1, levels + 1)]
        level = level.groupBy("lang", f"k{k}", *up).agg(F.sum("n").alias("n"))
        before = F.sum("n").over(W.partitionBy("lang", f"k{k + 1}").orderBy(f"k{k}").rowsBetween(W.unboundedPreceding, -1))
        tables.append(level.select(F.col("lang").alias(f"lang{k}"), F.col(f"k{k}").alias(f"key{k}"), F.coalesce(before, F.lit(0)).alias(f"b{k}")))
    whole = level.groupBy("lang").agg(F.sum("n").alias("total")).withColumnRenamed("lang", "all_lang")
    out = rows
    for k, t in enumerate(tables):
        out = out.join(t, out["lang"].eqNullSafe(t[f"lang{k}"]) & (out[f"k{k}"] == t[f"key{k}"])).drop(f"lang{k}", f"key{k}")
    out = out.join(whole, out["lang"].eqNullSafe(whole["all_lang"]))
    return out.select("lang", "range", sum((F.col(f"b{k}") for k in range(1, levels)), F.col("b0")).alias("base"), "total")


def _ranks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lang, range), the bitmap before the documents of its range; each document gets its rank."""
    base = total = below = None
    for batch in batches:
        low, bits = batch.column("low").to_numpy(), batch.column("bits")
        maps = np.flatnonzero(low < 0)
        pos, n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        edges = np.unique(np.concatenate([[0], maps, [batch.num_rows]]))
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            if low[a] < 0:
                held = unpacked(bits[a].as_py()).astype(np.int64)
                held[np.array(batch.column("lows")[a].as_py(), np.int64)] = batch.column("copies")[a].as_py()
                below = np.cumsum(held) - held  # the popcount directory of this bitmap, rows of one id counted
                base, total = batch.column("base")[a].as_py(), batch.column("total")[a].as_py()
                a += 1
            if a < b:
                pos[a:b], n[a:b] = base + below[low[a:b]], total
        docs = pa.array(low >= 0)
        out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("lang", "doc_id", "leaf", "tampered")], pa.array(pos), pa.array(n)], ["lang", "doc_id", "leaf", "tampered", "pos", "n"])
        yield out.filter(docs)


_PLACED = "lang string, doc_id long, leaf binary, tampered binary, pos long, n long"


def placed(leaves: DataFrame) -> DataFrame:
    """A stored table (doc_id, lang, leaf, tampered) with each leaf's place in its language and the language's size."""
    rng = F.coalesce(F.shiftright("doc_id", LOW_BITS), F.lit(NULL_RANGE)).alias("range")
    low = F.coalesce(F.col("doc_id").bitwiseAND(F.lit((1 << LOW_BITS) - 1)), F.lit(0)).cast("int").alias("low")
    rows = leaves.select("lang", rng, low, "doc_id", "leaf", "tampered")
    maps = bitmaps(rows)
    several = maps.select("lang", "range", "base", "total", F.explode(F.arrays_zip("lows", "places")).alias("s"))
    several = stored(several.select(F.col("lang").alias("s_lang"), F.col("range").alias("s_range"), F.col("s.lows").alias("s_low"), (F.col("base") + F.col("s.places")).alias("first"), "total"), "several")
    same = rows["lang"].eqNullSafe(several["s_lang"]) & (rows["range"] == several["s_range"]) & (rows["low"] == several["s_low"])
    # ids of one row: a rank query each
    none = [F.lit(None).cast(t).alias(c) for c, t in (("base", "long"), ("total", "long"), ("bits", "binary"), ("lows", "array<int>"), ("copies", "array<long>"))]
    single = rows.join(several, same, "left_anti").select("lang", "range", "low", "doc_id", "leaf", "tampered", *none)
    heads = maps.select("lang", "range", F.lit(-1).alias("low"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("leaf"), F.lit(None).cast("binary").alias("tampered"), "base", "total", "bits", "lows", "copies")
    ranked = single.unionByName(heads).repartition("lang", "range").sortWithinPartitions("lang", "range", "low").mapInArrow(_ranks, _PLACED)
    # ids of several rows: the rank of the first, and the number of leaves before
    again = rows.join(several, same).select("lang", "doc_id", "leaf", "tampered", "first", "total", F.lit(1).cast("long").alias("one"))
    again = sums_before(stored(again, "again"), ["lang", "doc_id"], ["leaf"], ["one"], "again")
    again = again.select("lang", "doc_id", "leaf", "tampered", (F.col("first") + F.col("before_one")).alias("pos"), F.col("total").alias("n"))
    return stored(ranked.union(again), "placed")


# the tree


def _node(members: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(members).hex().encode()).digest()


def _levels(slots: list[bytes], places: int) -> list[list[bytes]]:
    """The nodes of a block by level, from its filled slots to its one top node; ``places`` is the group's number of
    nodes at the slots' level, which says whether the tree goes on beyond the block."""
    levels = [slots]
    while len(levels) <= LEVELS and (places > FAN_OUT ** (len(levels) - 1)):
        last = levels[-1]
        levels.append([_node(last[k : k + FAN_OUT]) for k in range(0, len(last), FAN_OUT)])
    return levels


def _slots(block: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """The digests of a block by slot, and the slot of each row."""
    slot = block.column("pos").to_numpy() & ((1 << BLOCK_BITS) - 1)
    digests, out = block.column("leaf").to_pylist(), [b""] * block.num_rows
    for s, d in zip(slot.tolist(), digests):
        out[s] = d
    return out, slot


def _path(levels: list[list[bytes]], slot: int) -> tuple[bytes, list[list[bytes]]]:
    """The way up from a slot: at each level its place in its run (a byte), and the run's other members."""
    turns, siblings = bytearray(), []
    for nodes in levels[:-1]:
        run = slot // FAN_OUT * FAN_OUT
        turns.append(slot - run)
        siblings.append([*nodes[run:slot], *nodes[slot + 1 : run + FAN_OUT]])
        slot //= FAN_OUT
    return bytes(turns), siblings


def _steps(turns: bytes, siblings: list[list[bytes]]) -> bytes:
    """A path as bytes: for each level its turn, the number of siblings, and the siblings."""
    return b"".join(bytes([t, len(s)]) + b"".join(s) for t, s in zip(turns, siblings))


def _read_steps(raw: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(raw):
        turn, n = raw[at], raw[at + 1]
        yield turn, [raw[at + 2 + 32 * k : at + 34 + 32 * k] for k in range(n)]
        at += 2 + 32 * n


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path give."""
    for turn, siblings in _read_steps(path):
        leaf = _node([*siblings[:turn], leaf, *siblings[turn:]])
    return leaf


def _with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", BLOCK_BITS))


def _tops(nodes: DataFrame) -> DataFrame:
    """(grp, pos, n, leaf) of the next round: the top node of each block of ``nodes``."""

    def top(block: pa.Table) -> pa.Table:
        slots, _ = _slots(block)
        n = block.column("n")[0].as_py()
        grp, pos = block.column("grp").slice(0, 1), pa.array([block.column("block")[0].as_py()])
        return pa.table([grp, pos, pa.array([-(-n // (1 << BLOCK_BITS))]), pa.array([_levels(slots, n)[-1][0]], pa.binary())], ["grp", "pos", "n", "leaf"])

    return _with_block(nodes).groupBy("grp", "block").applyInArrow(top, "grp string, pos long, n long, leaf binary")


def tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots and paths of the trees over a stored table (grp, pos, n, leaf), n being the size of the group.

    Roots are (grp, leaf); paths are (grp, block, path), the way up from each block's top node. Each round is one shuffle
    of the nodes that are left; the number of rounds grows with the logarithm of the largest group.
    """
    tops = stored(_tops(nodes), "nodes")
    if not tops.filter("n > 1").take(1):
        return tops.select("grp", "leaf"), tops.select("grp", F.col("pos").alias("block"), F.lit(b"").alias("path"))
    roots, above = tree(tops)
    return roots, stored(paths(tops, above), "paths").withColumnRenamed("pos", "block")


def paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(grp, pos, path) of each node, by the paths (grp, block, path) of its block."""

    def down(block: pa.Table, upper: pa.Table) -> pa.Table:
        slots, slot = _slots(block)
        levels, up = _levels(slots, block.column("n")[0].as_py()), upper.column("path")[0].as_py()
        found = [_steps(*_path(levels, s)) + up for s in slot.tolist()]
        return pa.table([block.column("grp"), block.column("pos"), pa.array(found, pa.binary())], ["grp", "pos", "path"])

    both = _with_block(nodes).groupBy("grp", "block").cogroup(above.groupBy("grp", "block"))
    return both.applyInArrow(down, "grp string, pos long, path binary")


def manifest(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The proof of a document is checked with its leaf, or for every third one (``every_third``) with that of a tampered
    copy, whose text has its A-Z in lower case. Proofs themselves are the paths of ``paths``.
    """
    fields = [F.col(c) for c in FIELDS]
    tampered = F.when(every_third(F.col("doc_id")), F.unhex(leaf_hash(lowered(fields))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.unhex(leaf_hash(fields)).alias("leaf"), tampered.alias("tampered"))
    nodes = placed(stored(rows, "leaves")).withColumnRenamed("lang", "grp")
    subroots, above = tree(nodes)
    subroots = stored(subroots, "subroots")
    # the languages, in order, are the leaves of the tree above
    count = subroots.count()
    tied = subroots.select("grp", "leaf", F.lit(1).cast("long").alias("one"))
    ranked = sums_before(tied, [], ["grp"], ["one"], "langs").select(F.col("grp").alias("lang"), "leaf", F.col("before_one").alias("pos"))
    tops = stored(ranked.select("lang", F.lit("").alias("grp"), "pos", F.lit(count).alias("n"), "leaf"), "langs")
    roots, over = tree(tops.select("grp", "pos", "n", "leaf"))
    root = roots.first()["leaf"] if count else b""
    ways = paths(tops.select("grp", "pos", "n", "leaf"), over).withColumnRenamed("path", "over")
    ways = stored(tops.join(ways.select(F.col("pos").alias("w_pos"), "over"), F.col("pos") == F.col("w_pos")).select(F.col("lang").alias("w_lang"), F.col("leaf").alias("subroot"), "over"), "ways")
    whole = above.join(ways, above["grp"].eqNullSafe(ways["w_lang"])).select("grp", "block", F.concat("path", "over").alias("path"), "subroot")
    return _proved(nodes, whole, root)


def _proved(nodes: DataFrame, above: DataFrame, root: bytes) -> DataFrame:
    def prove(block: pa.Table, upper: pa.Table) -> pa.Table:
        slots, slot = _slots(block)
        levels = _levels(slots, block.column("n")[0].as_py())
        up, subroot = upper.column("path")[0].as_py(), upper.column("subroot")[0].as_py().hex()
        over = b"".join(s for _, group in _read_steps(up) for s in group).hex().encode()
        proofs, roots = [], []
        for s, leaf, other in zip(slot.tolist(), block.column("leaf").to_pylist(), block.column("tampered").to_pylist()):
            turns, siblings = _path(levels, s)
            proofs.append(hashlib.sha256(b"".join(x for group in siblings for x in group).hex().encode() + over).hexdigest())
            roots.append(folded(leaf if other is None else other, _steps(turns, siblings) + up))
        n, leaves = block.num_rows, [d.hex() for d in block.column("leaf").to_pylist()]
        columns = [block.column("doc_id"), pa.array(leaves), pa.array([subroot] * n), pa.array([root.hex()] * n), pa.array(proofs), pa.array([r.hex() for r in roots]), pa.array([r == root for r in roots])]
        return pa.table(columns, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    both = _with_block(nodes).groupBy("grp", "block").cogroup(above.groupBy("grp", "block"))
    return both.applyInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
