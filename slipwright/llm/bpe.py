"""Byte-level BPE by given ranks: chunks are pre-tokenised apart, stitched, and their pieces encoded.

A text of up to ``chunk`` characters is one chunk. A longer one is cut into chunks that overlap by ``zone`` characters
on either side of each cut, each a row of its own, so that no task works on a very long text alone. What a chunk matches
first depends on where it was cut, but a match depends only on what follows its start. So as soon as two neighbours end
a match at the same place of their shared zone, all later ones agree too. The text is stitched at the first such place of
each zone, and each chunk encodes the piece between two of them. How white space is split depends on all of its run
(``\\s+(?!\\S)`` leaves the last space to the next word), so no place behind white space counts: a piece begins and ends
beside something else, and alone it splits as it does within the text. A text in which some zone has no such place (a
single word or a run of spaces longer than the zone) is pre-tokenised in one go.

This holds for patterns without look-behind that look ahead only over white space, as those of public byte-level
vocabularies do; with a look-behind in the pattern every text is one chunk.

Pieces repeat, so each distinct piece of a batch is encoded once. Decoding concatenates the bytes of the ids.

Defined cases: a null text is an empty one, with no ids; repeated rows each have their own row; an empty table gives
an empty result; columns other than doc_id and text are left out; an id outside the ranks can't be decoded and fails.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import ragged_take, sums_by_row, text_slices, texts_of

CHUNK = 1 << 16
ZONE = 1 << 11
#: What a worker's table of pieces may weigh, and an entry of it besides its piece and ids.
KEEP_BYTES = 40 << 20
ENTRY_BYTES = 250

_loaded: dict = {}


def load(path: str, pattern: str):
    """The encoding of a file of ranks, once in a process."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _loaded[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks
    return _loaded[path, pattern]


class PieceEncoder:
    """Pre-tokenises by the pattern and encodes each distinct piece once; pieces that it has met weigh at most
    ``keep_bytes``, and a piece beyond a hundredth of that isn't kept."""

    def __init__(self, path: str, pattern: str, keep_bytes: int = KEEP_BYTES):
        import regex

        self.encoding = load(path, pattern)[0]
        self.pattern = regex.compile(pattern)
        self.keep_bytes, self.known, self.weight = keep_bytes, {}, 0

    def places(self, text: str) -> list[int]:
        """Where matches end that don't end with white space."""
        return [m.end() for m in self.pattern.finditer(text) if not m[0][-1:].isspace()]

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        pieces = [self.pattern.findall(t) for t in texts]
        rows = np.concatenate([[0], np.cumsum(list(map(len, pieces)))]).astype(np.int64)
        coded = pc.dictionary_encode(pa.array([p for x in pieces for p in x], pa.large_string()))
        found = []
        for piece in coded.dictionary.to_pylist():
            ids = self.known.get(piece)
            if ids is None:
                ids = np.array(self.encoding.encode_ordinary(piece), "<i4").tobytes()
                weight = 4 * len(piece) + len(ids) + ENTRY_BYTES
                if self.weight + weight > self.keep_bytes:
                    self.known, self.weight = {}, 0
                if 100 * weight <= self.keep_bytes:
                    self.known[piece] = ids
                    self.weight += weight
            found.append(ids)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ids, sizes = ragged_take(np.frombuffer(b"".join(found), "<i4"), np.cumsum(lengths) - lengths, lengths, codes)
        ends = np.concatenate([[0], np.cumsum(sums_by_row(sizes, rows))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))


_encoders: dict[tuple[str, str], PieceEncoder] = {}


def encoder_of(path: str, pattern: str) -> PieceEncoder:
    """The process's encoder: later tasks of a worker find the pieces that earlier ones have met."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = PieceEncoder(path, pattern)
    return _encoders[path, pattern]


def _encode_whole(path: str, pattern: str):
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, pattern)
        for batch in text_slices(batches, max_bytes=2 << 20):
            keys = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*keys, encoder.encode(texts_of(batch).to_pylist())], [*names, "ids"])

    return encode


def _split(chunk: int, zone: int):
    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per chunk: its text from ``zone`` before its first cut to ``zone`` behind its last."""
        for batch in batches:
            for doc_id, h, text, copies in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text", "copies"))):
                n = -(-len(text) // chunk)
                for k in range(0, n, 64):
                    part = range(k, min(n, k + 64))
                    low = [max(0, j * chunk - zone) for j in part]
                    cut = [text[a : (j + 1) * chunk + zone] for j, a in zip(part, low)]
                    m = len(cut)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * m, pa.int64()), pa.array([h] * m, pa.string()), pa.array([copies] * m, pa.int64()), pa.array(list(part), pa.int32()), pa.array([n] * m, pa.int32()), pa.array(low, pa.int64()), pa.array(cut, pa.string())], ["doc_id", "h", "copies", "k", "n", "low", "text"])

    return split


def _mark(path: str, pattern: str, chunk: int, zone: int):
    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the places where matches end in the zone around the first cut, and around the last."""
        encoder = encoder_of(path, pattern)
        for batch in text_slices(batches):
            heads, tails = [], []
            for k, low, text in zip(*(batch.column(c).to_pylist() for c in ("k", "low", "text"))):
                at = low + np.array(encoder.places(text), np.int64)
                first, last = k * chunk, (k + 1) * chunk
                heads.append(at[(at > first - zone) & (at < first + zone)])
                tails.append(at[(at > last - zone) & (at < last + zone)])
            more = [pa.array(x, pa.list_(pa.int64())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "head", "tail"])

    return mark


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, zone: int = ZONE) -> DataFrame:
    """(doc_id, ids array<int>): the ids of each whole text, each match of the pattern encoded by itself."""
    if not 0 < 2 * zone <= chunk:
        raise ValueError("the zone is between 1 and half the chunk's length")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.char_length("text") > chunk, F.lit(False)) & F.lit("(?<" not in pattern)
    short = rows.filter(~long).mapInArrow(_encode_whole(path, pattern), "doc_id long, ids array<int>")
    # repeated rows are worked on once; they are combined before they are shuffled
    keyed = rows.filter(long).groupBy("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))
    chunks = keyed.mapInArrow(_split(chunk, zone), "doc_id long, h string, copies long, k int, n int, low long, text string").repartition("doc_id", "h", "k")
    marked = chunks.mapInArrow(_mark(path, pattern, chunk, zone), chunks.schema.simpleString()[7:-1].replace(":", " ") + ", head array<long>, tail array<long>")
    order = Window.partitionBy("doc_id", "h").orderBy("k")
    meet = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    stitched = marked.withColumn("at", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(meet))
    stitched = stitched.withColumns({"to": F.lead("at").over(order), "lost": F.max(F.col("at").isNull()).over(Window.partitionBy("doc_id", "h"))})
    piece = F.substring("text", (F.col("at") - F.col("low") + 1).cast("int"), F.when(F.col("k") + 1 < F.col("n"), F.col("to") - F.col("at")).otherwise(F.char_length("text")).cast("int"))
    pieces = stitched.filter("not lost").select("doc_id", "h", "copies", "k", piece.alias("text")).mapInArrow(_encode_whole(path, pattern), "doc_id long, h string, copies long, k int, ids array<int>")
    whole = pieces.groupBy("doc_id", "h", "copies").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    # put together again where a zone had no common place
    lost = stitched.filter("lost").select("doc_id", "h", "copies", "k", F.substring("text", F.when(F.col("k") == 0, 1).otherwise(zone + 1), chunk).alias("text"))
    lost = lost.groupBy("doc_id", "h", "copies").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "").alias("text"))
    lost = lost.mapInArrow(_encode_whole(path, pattern), "doc_id long, h string, copies long, ids array<int>")
    found = whole.select("doc_id", "copies", "ids").unionByName(lost.select("doc_id", "copies", "ids"))
    return short.unionByName(found.select("doc_id", "ids", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "ids"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with a binary column ``bytes``: the bytes of its ``ids`` in a row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(path, pattern)[1]
        table = [b""] * (1 + max(ranks.values()))
        for raw, rank in ranks.items():
            table[rank] = raw
        lengths = np.fromiter(map(len, table), np.int64, len(table))
        pool = np.frombuffer(b"".join(table), np.uint8)
        starts = np.cumsum(lengths) - lengths
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                lists = part.column("ids")
                rows = lists.offsets.to_numpy().astype(np.int64)
                raw, sizes = ragged_take(pool, starts, lengths, lists.flatten().to_numpy(zero_copy_only=False))
                ends = np.concatenate([[0], np.cumsum(sums_by_row(sizes, rows - rows[0]))]).astype(np.int32)
                out = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, "bytes"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("bytes", BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, zone: int = ZONE) -> DataFrame:
    """A row per document: doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined), decoded_sha256."""
    return decode(encode(docs, path, pattern, chunk, zone), path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
