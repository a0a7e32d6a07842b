"""Token-ID files: independent zstandard frames, a trailing seek table, per-frame checksums.

A store is a folder of shard files and a manifest table. Shards follow each other in ascending doc_id order; each is
a seekable zstandard file: frames that decompress alone (each with its own content checksum), and at the end a
skippable frame that lists for every frame the compressed size, the decompressed size and the low half of the
XXH64 of the decompressed bytes. A frame holds

    uint32 n | n x int64 doc_id | n x uint8 id-is-null | n x uint32 number of ids | all ids as uint32

little-endian throughout. A reader takes the seek table from the file's end, and decompresses only the frames whose
range of doc_ids (kept in the manifest) holds a wanted document.

Defined cases: a null text is an empty one; an empty text has the end id alone; documents with equal doc_id follow
each other by the hash of their text; null doc_ids come first; an empty table gives no shard and an empty result;
columns other than ``doc_id`` and ``text`` are left out.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ragged_take, scratch, stored, sums_by_row, text_slices, texts_of

# Fixed values of the seekable zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

#: Unicode White_Space, as in the tokenizer's ``\s``.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES_SET = {chr(c) for c in range(0x3001) if re.match(f"[{SPACES}]", chr(c))}
MANIFEST = "shard long, path string, first_id long, last_id long, n_docs long, n_ids long, frames array<struct<at:long,size:long,first_id:long,last_id:long,n_docs:long>>"


#: Letters that all versions of Unicode agree on, as a class of a regular expression.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏА-яЁёぁ-ゖァ-ヺ一-龥가-힣"
SIGNS = "!-/:-@\\[-`{-~"


def byte_letters() -> dict[int, str]:
    """The visible character that byte-level vocabularies write for each byte: printable Latin-1 ones stand for
    themselves, the others for the characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class UnitEncoder:
    """Encodes texts by the tokenizers library, each distinct stretch of text once.

    A byte-level pre-tokenizer never joins a non-space to a space behind it, so a text may be cut before each run of
    white space and the parts encoded alone; a line break between two non-spaces is a token of its own. Parts repeat a lot; the ids of the last ``keep`` of them are remembered,
    and those that come back stay. A part of letters, with signs behind it or none, is two pre-tokens at most and goes
    to the library's merges at once. All this holds only for the file layout that ``cuts_at_spaces`` checks; with any
    other file the library gets whole texts.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep, self.known, self.older, self.signs = keep, {}, {}, {}
        with open(path, encoding="utf-8") as file:
            self.in_units = cuts_at_spaces(json.load(file))
        breaks = self.tokenizer.encode("a\nb", add_special_tokens=False).ids
        self.line_break = breaks[1] if len(breaks) == 3 else -1
        self.uneven = f"^ | $|[{SPACES}] | [{SPACES}]"
        self.blank = f"[{SPACES}]\n|\n[{SPACES}]"
        self.parts = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
        self.word = re.compile(f"( ?[{LETTERS}]+)([{SIGNS}]*)").fullmatch
        self.shown = byte_letters()

    def ids_of(self, units: list[str]) -> list[bytes]:
        out = list(map(self.known.get, units))
        lost = [k for k, ids in enumerate(out) if ids is None]
        fresh: dict[str, bytes] = {}
        for k in lost:
            ids = self.older.get(units[k])
            if ids is not None:
                fresh[units[k]] = ids
        new = [units[k] for k in lost if units[k] not in fresh]
        if new:
            fresh |= self._new_ids(new)
        for k in lost:
            out[k] = fresh[units[k]]
        if len(self.known) + len(fresh) > self.keep // 2:  # what isn't met again while the next half fills is forgotten
            self.older, self.known = self.known, {}
        self.known.update(fresh)
        return out

    def _new_ids(self, units: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        words = [m for m in map(self.word, units) if m]
        merge, fresh, tails = self.tokenizer.model.tokenize, {}, []
        for m in words:
            whole, word, signs = m[0], m[1], m[2]
            if signs:
                ids = self.known.get(word) or self.older.get(word)
                if ids is None:
                    fresh[word] = None
                tails.append((whole, word, signs, ids))
            else:
                fresh[word] = None
        written = "\n".join(fresh).encode("utf-8").decode("latin-1").translate(self.shown).split(self.shown[10])
        ids, ends = [], [0]
        for text in written if fresh else ():
            ids += [t.id for t in merge(text)]
            ends.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        found.update((word, raw[a:b]) for word, a, b in zip(fresh, ends, ends[1:]))
        for whole, word, signs, ids in tails:
            end = self.signs.get(signs)
            if end is None:
                if len(self.signs) > 10_000:
                    self.signs.clear()
                end = self.signs[signs] = np.array(self.tokenizer.encode(signs, add_special_tokens=False).ids, "<u4").tobytes()
            found[whole] = (ids or found[word]) + end
        return found | self._piped_ids([u for u in units if u not in found])

    def _piped_ids(self, units: list[str]) -> dict[str, bytes]:
        """Units without a line break go in one text, a break between them: it is always a token of its own there."""
        found: dict[str, bytes] = {}
        plain = [u for u in units if u and "\n" not in u and u[-1] not in SPACES_SET]
        parts = [plain[k : k + 64] for k in range(0, len(plain), 64)]
        for part, encoded in zip(parts, self.tokenizer.encode_batch_fast(["\n".join(x) for x in parts], add_special_tokens=False)):
            ids = np.array(encoded.ids, "<u4")
            cuts = np.flatnonzero(ids == self.line_break)
            if len(cuts) == len(part) - 1:
                edges = [0, *((cuts + 1) * 4).tolist(), 4 * len(ids) + 4]
                raw = ids.tobytes()
                found.update((u, raw[a : b - 4]) for u, a, b in zip(part, edges, edges[1:]))
        rest = [u for u in units if u not in found]
        found.update((u, np.array(e.ids, "<u4").tobytes()) for u, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)))
        return found

    def _encode(self, units: pa.Array, spaced: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids by row; spaced: the unit has a space before it that was cut off."""
        coded = pc.dictionary_encode(units)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + spaced
        used = np.flatnonzero(np.bincount(code, minlength=2 * len(coded.dictionary)))
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self.ids_of([" " + words[c >> 1] if c & 1 else words[c >> 1] for c in used.tolist()])
        place = np.zeros(2 * len(words), np.int64)
        place[used] = np.arange(len(used))
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, sizes = ragged_take(np.frombuffer(b"".join(found), "<u4"), np.cumsum(lengths) - lengths, lengths, place[code])
        return ids, sums_by_row(sizes, rows)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        n = len(texts)
        if not self.in_units:
            found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *found]), np.array(list(map(len, found)), np.int64)
        uneven = pc.match_substring_regex(texts, self.uneven).to_numpy(zero_copy_only=False)
        even, odd = np.flatnonzero(~uneven), np.flatnonzero(uneven)
        counts, parts = np.zeros(n, np.int64), []
        if len(even):
            whole = texts.take(pa.array(even))
            if self.line_break >= 0:  # single line breaks are cut out, too
                whole = pc.if_else(pc.match_substring_regex(whole, self.blank), whole, pc.replace_substring(whole, "\n", " \n "))
            lists = pc.split_pattern(whole, " ")
            rows = lists.offsets.to_numpy().astype(np.int64)
            rows -= rows[0]
            units, spaced = lists.flatten(), np.ones(rows[-1], np.int64)
            if self.line_break >= 0:
                lines = np.flatnonzero(pc.equal(units, "\n").to_numpy(zero_copy_only=False))
                spaced[lines] = spaced[lines + 1] = 0  # the cut leaves a unit behind each, if an empty one
            spaced[rows[:-1]] = 0
            ids, counts[even] = self._encode(units, spaced, rows)
            parts.append((even, ids))
        if len(odd):
            units = [self.parts.findall(t) for t in texts.take(pa.array(odd)).to_pylist()]
            rows = np.concatenate([[0], np.cumsum(list(map(len, units)))]).astype(np.int64)
            flat = pa.array([u for x in units for u in x], pa.large_string())
            ids, counts[odd] = self._encode(flat, np.zeros(rows[-1], np.int64), rows)
            parts.append((odd, ids))
        if len(parts) == 1:
            return parts[0][1], counts
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), "<u4")
        for rows, ids in parts:
            size = counts[rows]
            ends = np.cumsum(size)
            out[np.arange(len(ids)) + np.repeat(starts[rows] - (ends - size), size)] = ids
        return out, counts


def cuts_at_spaces(layout: dict) -> bool:
    """Whether a tokenizer file is of plain byte-level merges: no normalizer, the usual split into words, no added
    space, no dropout or affixes, and no added token that letters with signs behind them could hold."""
    split, model = layout.get("pre_tokenizer") or {}, layout.get("model") or {}
    usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    merges = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    mixed = re.compile(f"[{SIGNS}0-9][{LETTERS}]")
    apart = all(mixed.search(t["content"]) and not any(c in SPACES_SET for c in t["content"]) and not t.get("lstrip") and not t.get("rstrip") for t in layout.get("added_tokens") or [])
    return bool(usual and merges and apart and not layout.get("normalizer"))


_encoders: dict[str, UnitEncoder] = {}


def encoder_of(path: str) -> UnitEncoder:
    """The process's encoder of a file: later tasks of a worker find the units that earlier ones have met."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


class ShardWriter:
    """Writes frames of whole documents to an open file, then the seek table."""

    def __init__(self, sink, level: int = 1):
        import zstandard

        self.sink, self.at, self.table, self.frames = sink, 0, [], []
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress

    def frame(self, doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> None:
        import xxhash

        n = len(doc_ids)
        raw = b"".join([struct.pack("<I", n), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), bytes(x is None for x in doc_ids), counts.astype("<u4").tobytes(), ids.astype("<u4").tobytes()])
        packed = self.pack(raw)
        self.sink.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.frames.append({"at": self.at, "size": len(packed), "first_id": doc_ids[0], "last_id": doc_ids[-1], "n_docs": n})
        self.at += len(packed)

    def close(self) -> None:
        rows = b"".join(struct.pack("<III", *x) for x in self.table)
        foot = struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(rows) + len(foot)) + rows + foot)


def seek_table(source) -> list[tuple[int, int, int, int]]:
    """(place, compressed size, decompressed size, checksum) of each frame, from the file's end."""
    size = source.size()
    source.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEK_MAGIC or not flags & CHECKSUM_FLAG:
        raise ValueError("no seek table with checksums at the end of the file")
    source.seek(size - 9 - 12 * n)
    at, out = 0, []
    for packed, raw, check in struct.iter_unpack("<III", source.read(12 * n)):
        out.append((at, packed, raw, check))
        at += packed
    return out


def read_frame(source, entry: tuple[int, int, int, int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of one frame, after its checksums are verified."""
    import xxhash
    import zstandard

    at, packed, size, check = entry
    source.seek(at)
    raw = zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=size)
    if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
        raise ValueError(f"frame at {at} is damaged")
    n = struct.unpack_from("<I", raw)[0]
    doc_ids = np.frombuffer(raw, "<i8", n, 4)
    null = np.frombuffer(raw, np.uint8, n, 4 + 8 * n)
    counts = np.frombuffer(raw, "<u4", n, 4 + 9 * n)
    ids, k = np.frombuffer(raw, "<u4", -1, 4 + 13 * n), 0
    for i in range(n):
        yield None if null[i] else int(doc_ids[i]), ids[k : k + counts[i]]
        k += int(counts[i])


def _file(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, frame_ids: int = 1 << 16) -> DataFrame:
    """Writes ``docs`` (doc_id, text) as a store under ``folder``; returns its manifest, one row per shard.

    Documents are dealt by range of (doc_id, hash of text), so shards follow each other in order and even one doc_id
    with a third of all rows is split. Each task streams its rows to a file whose name no other attempt has, and only
    files named in the manifest count: a task may be run again at any time.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer, sink, path, n_docs, n_ids = TaskContext.get().partitionId(), None, None, None, 0, 0
        encoder = encoder_of(tokenizer)
        for batch in text_slices(batches, max_bytes=16 << 20):  # larger slices meet fewer distinct units in all
            if writer is None:
                store, where = _file(folder)
                store.create_dir(where, recursive=True)
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok.zst"
                path = f"{folder}/{name}"
                sink = store.open_output_stream(f"{where}/{name}", compression=None)
                writer = ShardWriter(sink)
            ids, counts = encoder.encode(texts_of(batch))
            all_ids = np.full(len(ids) + len(counts), end_id, "<u4")
            ends = np.cumsum(counts + 1) - 1
            here = np.ones(len(all_ids), bool)
            here[ends] = False
            all_ids[here] = ids
            part = ends // frame_ids
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            doc_ids, edges = batch.column("doc_id").to_pylist(), np.concatenate([[0], ends + 1])
            for a, b in zip(cuts, cuts[1:]):
                writer.frame(doc_ids[a:b], counts[a:b] + 1, all_ids[edges[a] : edges[b]])
            n_docs, n_ids = n_docs + len(counts), n_ids + len(all_ids)
        if writer is not None:
            writer.close()
            sink.close()
            row = {"shard": shard, "path": path, "first_id": writer.frames[0]["first_id"], "last_id": writer.frames[-1]["last_id"], "n_docs": n_docs, "n_ids": n_ids, "frames": writer.frames}
            yield pa.RecordBatch.from_pylist([row], schema=MANIFEST_ARROW)

    return stored(rows.mapInArrow(encode, MANIFEST), "manifest")


_LONG = pa.int64()
MANIFEST_ARROW = pa.schema([("shard", _LONG), ("path", pa.string()), ("first_id", _LONG), ("last_id", _LONG), ("n_docs", _LONG), ("n_ids", _LONG), ("frames", pa.list_(pa.struct([("at", _LONG), ("size", _LONG), ("first_id", _LONG), ("last_id", _LONG), ("n_docs", _LONG)])))])


def read_store(manifest: DataFrame, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids.

    With ``doc_ids`` (a bounded list of the caller) only the frames that hold one of them are decompressed.
    """
    spark = manifest.sparkSession
    # one row per shard, however large the corpus is: the running sum over them is small
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.withColumn("base", before).select("shard", "path", "base", "first_id", "last_id", "frames")
    wanted = None if doc_ids is None else sorted(set(doc_ids))
    if wanted is not None:  # shards without any of them aren't opened
        holds = F.array(*[F.lit(x).cast("long") for x in wanted]) if wanted else F.array().cast("array<long>")
        shards = shards.filter(F.exists(holds, lambda x: x.between(F.coalesce("first_id", F.lit(-(1 << 63))), F.col("last_id"))))
    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = set(wanted or ())
        for batch in batches:
            for row in batch.to_pylist():
                store, where = _file(row["path"])
                with store.open_input_file(where) as source:
                    at = row["base"]
                    for entry, frame in zip(seek_table(source), row["frames"], strict=True):
                        if wanted is not None and not _may_hold(frame, wanted):
                            at += (entry[2] - 4 - 13 * frame["n_docs"]) // 4  # all but the ids has a known size
                            continue
                        docs = []
                        for doc_id, ids in read_frame(source, entry):
                            docs.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), ids))
                            at += len(ids)
                        if wanted is not None:
                            docs = [x for x in docs if x[0] in chosen]
                        columns = list(zip(*docs)) or [()] * 5
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), _LONG) for c in columns[:4]] + [pa.array([x.tolist() for x in columns[4]], pa.list_(_LONG))] * with_ids, names)

    return shards.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard").mapInArrow(read, out)


def _may_hold(frame: dict, wanted: list[int]) -> bool:
    """Whether a sorted list of doc_ids has one in the frame's range."""
    if frame["last_id"] is None:
        return False
    k = bisect_left(wanted, frame["last_id"] + 1)
    return k > 0 and (frame["first_id"] is None or wanted[k - 1] >= frame["first_id"])


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 2, with_ids: bool = False, folder: str | None = None) -> DataFrame:
    """Writes a store (under ``folder``, else in the shared folder) and reads every document back from its files."""
    spark: SparkSession = docs.sparkSession
    return read_store(write_store(docs, folder or scratch(spark, "tokens"), tokenizer, end_id), with_ids=with_ids)
