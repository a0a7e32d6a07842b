"""Media columns: Netpbm and BMP pictures in binary columns, decoded, resized, tiled and hashed.

``decode`` reads PGM, PPM (binary, 8 bits) and uncompressed 24-bit BMP into numpy arrays of height x width x channels.
``resize`` takes the mean over each target cell's area, fractions of pixels included, from an integral image.
``features`` adds to a table of pictures its size, an NPY tile (a small grey picture as .npy bytes) and a difference
hash: one bit for each pair of neighbours in a 9 x 8 picture, set if the right one is brighter.

Defined cases: a null picture, or one that isn't of these formats or is cut short, has null features; a picture of any
size from 1 x 1 is resized; equal bytes give equal features; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, text_slices

#: A payload fills whole rows of 64 pixels of three samples.
UNIT = 192
TILE = 16


def encode_ppm(pixels: np.ndarray) -> bytes:
    """Binary PPM (three channels) or PGM (one) of 8-bit samples."""
    height, width, channels = pixels.shape
    return b"P%d\n%d %d\n255\n" % (6 if channels == 3 else 5, width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed 24-bit BMP, rows from the bottom up, each padded to four bytes."""
    height, width, _ = pixels.shape
    row = (3 * width + 3) // 4 * 4
    data = np.zeros((height, row), np.uint8)
    data[:, : 3 * width] = pixels[::-1, :, ::-1].reshape(height, 3 * width)
    return struct.pack("<2sIHHI", b"BM", 54 + data.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, data.size, 2835, 2835, 0, 0) + data.tobytes()


def _netpbm(raw: bytes) -> np.ndarray | None:
    fields, at = [], 2
    while len(fields) < 3:
        while at < len(raw) and raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.find(b"\n", at)
            if at < 0:
                return None
            continue
        end = at
        while end < len(raw) and raw[end : end + 1].isdigit():
            end += 1
        if end == at or end - at > 9:
            return None
        fields.append(int(raw[at:end]))
        at = end
    width, height, most = fields
    channels = 3 if raw[:2] == b"P6" else 1
    size = width * height * channels
    if not size or most != 255 or len(raw) < at + 1 + size or not raw[at : at + 1].isspace():
        return None
    return np.frombuffer(raw, np.uint8, size, at + 1).reshape(height, width, channels)


def _bmp(raw: bytes) -> np.ndarray | None:
    if len(raw) < 54:
        return None
    start = struct.unpack_from("<I", raw, 10)[0]
    width, height, _, bits, packed = struct.unpack_from("<iiHHI", raw, 18)
    row = (3 * width + 3) // 4 * 4
    if width <= 0 or not height or bits != 24 or packed or len(raw) < start + row * abs(height):
        return None
    rows = np.frombuffer(raw, np.uint8, row * abs(height), start).reshape(abs(height), row)[:, : 3 * width].reshape(abs(height), width, 3)
    return rows[:: -1 if height > 0 else 1, :, ::-1]


def decode(raw: bytes | None) -> np.ndarray | None:
    """Height x width x channels of 8-bit samples, or None."""
    if raw is None:
        return None
    return _netpbm(raw) if raw[:2] in (b"P5", b"P6") else _bmp(raw) if raw[:2] == b"BM" else None


def _integral(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of the running sum of ``values`` (whose first row is zero) at fractional places."""
    low = np.minimum(at.astype(np.int64), len(values) - 2)
    part = (at - low)[:, None]
    return values[low] * (1 - part) + values[low + 1] * part


def resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area, by the integral image."""
    h, w = grey.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = grey.cumsum(0, dtype=np.float64).cumsum(1)
    total = _integral(total, np.arange(height + 1) * (h / height))
    total = _integral(total.T, np.arange(width + 1) * (w / width)).T
    cells = total[1:, 1:] - total[:-1, 1:] - total[1:, :-1] + total[:-1, :-1]
    return cells / ((h / height) * (w / width))


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels.mean(2) if pixels.shape[2] == 3 else pixels[:, :, 0].astype(np.float64)


def difference_hash(picture: np.ndarray) -> str:
    small = np.round(resize(picture, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def tile(picture: np.ndarray, side: int = TILE) -> bytes:
    """A grey picture of ``side`` x ``side`` 8-bit samples as the bytes of an .npy file."""
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(np.clip(np.rint(resize(picture, side, side)), 0, 255), np.uint8), allow_pickle=False)
    return out.getvalue()


FEATURES = "height int, width int, channels int, payload_bytes long, payload_sha256 string, tail_crc32 long, tile binary, dhash string"


def features(pictures: DataFrame, column: str = "media") -> DataFrame:
    """``pictures`` without ``column``, with what its decoded samples give (see FEATURES)."""
    import hashlib

    kept = [f for f in pictures.schema if f.name != column]
    names = [x.split()[0] for x in FEATURES.split(", ")]
    if clash := {f.name for f in kept} & set(names):
        raise ValueError(f"columns to be renamed first: {sorted(clash)}")
    types = [pa.int32()] * 3 + [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, column):
            rows = []
            for raw in batch.column(column).to_pylist():
                pixels = decode(raw)
                if pixels is None:
                    rows.append((None,) * len(names))
                    continue
                samples, picture = pixels.tobytes(), grey(pixels)
                rows.append((*pixels.shape, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), tile(picture), difference_hash(picture)))
            own = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays(own + [pa.array(list(c), t) for c, t in zip(zip(*rows), types)], [f.name for f in kept] + names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [FEATURES])
    return pictures.select(*[f.name for f in kept], column).mapInArrow(run, schema)


def as_pictures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, padded with spaces to a positive multiple of 192 bytes, as the
    samples of a PPM picture 64 pixels wide. Netpbm is a short header before the samples, so SQL writes it."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    n = F.octet_length(raw)
    rows = F.greatest(F.lit(1), F.ceil(n / UNIT)).cast("int")
    header = F.concat(F.lit("P6\n64 "), rows.cast("string"), F.lit("\n255\n")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n_bytes"), F.concat(header, F.rpad(raw, rows * UNIT, F.lit(" ").cast("binary"))).alias("media"))


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores every text as a picture in a media table, reads that back, and computes each picture's features."""
    spark = docs.sparkSession
    pictures, path = as_pictures(docs), scratch(spark, "media")
    pictures.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(pictures.schema).parquet(path)
    media: Column = F.col("media")
    back = back.select("doc_id", "n_bytes", F.octet_length(media).cast("long").alias("media_bytes"), F.sha2(media, 256).alias("media_sha256"), "media")
    return features(back).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat_ws(":", "dhash", F.sha2("tile", 256)).alias("feature"), "tile")
