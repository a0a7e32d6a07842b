"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    A folder of this machine is used, and set as the checkpoint folder, only where the session names none and runs on
    one machine (tests); on a cluster a missing setting is an error, since executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="slipwright-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is a multiple of 5: the rows that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: at most ``max_bytes`` of text in each, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column as large strings (64-bit offsets), null as the empty string."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def ragged_take(pool: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates ``pool[offsets[c]:offsets[c]+lengths[c]]`` for each code c; also the lengths."""
    size = lengths[codes]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(offsets[codes] - (ends - size), size)
    return pool[at], size


def sums_by_row(values: np.ndarray, row_offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets, zero for empty rows."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[row_offsets[1:]] - total[row_offsets[:-1]]
