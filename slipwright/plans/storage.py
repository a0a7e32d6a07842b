"""Tables between workloads, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import partial
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read again: later plans begin at a table, which any executor
    can read, and don't grow with what came before. A folder of this machine is used only where none is set and the
    session runs on one machine."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}{spark.conf.get(FOLDER, '')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Names the folder below the shared one that a ``passing`` block writes to.
FOLDER = "slipwright.folder"


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="slipwright-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


@contextmanager
def passing(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables stored in this block go to a folder of its own, which is removed behind it: they must have been used up."""
    before, folder = spark.conf.get(FOLDER, ""), f"/{name}-{uuid.uuid4().hex}"
    spark.conf.set(FOLDER, before + folder)
    try:
        yield
    finally:
        spark.conf.set(FOLDER, before) if before else spark.conf.unset(FOLDER)
        path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark) + before + folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def at_once(spark: SparkSession, *steps: Callable[[], T]) -> list[T]:
    """Results of steps that don't need each other: their plans and jobs are made at the same time, so small ones don't
    leave the cluster idle while the next is planned. Steps may call this again."""
    if not steps:
        return []
    with ThreadPoolExecutor(min(4, len(steps))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(lambda step: step()), steps))


def stored_together(*tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """``stored`` for tables that don't need each other."""
    return at_once(tables[0][0].sparkSession, *[partial(stored, *t) for t in tables]) if tables else []
