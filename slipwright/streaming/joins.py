"""Streaming merge: the two readings of a receipt arrive apart and are joined in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipwright.plans import jobs
from slipwright.plans.storage import passing, stored
from slipwright.sources.tables import parsed_responses

#: The model's answer is waited for this long.
TIMEOUT = "180 seconds"


def join_readings(lines: DataFrame, responses: DataFrame, timeout: str = TIMEOUT) -> DataFrame:
    """Packed OCR lines (rid, ts, lines) with the model's answer (rid, ts, raw) within ``timeout``.

    Both sides have watermarks, so the state holds only unmatched halves of the last ``timeout``; a receipt whose
    answer never comes is emitted with a null answer once the watermark has passed.
    """
    a = lines.withWatermark("ts", timeout).alias("a")
    b = responses.select(F.col("rid").alias("b_rid"), F.col("ts").alias("b_ts"), "raw").withWatermark("b_ts", timeout).alias("b")
    near = F.expr(f"rid = b_rid AND b_ts >= ts AND b_ts <= ts + interval {timeout}")
    return a.join(b, near, "leftOuter").select("rid", "ts", "lines", "raw", "b_ts")


def parsed(readings: DataFrame) -> DataFrame:
    """Stateless stage on joined readings: ok and error of each receipt's answer; no answer is not ok."""
    return parsed_responses(readings.select("rid", "raw")).select("rid", "ok", "error")


def dead_letters(answers: DataFrame) -> DataFrame:
    """Receipts whose answer can't be read or never came."""
    return answers.filter(~F.col("ok")).select("rid", F.coalesce("error", F.lit("no answer")).alias("error"))


def merge_stream(readings: DataFrame, path: str, checkpoint: str, today: str | None = None) -> None:
    """The streaming merge (T1): joined readings, ``lines`` an array of boxes, go through the whole merge batch by batch.

    What needs one row alone, reading the answer's JSON, is part of the stream's own plan. The merge needs all rows of a
    receipt together and has them, as a receipt arrives as one row. A batch writes its envelopes and dead letters to
    folders of its number, so a batch that is run again replaces what it wrote, and removes its scratch tables.
    """
    answers = parsed_responses(readings.select("rid", "lines", "raw"), keep=("lines",))

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with passing(spark, f"batch-{number}"):
            rows = stored(batch, "readings")
            lines = rows.select("rid", F.explode("lines").alias("l")).select("rid", "l.*")
            merged = jobs.merge(lines, rows.drop("lines"), today)
            jobs.envelopes(merged, {"batch": str(number)}).write.mode("overwrite").json(f"{path}/envelopes/batch={number}")
            dead_letters(rows).write.mode("overwrite").json(f"{path}/dead_letters/batch={number}")

    answers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there, into Parquet."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
