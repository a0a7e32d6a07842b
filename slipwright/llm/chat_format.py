"""Chat formatting: conversations rendered by a compiled template, with loss masks, and parsed back.

Turns are marked by ``### role: `` and ``</turn>``. Inside roles and texts a backslash goes before each backslash and
each control string, so the marks can't be forged and the escape can be undone. The formatted table has a row per
``part_chars`` characters of a conversation (nearly always one row): (conv_id, part, n_turns, text, loss), where loss
lists the [a, b) stretches of the part's text, in code points, that a model is trained on. Parts end between turns.

Defined cases: rows of a conversation are ordered by turn, then role, then text (nulls first), repeated rows are turns
of their own; a null role or text is an empty one; rows with a null conv_id are one conversation with a null id; an
empty table gives an empty result; other columns are left out. A conversation of any length streams through one task
(its digest is of its turns in order) with one part in memory at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat_template import Mark, compile_template
from .common import scratch

TEMPLATE = """{% for message in messages %}### {{ message.role | escape_role }}: {% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}{% else %}{{ message.text | escape }}{% endif %}</turn>
{% endfor %}"""
PART_CHARS = 4 << 20
FORMATTED = "conv_id long, part long, n_turns long, text string, loss array<struct<a:long,b:long>>"

_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def escape_role(text: str) -> str:
    return _ROLE_CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS = {"escape": escape, "escape_role": escape_role}


def parse_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of formatted text."""
    at = 0
    while at < len(text):
        m = _turn_at(text, at)
        yield m[0], m[1]
        at = m[2]


def _turn_at(text: str, at: int) -> tuple[str, str, int]:
    if not text.startswith("### ", at):
        raise ValueError(f"no turn at {at}")
    end = _find(text, ": ", at + 4)
    stop = _find(text, "</turn>\n", end + 2)
    return unescape(text[at + 4 : end]), unescape(text[end + 2 : stop]), stop + 8


def _find(text: str, mark: str, at: int) -> int:
    """The next place of ``mark`` without the escape before it."""
    k = at
    while (k := text.index(mark, k)) > at:
        slashes = k
        while slashes > at and text[slashes - 1] == "\\":
            slashes -= 1
        if (k - slashes) % 2 == 0:
            break
        k += 1
    return k


def _streams(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple]:
    """(first, row) over rows sorted by key: first is true where a new key begins."""
    last = object()
    for batch in batches:
        names = batch.schema.names
        for k in range(0, batch.num_rows, 1000):
            for row in zip(*(c.to_pylist() for c in batch.slice(k, 1000).columns)):
                row = dict(zip(names, row))
                yield row[key] != last, row
                last = row[key]


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, filters: dict | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """The formatted table of ``conversations`` (conv_id, turn, role, text)."""
    filters = FILTERS if filters is None else filters
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = compile_template(template, filters)
        stream, ahead = _streams(batches, "conv_id"), []

        def messages(state: dict) -> Iterator[dict]:
            """The conversation's turns; what comes behind its last stays for the next one."""
            while True:
                first, row = ahead.pop() if ahead else next(stream, (True, None))
                if row is None or (first and state["n"]):
                    ahead.append((first, row))
                    return
                state["n"] += 1
                state["new"] = True
                yield row

        done: list[tuple] = []
        size = 0
        while True:
            first, row = ahead.pop() if ahead else next(stream, (True, None))
            if row is None:
                break
            ahead.append((first, row))
            state = {"n": 0, "new": False}
            part, before, text, loss, at = 0, 0, [], [], 0
            for piece in program({"messages": messages(state)}):
                if state["new"]:  # a turn begins with this piece: the only place where a part may end
                    state["new"] = False
                    if at >= part_chars:
                        done.append((row["conv_id"], part, state["n"] - 1 - before, "".join(text), loss))
                        part, before, text, loss, size, at = part + 1, state["n"] - 1, [], [], size + at, 0
                if piece is Mark.START:
                    loss.append({"a": at, "b": at})
                elif piece is Mark.END:
                    loss[-1]["b"] = at
                else:
                    text.append(piece)
                    at += len(piece)
                if size > part_chars:
                    yield _formatted(done)
                    done, size = [], 0
            if text or not part:
                done.append((row["conv_id"], part, state["n"] - before, "".join(text), loss))
                size += at
            if size > part_chars or len(done) > 5000:
                yield _formatted(done)
                done, size = [], 0
        if done:
            yield _formatted(done)

    return rows.mapInArrow(run, FORMATTED)


def _formatted(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], ["conv_id", "part", "n_turns", "text", "loss"])


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted table: turns, loss text and their SHA-256 (see DIGESTS)."""
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = [], None

        def close() -> None:
            if now:
                out.append((now["id"], now["n"], now["turns"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"]))

        for first, row in _streams(batches, "conv_id"):
            if first:
                close()
                now = {"id": row["conv_id"], "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            for role, text in parse_turns(row["text"]):
                now["n"] += 1
                now["turns"].update(f"{role}\n{text}\n".encode())
            for span in row["loss"]:
                masked = unescape(row["text"][span["a"] : span["b"]])
                now["loss_chars"] += len(masked)
                now["loss"].update(masked.encode())
            now["chars"] += len(row["text"])
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)

    return rows.mapInArrow(run, DIGESTS)


def format_and_read(conversations: DataFrame, template: str = TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """Writes the formatted table to the shared folder and computes the digests from what is read back."""
    spark = conversations.sparkSession
    path = scratch(spark, "formatted")
    format_conversations(conversations, template, part_chars=part_chars).write.option("compression", "zstd").parquet(path)
    return digests(spark.read.schema(FORMATTED).parquet(path))
