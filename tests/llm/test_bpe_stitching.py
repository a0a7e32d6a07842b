"""Stitched chunks against the library, at all offsets of the cuts and with every kind of white space."""

import hashlib
import random

import public_tokenizers

from slipwright.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def expected(rows):
    encoding = bpe.load(RANKS, PATTERN)[0]
    return sorted(((d, len(ids := encoding.encode_ordinary(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows), key=str)


def got(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in bpe.round_trip(df, RANKS, PATTERN, **sizes).collect()), key=str)


def test_random_texts(spark):
    rng = random.Random(11)
    parts = ["ab ", " ", "  ", "\n", "\n\n", "x", "é", "12", "'s", "'ll", "...", "\t", " \t", "the ", "\xa0", "　", "字", "\x1c", " ", "​", "🙂"]
    rows = []
    for k in range(10_000):
        some = rng.sample(parts, rng.randint(2, 8))
        rows.append((k, "".join(rng.choice(some) for _ in range(rng.randint(80, 260)))))
    assert got(spark, rows, chunk=97, zone=20) == expected(rows)


def test_every_offset_of_the_cut(spark):
    tails = ["12 \xa0字" * 60, "a  \n\tb" * 40, "w 　 ." * 40, " \n" + " " * 60 + "\n end of it"]
    rows = [(1000 * j + k, "a" * k + tail) for j, tail in enumerate(tails) for k in range(110)]
    assert got(spark, rows, chunk=64, zone=16) == expected(rows)


def test_long_texts_at_default_sizes(spark):
    rows = [(1, "aaaa" + "12 \xa0字" * 18000), (2, " " * 200_000 + "end"), (3, "word\n" * 60_000), (4, "x" * 70_000)]
    rows += [(5, rows[0][1]), (5, rows[0][1]), (None, rows[2][1])]
    more = [(None, *expected([(0, rows[2][1])])[0][1:])]
    assert got(spark, rows) == sorted(expected([r for r in rows if r[0] is not None]) + more, key=str)


def test_zones_that_overlap_are_refused(spark):
    import pytest

    with pytest.raises(ValueError):
        bpe.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), RANKS, PATTERN, chunk=10, zone=6)
