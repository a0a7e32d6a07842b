"""Row clustering, slants and word paths against plain versions, on close-set and long data."""

import itertools
import math
import random
import statistics
import time

from pyspark.sql import functions as F

from slipwright.operators import layout
from slipwright.operators import lexicon as X
from slipwright.operators import skew
from slipwright import patterns as P

BOX = "rid int, line_no int, text string, confidence double, x1 double, x2 double, y double, height double"


def plain_rows(tokens):
    rows = []
    for t in sorted(tokens, key=lambda t: (t["y"], t["line_no"])):
        if rows and abs(t["y"] - sum(o["y"] for o in rows[-1]) / len(rows[-1])) < 0.6 * min(statistics.median(o["height"] for o in rows[-1]), t["height"]):
            rows[-1].append(t)
        else:
            rows.append([t])
    return [[t["line_no"] for t in sorted(r, key=lambda t: (t["x1"], t["y"], t["line_no"]))] for r in rows]


def test_rows_that_stand_close(spark):
    """Rows 8 to 14 px apart with boxes of several heights: the running mean and median decide."""
    rng, data, want = random.Random(3), [], {}
    for rid in range(200):
        y, tokens = 100.0, []
        for k in range(rng.randint(1, 60)):
            if rng.random() < 0.4:
                y += rng.uniform(8, 14)
            x = rng.choice([100.0, 200.0, 300.0, 400.0])
            tokens.append({"line_no": k, "x1": x, "y": y + rng.uniform(-4, 4), "height": rng.choice([12.0, 18.0, 23.0, 30.0])})
        data += [(rid, t["line_no"], "가", 0.9, t["x1"], t["x1"] + 50, t["y"], t["height"]) for t in tokens]
        want[rid] = plain_rows(tokens)
    rows = layout.group_rows(spark.createDataFrame(data, BOX)).select("rid", "row_no", F.expr("transform(tokens, t -> t.line_no)").alias("t")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.rid, r.row_no)):
        got.setdefault(r.rid, []).append(r.t)
    assert got == want


def test_one_long_receipt(spark):
    data = [(1, k, "가", 0.9, 100.0 * (k % 4), 100.0 * (k % 4) + 50, 25.0 * (k // 4) + k % 3, 20.0) for k in range(10_000)]
    df = spark.createDataFrame(data, BOX)
    began = time.time()
    sizes = [r.n for r in layout.group_rows(df).select(F.size("tokens").alias("n")).collect()]
    assert sizes == [4] * 2500 and time.time() - began < 60
    one_row = df.filter("line_no < 2000").withColumn("y", F.lit(5.0))
    assert [r.n for r in layout.group_rows(one_row).select(F.size("tokens").alias("n")).collect()] == [2000]


def test_densest_slope(spark):
    """The estimate equals a plain count over all pairs, and its plan joins slopes with nothing."""
    rng, slopes = random.Random(5), []
    for rid in range(150):
        centre = rng.choice([0.02, 0.05, 0.1])
        slopes += [(rid, k, rng.gauss(centre, 0.004) if rng.random() < 0.6 else rng.uniform(-0.3, 0.3)) for k in range(rng.randint(3, 40))]
    df = spark.createDataFrame(slopes, "rid int, pos int, slope double")
    real = skew.neighbour_slopes
    skew.neighbour_slopes = lambda boxed: boxed
    try:
        found = skew.estimate_skew(df)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r.rid: r.slope for r in found.collect()}
    finally:
        skew.neighbour_slopes = real
    want = {}
    for rid, rows in itertools.groupby(slopes, key=lambda s: s[0]):
        values = [s for *_, s in rows]
        support, centre = 0, 0.0
        for v in values:
            near = [s for s in values if abs(s - v) <= P.SKEW_BAND]
            if len(near) > support:
                support, centre = len(near), statistics.median(near)
        if support >= P.SKEW_MIN_SUPPORT and support >= P.SKEW_MIN_SHARE * len(values) and math.radians(P.SKEW_MIN_DEG) <= abs(math.atan(centre)) <= math.radians(P.SKEW_MAX_DEG):
            want[rid] = centre
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 50


def test_word_paths(spark):
    """The best reading of a text as any number of words, against all ways to cut it."""
    rng = random.Random(2)
    letters = "가나다라"
    lexicon = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 3))): -float(rng.randint(1, 9)) for _ in range(18)}
    texts = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(250)})
    want = {}
    for text in texts:
        ways = []
        for cuts in itertools.product([False, True], repeat=len(text) - 1):
            edges = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(text)]
            words = [text[a:b] for a, b in zip(edges, edges[1:])]
            if all(w in lexicon for w in words):
                ways.append((sum(lexicon[w] for w in words), all(len(w) > 1 for w in words), len(words)))
        if ways:
            want[text] = max(w[:2] for w in ways)
    rows = [*lexicon.items(), *[(w, s - 5) for w, s in lexicon.items()], (None, 1.0), ("", 3.0)]
    got = X.assess(spark.createDataFrame([(t,) for t in [*texts, *texts, "", None]], "text string"), spark.createDataFrame(rows, "word string, score double"))
    assert {r.text: (r.score, not r.one_letter) for r in got.collect()} == want and len(want) > 50
    assert X.assess(spark.createDataFrame([("가",)], "text string"), spark.createDataFrame([], "word string, score double")).count() == 0


def test_names_of_three_words_are_repaired(spark):
    lexicon = spark.createDataFrame([("차가운", -1.0), ("파란", -2.0), ("반지", -3.0)], "word string, score double")
    names = spark.createDataFrame([(1, 1, "자가운파란반지"), (1, 2, "차가운파란반지"), (1, 3, None)], "rid int, item_no int, name string")
    lines = spark.createDataFrame([(1, 1, "차가운파란반지")], "rid int, line_no int, text string")
    got = {r.item_no: (r.corrected, r.changed) for r in X.repair_names(names, lines, lexicon).collect()}
    assert got == {1: ("차가운파란반지", True), 2: ("차가운파란반지", False), 3: (None, False)}
