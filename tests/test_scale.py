"""What must hold for tables of any size: no estimate that sends a table to the driver, no work done twice, and short ways
that give what the long ones give."""

from pyspark.sql import functions as F

from slipwright.operators import evidence as E
from slipwright.operators import layout, lexicon
from slipwright.plans import jobs
from slipwright.queries import QUERIES
from slipwright.sources import adapter as A


def estimated(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_answers_are_not_thought_small(spark, sf_dir):
    receipts, items, options = jobs.read_answers(A.vlm_responses(spark, sf_dir))
    sums = items.groupBy("rid").agg(F.count("*").alias("n"), F.sum("price").alias("price"))
    assert 20 * estimated(sums) > 24 * sums.count() and 20 * estimated(receipts.select("rid", "ok")) > 9 * receipts.count()


def test_receipt_discount_lays_out_once(spark, sf_dir):
    assert not any("lineitem" in f for f in QUERIES["receipt_discount"](spark, sf_dir).inputFiles())


def test_evidence_of_money_rows(spark, sf_dir):
    rows = layout.parse_rows(layout.group_rows(layout.tokens(A.ocr_lines(spark, sf_dir).filter("rid < 200"))))
    short = E.money_rows(rows)
    assert "tokens" not in short.columns
    for of in (E.evidence, E.amount_counts):
        assert sorted(of(short).collect()) == sorted(of(rows).collect())


def test_rows_far_apart_need_no_fold(spark, sf_dir, monkeypatch):
    boxed = layout.tokens(A.ocr_lines(spark, sf_dir).filter("rid < 300"))
    boxed = boxed.withColumn("y", F.col("y") + F.when(F.col("rid") % 3 == 0, F.col("x1") * 0.03).when(F.col("rid") % 3 == 1, F.col("line_no") % 10 * 4).otherwise(0))
    boxed = boxed.withColumn("height", F.when(F.col("rid") % 5 != 0, F.col("height")))
    quick = sorted(layout.group_rows(boxed).select("rid", "row_no", "y_center", "text").collect(), key=lambda r: (r.rid, r.row_no))
    monkeypatch.setattr(layout, "SLACK", 1e9)  # no receipt is plain
    assert quick == sorted(layout.group_rows(boxed).select("rid", "row_no", "y_center", "text").collect(), key=lambda r: (r.rid, r.row_no))


def test_nearest_tokens_move_each_side_once(spark):
    runs = spark.createDataFrame([(1, "잠치"), (1, "구운란"), (2, "김밥")], "rid long, run string")
    lines = spark.createDataFrame([(1, 3, "참치 한줄"), (1, 2, "구운란"), (2, 1, "3,000")], "rid long, line_no int, text string")
    found = lexicon.nearest_tokens(runs, lines)
    assert {(r.rid, r.run, r.token) for r in found.collect()} == {(1, "잠치", "참치"), (1, "구운란", "구운란")}
    fresh = lexicon.nearest_tokens(runs, lines)._jdf.queryExecution().executedPlan().toString()
    assert fresh.count("Exchange") == 2
