"""Repairs of dates, names, slant and options on hand-made receipts."""

import os

import pytest

from slipwright import repair_queries  # noqa: F401
from slipwright.operators import dates, layout, lexicon, options, skew
from slipwright.queries import ORACLES, QUERIES

TODAY = "2026-10-01"
LINES = "rid string, line_no int, text string, confidence double"


def fixed(spark, value, *texts, confidence=0.95):
    lines = spark.createDataFrame([("r", k, t, confidence) for k, t in enumerate(texts)], LINES)
    receipts = spark.createDataFrame([("r", value)], "rid string, purchased_at string")
    out, audit = dates.fix_dates(receipts, lines, TODAY)
    return out.first()["purchased_at"], [r.reason for r in audit.collect()]


def test_dates(spark):
    assert fixed(spark, "2023-07-26 18:47", "26-07-0118:47,수요일") == ("2026-07-01 18:47", ["date_from_ocr"])
    assert fixed(spark, "2023-08-25 10:00") == ("2026-08-25 10:00", ["stale_year"])
    assert fixed(spark, "2023-08-25", "2023년 8월 26일") == ("2023-08-25", [])
    assert fixed(spark, "2026-07-03", "2026-07-01") == ("2026-07-03", [])  # one digit apart
    assert fixed(spark, "2025-01-01", "승인일 2026-03-04", "2026-05-06")[0] == "2026-03-04"
    assert fixed(spark, "2026-02-30", "2026-03-04") == ("2026-02-30", [])
    assert fixed(spark, None, None) == (None, [])


def test_names(spark):
    words = spark.createDataFrame([("참치", 5.0), ("김밥", 5.0), ("고추장", 6.0), (None, 1.0)], "word string, score double")
    names = spark.createDataFrame([("r", 1, "잠치김밥 2줄"), ("r", 2, "구운란"), ("r", 3, "참치김밥"), ("r", 4, "A-1"), ("r", 5, None), ("r", 6, "고추정")], "rid string, item_no int, name string")
    lines = spark.createDataFrame([("r", 1, "구운란"), ("q", 1, "고추장")], "rid string, line_no int, text string")
    got = {r.item_no: (r.corrected, r.reason) for r in lexicon.repair_names(names, lines, words).collect()}
    assert got == {1: ("참치김밥 2줄", "confusion_swap"), 2: ("구운란", "vlm_ocr_agree"), 3: ("참치김밥", "original_plausible"), 4: ("A-1", "too_short"), 5: (None, "too_short"), 6: ("고추장", "confusion_swap")}


def test_names_of_options(spark):
    words = spark.createDataFrame([("참치", 5.0), ("김밥", 5.0)], "word string, score double")
    names = spark.createDataFrame([("r", 1, 0, "참치김밥"), ("r", 1, 1, "잠치김밥"), ("r", 2, 0, None)], "rid string, item_no int, sub_no int, name string")
    lines = spark.createDataFrame([], "rid string, line_no int, text string")
    audit = lexicon.name_audit(lexicon.repair_names(names, lines, words, key=("rid", "item_no", "sub_no"))).collect()
    assert [tuple(a) for a in audit] == [("r", "item.sub_items.name", "잠치김밥", "참치김밥", "name_repaired")]


def test_slant(spark):
    data = []
    for row in range(5):
        for k, x in enumerate((100, 240, 380)):
            centre = x + 50
            data.append(("r", row * 3 + k, "가나다", 0.9, x, int(1000 + row * 60 + centre * 0.05), x + 100, int(1030 + row * 60 + centre * 0.05)))
    boxed = layout.tokens(spark.createDataFrame(data, "rid string, line_no int, text string, confidence double, x1 int, y1 int, x2 int, y2 int"))
    assert abs(skew.estimate_skew(boxed).first()["slope"] - 0.05) < 0.004
    assert skew.estimate_skew(boxed.filter("line_no < 6")).count() == 0
    assert skew.deskew(boxed).exceptAll(boxed).count() == 0  # no header


def tables(spark, items, subs, printed=(), below=()):
    item = "rid string, item_no int, name string, quantity int, price long, discount long"
    option = "rid string, item_no int, sub_no int, name string, price long"
    return (
        spark.createDataFrame([("r", *i) for i in items], item), spark.createDataFrame([("r", *o) for o in subs], option),
        spark.createDataFrame([("r", *p) for p in printed], "rid string, p_no int, name string, price long, quantity int"),
        spark.createDataFrame([("r", *b) for b in below], "rid string, p_no int, sub_no int, name string, price long, mark boolean, strong boolean"),
    )


def subs_of(df):
    return sorted((r.item_no, r.name, r.price) for r in df.collect())


def test_promote_and_reassign(spark):
    items, subs, printed, below = tables(spark, [(1, "짜장면", 1, 9000, 0), (2, "군만두", 1, 5000, 0)], [(1, 1, "탕수육", 15000), (1, 2, "치즈추가", 700)], [(1, "짜장면", 9000, 1), (2, "군만두", 5000, 1), (3, "탕수육", 15000, 1)], [(2, 1, "치즈추가", 700, True, True)])
    items2, subs2, audit = options.promote_options(items, subs, printed)
    assert [r.name for r in items2.orderBy("item_no").collect()] == ["짜장면", "군만두", "탕수육"] and audit.count() == 1
    moved, log = options.reassign_options(items, subs2, printed, below)
    assert subs_of(moved) == [(2, "치즈추가", 700)] and [r.reason for r in log.collect()] == ["sub_reassigned"]


def test_demote_and_recover(spark):
    items, subs, printed, below = tables(spark, [(1, "떡볶이", 1, 8000, 0), (2, "토네이도소세지", 1, 2100, 0)], [], [(1, "떡볶이", 8000, 1)], [(1, 1, "토네이도소세지", 2100, False, False), (1, 2, "보통맛", None, True, True)])
    kept, lower, _ = options.demote_items(items, subs, printed, below)
    assert [r.name for r in kept.collect()] == ["떡볶이"] and subs_of(lower) == [(1, "토네이도소세지", 2100)]
    matches = spark.createDataFrame([("r", 1, 1)], "rid string, p_no int, v_no int")
    full, log = options.attach_options(kept, lower, matches, printed, below)
    assert subs_of(full) == [(1, "보통맛", 0), (1, "토네이도소세지", 2100)] and [r.reason for r in log.collect()] == ["option_recovered"]


def test_twins_below_one_item(spark):
    printed = [(1, "떡볶이", 8000, 1), (2, "짜장면", 9000, 1)]
    items, subs, shown, below = tables(spark, [(1, "떡볶이", 1, 8000, 0), (2, "치즈추가", 1, 700, 0), (3, "치즈추가", 1, 700, 0), (4, "콜라", 1, 900, 0)], [(3, 1, "보통맛", 0)], printed, [(1, 1, "치즈추가", 700, True, True), (1, 2, "콜라", 900, True, True)])
    kept, lower, log = options.demote_items(items, subs, shown, below)
    assert [r.name for r in kept.collect()] == ["떡볶이"] and log.count() == 3
    assert [(r.sub_no, r.name) for r in lower.orderBy("sub_no").collect()] == [(1, "치즈추가"), (2, "보통맛"), (3, "콜라")]  # the second cheese is a twin
    items, subs, shown, below = tables(spark, [(1, "떡볶이", 1, 8000, 0), (2, "짜장면", 1, 9000, 0)], [(2, 1, "치즈 추가", 700), (2, 2, "치즈추가", 700), (2, 3, None, None)], printed, [(1, 1, "치즈추가", 700, True, True)])
    moved, log = options.reassign_options(items, subs, shown, below)
    assert sorted((r.item_no, r.name, r.price) for r in moved.filter("name is not null").collect()) == [(1, "치즈추가", 700)] and moved.count() == 2 and log.count() == 2
    empty = subs.limit(0)
    assert options.reassign_options(items, empty, shown, below)[0].count() == 0


def test_wraps_marks_and_fees(spark):
    items, subs, *_ = tables(spark, [(1, "통닭 + 콜라", 1, 20000, 0), (2, "치킨 무", None, None, 0), (3, "▶텀블러", 1, 0, 0), (4, "배달비", 1, 3000, 0), (5, None, 1, -3000, 0)], [(1, 1, "양념", 500), (2, 1, "양념", 500), (2, 2, "포장", None)])
    joined, subs, _ = options.merge_wrapped_names(items, subs)
    assert joined.filter("item_no = 1").first()["name"] == "통닭 + 콜라 + 치킨 무" and subs_of(subs.na.fill(0)) == [(1, "양념", 500), (1, "포장", 0)]
    lower, subs, _ = options.demote_marked(joined, subs)
    none = spark.createDataFrame([], "rid string, delivery_fee long")
    kept, _, fee, audit = options.take_fees(lower, subs, none, none)
    assert [r.item_no for r in kept.collect()] == [1] and fee.first()["delivery_fee"] == 0 and audit.count() == 2
    assert (1, "텀블러", 0) in subs_of(subs)


@pytest.mark.parametrize("name", ["printed_dates", "dates_repaired", "names_repaired", "names_audited", "names_unwrapped", "option_discounts_folded", "marked_lines_demoted", "fees_taken", "options_promoted", "options_reassigned", "items_demoted", "options_attached", "quads_boxed"])
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("orders", "lineitem", "part"):
        path = f"{sf_dir}/{table}.parquet"
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = con.sql(ORACLES[name])
    place = [result.columns.index(c) for c in columns]
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(repr(tuple(r[k] for k in place)) for r in result.fetchall())
