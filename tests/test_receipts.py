"""Receipt operators: literals, hand-made receipts, and the registered queries against their SQL."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from slipwright.functions import labels as L
from slipwright.functions import money as M
from slipwright.functions import names as N
from slipwright.operators import layout
from slipwright.operators import solve as S
from slipwright.operators.items import RESTORED
from slipwright.queries import ORACLES, QUERIES
from slipwright.plans import jobs
from slipwright.streaming import joins


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_money(spark):
    assert one(spark, M.money_value, "-₩4,195", "10,500원", "1,200)", "△1,000", "8801234567890", "500", "12") == [-4195, 10500, None, None, None, 500, None]
    assert one(spark, M.fuzzy_amounts, "-1,00", "W11.305", "1;000", "2026-07-01", "010-1234-5678") == [[-1000], [11305], [1000], [], []]


def test_labels(spark):
    assert one(spark, L.label_level, "부가세(VAT):", "합 계", "키 류: 삼성카드", "거자이체", "종합계란", "샷추가: 1샷") == [2, 2, 2, 1, 1, 0]
    assert one(spark, L.fee_label, "03.배달비", "ㄴ기본배달팁", "배달팁 3,000원", "와우 무료배달", "사과 1박스(배송비포함)", "배달 비대면 요청") == ["parent", "child", "parent", "off", None, None]


def test_names(spark):
    df = spark.createDataFrame([("참치김밥", "잠치김밥"), ("콜라", "사이다")], "a string, b string")
    assert [r[0] for r in df.select(N.letter_distance(F.col("a"), F.col("b"))).collect()][0] == 1
    assert [r[0] for r in df.select(N.names_match(F.col("a"), F.col("b"))).collect()] == [True, False]


def printed(spark, *lines):
    """One receipt of (x, y, text) boxes 30 high, 20 px a letter, under the usual header."""
    head = [(100, 100, "상품명"), (400, 102, "수량"), (600, 98, "금액")]
    data = [("r", k, t, 0.95, x, y, x + max(20, 20 * len(t)), y + 30) for k, (x, y, t) in enumerate(head + list(lines))]
    df = spark.createDataFrame(data, "rid string, line_no int, text string, confidence double, x1 int, y1 int, x2 int, y2 int")
    boxed = layout.tokens(df)
    rows = layout.parse_rows(layout.group_rows(boxed))
    return rows, layout.assemble(rows, layout.char_widths(boxed))


def test_two_line_item_and_options(spark):
    rows, assembled = printed(spark, (100, 150, "꼬마김밥A"), (100, 200, "2810000316074"), (400, 200, "1"), (600, 200, "3,500"), (100, 250, "- 샷추가"), (600, 250, "500"), (100, 300, "행사할인"), (600, 300, "-1,000"), (100, 350, "합계"), (600, 350, "3,000"))
    items = layout.layout_items(assembled).collect()
    assert [(i.name, i.quantity, i.price, i.discount, [o.name for o in i.options]) for i in items] == [("꼬마김밥A", 1, 3500, 1000, ["샷추가"])]
    assert layout.total_label(rows).first()["total_amount"] == 3000


def test_waived_fee(spark):
    rows, _ = printed(spark, (100, 150, "짜장면"), (600, 150, "9,000"), (100, 200, "배달팁"), (600, 200, "1,000"), (600, 250, "-1,000"), (100, 300, "합계"), (600, 300, "9,000"))
    assert layout.delivery_fee(rows).first()["delivery_fee"] == 0


def test_oversized_receipts_stop_nothing(spark, monkeypatch):
    monkeypatch.setattr(layout, "MAX_TOKENS", 12)
    lines = [(1, k, f"줄{k}", 0.9, 10, 40 * k, 60, 40 * k + 30) for k in range(20)] + [(2, *t) for t in boxes_of(("김밥", "1", "3,000"), ("합계", "", "3,000"))]
    found = jobs.read_layout(spark.createDataFrame(lines, "rid long, line_no int, text string, confidence double, x1 int, y1 int, x2 int, y2 int"))
    assert [tuple(r) for r in found["oversized"].collect()] == [(1, 20)] and {r.rid for r in found["rows"].collect()} == {2}


def test_stream_join(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    late = t + dt.timedelta(seconds=9000)
    spark.createDataFrame([(1, t, 3), (2, t, 4), (3, late, 5)], "rid long, ts timestamp, lines int").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(1, t + dt.timedelta(seconds=20), "{}"), (2, t + dt.timedelta(seconds=500), "{}"), (3, late, "{}")], "rid long, ts timestamp, raw string").write.parquet(f"{tmp_path}/b")
    read = lambda p, s: spark.readStream.schema(s).parquet(f"{tmp_path}/{p}")
    joined = joins.join_readings(read("a", "rid long, ts timestamp, lines int"), read("b", "rid long, ts timestamp, raw string"))
    joins.run_available(joined, f"{tmp_path}/out", f"{tmp_path}/state")
    got = {r.rid: r.raw for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: "{}", 2: None, 3: "{}"}  # the late answer's receipt is there, without it


HEAD = [("상품명", 100, 100), ("수량", 400, 102), ("금액", 600, 98)]


def boxes_of(*rows):
    """Boxes of a receipt: (name, quantity, price) rows below a heading, 50 px apart."""
    boxes = list(HEAD)
    for k, (name, quantity, price) in enumerate(rows, 1):
        boxes += [(text, x, 100 + 50 * k) for text, x in ((name, 100), (quantity, 400), (price, 600)) if text]
    return [(k, text, 0.95, x, y, x + max(20, 20 * len(text)), y + 30) for k, (text, x, y) in enumerate(boxes)]


def test_streaming_merge(spark, tmp_path):
    """The whole merge, batch by batch: a missed line, an option listed as an item, a refund, and answers that can't be read."""
    import json

    answer = lambda total, *items: json.dumps({"store_name": "가게", "purchased_at": "2024-03-05 12:30", "items": [{"name": n, "quantity": q, "price": p, "sub_items": [{"name": a, "price": b} for a, b in subs]} for n, q, p, subs in items], "total_amount": total})
    foot = lambda t: (("합계", "", t), ("결제금액", "", t))
    rows = [
        (1, boxes_of(("참치김밥", "1", "3,000"), ("떡라면", "1", "4,000"), *foot("7,000")), answer(7000, ("참치김밥", 1, 3000, []))),
        (2, boxes_of(("아메리카노", "1", "4,000"), ("ㄴ샷추가", "1", "500"), ("치즈케이크", "1", "6,000"), *foot("10,500")), answer(10500, ("아메리카노", 1, 4000, []), ("샷추가", 1, 500, []), ("치즈케이크", 1, 6000, []))),
        (3, boxes_of(("참치김밥", "1", "3,000"), ("떡라면", "1", "4,000"), *foot("3,000")), answer(-3000, ("참치김밥", 1, 3000, []), ("떡라면", 1, 4000, []))),
        (4, boxes_of(("참치김밥", "1", "3,000"), *foot("3,000")), "{"),
        (5, boxes_of(("참치김밥", "1", "3,000"), *foot("3,000")), None),
        (6, boxes_of(("불고기덮밥", "2", "16,000"), ("합계", "", "16,000"), ("결제금액", "", "21,000")), answer(16000, ("불고기덮밥", 2, 16000, []))),
        (7, boxes_of(("돈까스정식", "1", "9,000"), ("배달팁 할인", "", ""), *foot("9,000")), answer(9000, ("돈까스정식", 1, 9000, [("치즈추가", 9000)]))),
    ]
    box = "array<struct<line_no:int,text:string,confidence:double,x1:int,y1:int,x2:int,y2:int>>"
    spark.createDataFrame(rows, f"rid long, lines {box}, raw string").write.parquet(f"{tmp_path}/in")
    joins.merge_stream(spark.readStream.schema(f"rid long, lines {box}, raw string").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", "2024-03-06")
    got = {r.rid: (r.month, json.loads(r.envelope)) for r in spark.read.json(f"{tmp_path}/out/envelopes").collect()}
    result = {rid: e["result"] for rid, (_, e) in got.items()}
    reasons = {rid: {c["reason"] for c in e["corrections"]} for rid, (_, e) in got.items()}
    assert [(i["name"], i["price"]) for i in result[1]["items"]] == [("참치김밥", 3000), ("떡라면", 4000)] and result[1]["items_verified"] and "ocr_recovered" in reasons[1] and got[1][0] == "2024-03"
    assert [(i["name"], [s["price"] for s in i["sub_items"]]) for i in result[2]["items"]] == [("아메리카노", [500]), ("치즈케이크", [])] and result[2]["items_verified"] and result[2]["total_amount"] == 10500
    assert len(result[3]["items"]) == 2 and "reconciled" not in reasons[3] and not result[3]["items_verified"]
    assert result[4] is None and result[5] is None and not got[4][1]["ok"]
    assert not result[6]["items_verified"]  # a larger amount is labelled as paid
    assert result[7]["items"][0]["sub_items"] == [] and result[7]["items_verified"] and "reconciled" in reasons[7]
    assert {r.rid: r.error for r in spark.read.json(f"{tmp_path}/out/dead_letters").collect()}.keys() == {4, 5}


def test_edits_add_up(spark):
    columns = "rid string, item_no int, name string, quantity int, price long, discount long, options long, layout_price long, from_ocr boolean"
    rows = [("add", 1, "참치김밥", 1, 3000, 0, 0, 0, False), ("scale", 1, "콜라", 2, 1500, 0, 100, 0, False), ("scale", 2, "사이다", 3, 700, 0, 0, 0, False), ("scale", 3, "물", 1, 900, 0, 0, 0, False), ("cut", 1, "라면", 1, 5000, 0, 0, 0, False)]
    items = spark.createDataFrame(rows, columns)
    paid = {"add": 7500, "scale": 2 * 1600 + 3 * 700 + 900, "cut": 4200}
    candidates = spark.createDataFrame([(r, v, 1) for r, v in paid.items()], "rid string, value long, tier int")
    counts = spark.createDataFrame([], "rid string, amount long, n long, n_summary long")
    unused = spark.createDataFrame([("cut", 800)], "rid string, amount long")
    restorable = spark.createDataFrame([("add", 4, "떡볶이", 1, 4500)], "rid string, ref int, name string, quantity int, price long")
    header = spark.createDataFrame([("scale",)], "rid string")
    line = M.line_total(F.col("price"), F.col("options"), F.col("discount"))
    base = items.groupBy("rid").agg(F.sum(line).alias("computed"))
    found = S.edits(items, candidates, counts, unused, restorable, header)
    solutions = S.solve(base, candidates, found)
    after = S.apply_edits(items, found, solutions, restorable)
    off = S.added_discounts(found, solutions)
    sums = after.groupBy("rid").agg(F.sum(line).alias("s")).join(off, "rid", "left").select("rid", F.col("s") - F.coalesce("added_discount", F.lit(0)))
    assert {r.rid: r.paid for r in solutions.collect()} == paid and {r[0]: r[1] for r in sums.collect()} == paid
    assert {(r.item_no, r.name, r.from_ocr) for r in after.filter("rid = 'add'").collect()} == {(1, "참치김밥", False), (RESTORED + 4, "떡볶이", True)}


def test_discount_offers(spark):
    columns = "rid string, item_no int, name string, quantity int, price long, discount long, options long, layout_price long, from_ocr boolean"
    items = spark.createDataFrame([("total", 1, "라면", 1, 5000, 300, 0, 0, False), ("free", 1, "라면", 1, 5000, 0, 500, 0, False)], columns)
    candidates = spark.createDataFrame([("total", 3800, 1), ("free", 4600, 1)], "rid string, value long, tier int")
    counts = spark.createDataFrame([], "rid string, amount long, n long, n_summary long")
    unused = spark.createDataFrame([("total", 1200)], "rid string, amount long")
    seen = [("total", "discount", 1200), ("free", "unlabelled", 900), ("free", "unlabelled", 4600), ("free", "unlabelled", 5000), ("free", "unlabelled", 500), ("free", "unlabelled", 418)]
    found = S.edits(items, candidates, counts, unused, evidence=spark.createDataFrame(seen, "rid string, kind string, amount long"), current=spark.createDataFrame([("total", 100)], "rid string, amount long"))
    assert {(e.rid, e.amount, e.cost) for e in found.filter("kind = 'add_discount'").collect()} == {("total", 1200, 1.0), ("total", 800, 1.1), ("free", 900, 1.6)}
    base = spark.createDataFrame([("total", 4600), ("free", 5500)], "rid string, computed long")
    assert {(r.rid, r.paid, tuple(r.kinds)) for r in S.solve(base, candidates, found).collect()} == {("total", 3800, ("add_discount",)), ("free", 4600, ("add_discount",))}


FAST = ["fee_gaps_filled", "restores_consistent", "larger_labels_block", "balance_check", "money_parse", "label_levels", "fee_labels", "rows_clustered", "row_parse", "item_assembly", "receipt_discount", "vlm_parsed", "evidence_kinds", "solve"]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("orders", "lineitem", "part"):
        path = f"{sf_dir}/{table}.parquet"
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = con.sql(ORACLES[name])
    assert sorted(result.columns) == columns
    clean = lambda row: repr(tuple(round(v, 6) if isinstance(v, float) else v for v in row))
    mine = sorted(clean(r) for r in df.select(*columns).collect())
    place = [result.columns.index(c) for c in columns]
    assert mine == sorted(clean([r[k] for k in place]) for r in result.fetchall())


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
