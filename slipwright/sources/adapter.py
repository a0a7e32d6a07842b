"""Receipts derived from an order table: the library's inputs for tests and for work at scale.

An order is a receipt and its lines are the items. Names are Hangul renderings of the part names, prices whole won.
Printed faults are set by remainders of the order and line numbers, so they are the same wherever they are computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Part-name words and their Hangul.
WORDS = {
    "cold": "차가운", "blue": "파란", "new": "새로운", "large": "커다란", "red": "빨간", "small": "작은", "hot": "뜨거운", "old": "오래된",
    "ring": "반지", "bolt": "볼트", "plate": "접시", "rod": "막대", "gear": "기어", "gizmo": "장치", "anvil": "모루", "widget": "부품",
}
# Printed names of every sort, dealt over lines by remainder.
LABELS = [
    "부가세", "합 계", "할인금액", "배달팁 할인", "행사할인", "쿠폰할인", "할인: 현재잔액", "포인트", "카드결제", "ㄴ기본배달팁", "배달팁 3,000원", "사과 1박스(배송비포함)", "종합계란", "[행사]콜라:500ml",
    "부가세(VAT):", "면세물품", "총액", "샷추가: 1샷", "와우 무료배달", "배달팁(기본)", "- 샷추가", "+치즈", "001 몬스터", "옵션 면추가", "직원 에누리20%", "D/C 행사", "키 류: 삼성카드", "배달팁", "거자이체", "02) 국산콩", "배달비:", "특매 -",
]
FEE = 3000
#: Every so many receipts one is a refund, in ``answers``.
REFUND = 29
OCR = "rid bigint, line_no int, text string, confidence double, x1 int, y1 int, x2 int, y2 int"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def korean(name: Column) -> Column:
    for word, hangul in WORDS.items():
        name = F.replace(name, F.lit(word), F.lit(hangul))
    return F.replace(name, F.lit(" "), F.lit(""))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, item_no, name, quantity, price, discount): the true items; discount is what is printed below the line."""
    lines = _read(spark, sf_dir, "lineitem")
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("item_no", F.row_number().over(order))
    price = F.floor("l_extendedprice").cast("bigint")
    printed = (F.col("l_orderkey") + F.col("item_no")) % 3 == 0
    return rows.select(
        F.col("l_orderkey").alias("rid"), "item_no", korean(F.col("p_name")).alias("name"), F.col("l_quantity").cast("int").alias("quantity"), price.alias("price"),
        F.when(printed, F.floor(price * F.col("l_discount")).cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("discount"),
    )


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, n, fee, printed_total): orders without lines have no items and no total."""
    sums = items(spark, sf_dir).groupBy("rid").agg(F.max("item_no").alias("n"), F.sum(F.col("price") - F.col("discount")).alias("net"))
    fee = F.when(F.col("rid") % 5 == 0, F.lit(FEE)).otherwise(0).cast("bigint")
    wrong = F.when(F.col("rid") % 19 == 0, 1000).otherwise(0)
    return sums.select("rid", "n", fee.alias("fee"), (F.col("net") + fee + wrong).alias("printed_total"))


def _won(amount: Column) -> Column:
    return F.format_number(amount, 0)


def _box(line_no: Column, text: Column, confidence: Column, x: int, y: Column) -> Column:
    width = F.greatest(F.lit(20), F.char_length(text) * 20)
    return F.struct(line_no.cast("int").alias("line_no"), text.alias("text"), confidence.cast("double").alias("confidence"), F.lit(x).alias("x1"), y.cast("int").alias("y1"), (width + x).cast("int").alias("x2"), (y + 30).cast("int").alias("y2"))


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, line_no, text, confidence, x1, y1, x2, y2): header, items, discounts, fee, total and payment."""
    k, rid = F.col("item_no"), F.col("rid")
    y, sure = 100 + 50 * k, F.lit(0.95)
    shown = F.when((rid + k) % 11 == 0, F.replace(_won(F.col("price")), F.lit(","), F.lit("."))).otherwise(_won(F.col("price")))
    named = F.when(((rid * 3 + k) % 7 == 0) & (k > 1), F.concat(F.lit("+"), F.col("name"))).otherwise(F.col("name"))
    blurred = F.lit(0.7) + ((rid * 7 + k * 13) % 30) / 100
    boxes = [_box(10 * k + 1, named, blurred, 100, y), _box(10 * k + 2, F.col("quantity").cast("string"), sure, 400, y + 2), _box(10 * k + 3, shown, sure, 600, y - 2)]
    cut = [_box(10 * k + 4, F.lit("행사할인"), sure, 100, y + 25), _box(10 * k + 5, F.concat(F.lit("-"), _won(F.col("discount"))), sure, 600, y + 25)]
    of_items = items(spark, sf_dir).select("rid", F.explode(F.concat(F.array(*boxes), F.when(F.col("discount") > 0, F.array(*cut)).otherwise(F.array().cast(_BOXES)))).alias("t"))
    n, total = F.col("n"), _won(F.col("printed_total"))
    foot = 100 + 50 * (n + 1)
    head = [_box(F.lit(1), F.lit("상품명"), sure, 100, F.lit(100)), _box(F.lit(2), F.lit("수량"), sure, 400, F.lit(102)), _box(F.lit(3), F.lit("금액"), sure, 600, F.lit(98))]
    fee = [_box(10 * n + 11, F.lit("배달팁"), sure, 100, foot), _box(10 * n + 12, _won(F.col("fee")), sure, 600, foot)]
    end = [_box(10 * n + 21, F.lit("합계"), sure, 100, foot + 50), _box(10 * n + 22, total, sure, 600, foot + 50), _box(10 * n + 31, F.lit("결제금액"), sure, 100, foot + 100), _box(10 * n + 32, total, sure, 600, foot + 100)]
    rest = totals(spark, sf_dir).select("rid", F.explode(F.concat(F.array(*head, *end), F.when(F.col("fee") > 0, F.array(*fee)).otherwise(F.array().cast(_BOXES)))).alias("t"))
    return of_items.unionByName(rest).select("rid", "t.*")


_BOXES = "array<struct<line_no:int,text:string,confidence:double,x1:int,y1:int,x2:int,y2:int>>"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, item_no, label, price): printed names of every sort."""
    at = ((F.col("rid") * 7 + F.col("item_no")) % len(LABELS)).cast("int")
    return items(spark, sf_dir).select("rid", "item_no", F.array(*map(F.lit, LABELS))[at].alias("label"), "price")


def vlm_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, raw): the model's JSON, fenced for even receipts, cut short for every 23rd; every 17th line is missed and
    every 13th has the unit price."""
    rid, k = F.col("rid"), F.col("item_no")
    price = F.when((rid + k) % 13 == 0, F.floor(F.col("price") / F.col("quantity")).cast("bigint")).otherwise(F.col("price"))
    seen = items(spark, sf_dir).filter((rid + k) % 17 != 0)
    one = F.struct(k.alias("item_no"), F.struct("name", "quantity", price.alias("price")).alias("item"))
    lists = seen.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["item"]).alias("items"))
    whole = totals(spark, sf_dir).join(lists, "rid", "left")
    store = F.when(rid % 4 == 0, "상호명").otherwise(F.concat(F.lit("store "), rid.cast("string")))
    json = F.to_json(F.struct(store.alias("store_name"), F.col("items"), F.col("printed_total").alias("total_amount")))
    fenced = F.when(rid % 2 == 0, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).otherwise(json)
    return whole.select("rid", F.when(rid % 23 == 0, F.substring(json, 1, 25)).otherwise(fenced).alias("raw"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, raw): ``vlm_responses`` with more kinds of receipts: every 29th is a refund (its prices and total are below
    0), every 31st has no total, every 37th a total of 0, and every sixth lists its lines from the last to the first."""
    rid = F.col("rid")
    kind = F.when(rid % REFUND == 0, "refund").when(rid % 31 == 0, "none").when(rid % 37 == 0, "zero")
    below = F.regexp_replace(F.regexp_replace("raw", r'"price":([1-9])', r'"price":-$1'), r'"total_amount":([1-9])', r'"total_amount":-$1')
    total = r'"total_amount":-?[0-9]+'
    changed = F.when(kind == "refund", below).when(kind == "none", F.regexp_replace("raw", total, '"total_amount":null')).when(kind == "zero", F.regexp_replace("raw", total, '"total_amount":0')).otherwise(F.col("raw"))
    listed = F.regexp_extract_all(F.col("raw"), F.lit(r'\{"name":[^{}]*\}'), F.lit(0))
    turned = F.concat(F.regexp_extract("raw", r'^([^\[]*\[)', 1), F.array_join(F.reverse(listed), ","), F.regexp_extract("raw", r'(\][^\]]*)$', 1))
    whole = F.col("raw").contains("total_amount") & (rid % 6 == 1) & kind.isNull()
    return vlm_responses(spark, sf_dir).select("rid", F.when(whole, turned).otherwise(changed).alias("raw"))


def claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, item_no, src_no, name, quantity, price, discount): what the model's JSON says, with the printed discount."""
    rid, k = F.col("rid"), F.col("item_no")
    seen = items(spark, sf_dir).filter(((rid + k) % 17 != 0) & (rid % 23 != 0))
    price = F.when((rid + k) % 13 == 0, F.floor(F.col("price") / F.col("quantity")).cast("bigint")).otherwise(F.col("price"))
    place = F.row_number().over(Window.partitionBy("rid").orderBy("item_no"))
    return seen.select("rid", place.alias("item_no"), k.alias("src_no"), "name", "quantity", price.alias("price"), "discount")
