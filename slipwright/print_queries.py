"""Queries of what print says beside the list of items: midnights, payment sections, lost fee labels, discounts of the
receipt, unit prices of options, and lines that may be restored; with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipwright.operators import dates as D
from slipwright.operators import evidence as E
from slipwright.operators import items as I
from slipwright.operators import layout
from slipwright.operators import options as O
from slipwright.plans import jobs
from slipwright.plans.storage import stored
from slipwright.queries import CLAIMED, ITEMS, query
from slipwright.sources import adapter as A


def _line(line_no: int, text: str | Column, x: int, y: int | Column) -> Column:
    return A._box(F.lit(line_no), F.lit(text) if isinstance(text, str) else text, F.lit(0.95), x, y if not isinstance(y, int) else F.lit(y))


def _lines(rows: DataFrame, *boxes) -> DataFrame:
    """(rid, line_no, text, ...): boxes of each row; null boxes aren't printed."""
    return rows.select("rid", F.explode(F.array_compact(F.array(*boxes))).alias("t")).select("rid", "t.*")


@query("""SELECT o_orderkey AS rid, CASE o_orderkey % 6 WHEN 5 THEN NULL WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 12:30' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 00:00'
    WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T0:00:00' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS purchased_at, o_orderkey % 6 IN (0, 3) AS dropped FROM orders""")
def midnights_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Midnights go where print has none (P8): it has the figures, or twelve at night in words, or a longer number that
    only holds them; some receipts say another hour, or nothing. One is printed in a box of its own."""
    rid, day = F.col("rid"), F.date_format("o_orderdate", "yyyy-MM-dd")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("rid"), "o_orderdate")
    kind = rid % 6
    said = F.when(kind == 4, F.concat(day, F.lit(" 12:30"))).when(kind == 2, F.concat(day, F.lit("T0:00:00"))).when(kind != 5, F.concat(day, F.lit(" 00:00")))
    text = F.when(kind == 1, F.concat(day, F.lit(" 00 : 00"))).when(kind == 2, F.lit("오전 12:00")).when(kind == 3, F.lit("10:00:001"))
    lines = orders.select("rid", F.explode(F.array(F.lit("영수증"), text)).alias("text"))
    fixed, audit = D.drop_midnights(orders.select("rid", said.alias("purchased_at")), lines)
    return fixed.join(audit.select("rid", F.lit(True).alias("dropped")), "rid", "left").select("rid", "purchased_at", F.coalesce("dropped", F.lit(False)).alias("dropped"))


@query(f"""WITH {ITEMS}, s AS (SELECT rid, printed_total AS t, 100 * (1 + rid % 9) AS a, 100 * (1 + rid % 7) AS b FROM totals),
  e AS (SELECT rid, 'paid' AS kind, t AS amount, 1 AS n FROM s UNION ALL SELECT rid, 'paid', t - 100, 1 FROM s WHERE rid % 5 = 0
    UNION ALL SELECT rid, 'tender', 5000, 1 FROM s WHERE rid % 3 = 0
    UNION ALL SELECT rid, 'discount', a, 1 FROM s WHERE rid % 2 = 0 UNION ALL SELECT rid, 'discount', b, 1 FROM s WHERE rid % 2 = 0
    UNION ALL SELECT rid, 'discount', a + b, 1 FROM s WHERE rid % 2 = 0)
  SELECT rid, kind, CAST(amount AS BIGINT) AS amount, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY ALL""")
def payment_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What payment sections say (E2): the first amount of a section was paid, a means of payment is a tender, the others
    are discounts, and their sum is one where it isn't printed by itself (every eighth receipt prints it above). A second
    heading opens a second section."""
    rid, t = F.col("rid"), F.col("printed_total")
    won = A._won
    a, b = 100 * (1 + rid % 9), 100 * (1 + rid % 7)
    pairs = [("합계", t, None), ("행사할인", -(a + b), rid % 8 == 0), ("결제금액상세", None, None), ("승인금액", t, None), ("쿠폰할인", a, rid % 2 == 0), ("멤버십할인", b, rid % 2 == 0), ("상품권", F.lit(5000), rid % 3 == 0), ("결제내역", None, rid % 5 == 0), ("체크카드", t - 100, rid % 5 == 0)]
    boxes = []
    for k, (text, amount, only) in enumerate(pairs):
        row = [_line(10 * k + 1, text, 100, 100 + 50 * k)] + ([] if amount is None else [_line(10 * k + 2, won(amount), 600, 102 + 50 * k)])
        boxes += row if only is None else [F.when(only, box) for box in row]
    lines = _lines(A.totals(spark, sf_dir), *boxes)
    rows = stored(layout.group_rows(layout.tokens(lines)), "rows")
    return E.evidence(rows).filter("kind <> 'unlabelled'")


@query(f"""WITH {ITEMS} SELECT rid, CAST(300 + 50 * (rid % 240) AS BIGINT) AS stray FROM totals WHERE rid % 3 = 0 AND n >= 4 AND 300 + 50 * (rid % 240) BETWEEN 500 AND 10000 AND rid % 2 = 0 AND (300 + 50 * (rid % 240) >= 1000 OR rid % 4 = 0)""")
def stray_fee_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts that may be a fee whose label was lost (E4): whole hundreds within bounds beside Latin letters, next to the
    summary. The same letters with such an amount below the first line are none; amounts below 1,000 have no comma and
    count with a currency sign only (F3), which every fourth receipt prints."""
    rid, n = F.col("rid"), F.col("n")
    some = A.totals(spark, sf_dir).filter("rid % 3 = 0 and n >= 4")
    late, early = 125 + 50 * n, F.lit(175)
    amount = A._won(300 + 50 * (rid % 240))
    amount = F.when(rid % 4 == 0, F.concat(F.lit("₩"), amount)).otherwise(amount)
    extra = _lines(some, _line(3, "Tip", 100, early), _line(4, "2,000", 600, early), _line(5, "TIP", 100, late), _line(6, amount, 600, late))
    plain = A.ocr_lines(spark, sf_dir).join(some.select("rid"), "rid", "left_semi")
    # discounts of the last line would stand where the letters do
    plain = plain.join(some.select("rid", "n"), "rid").filter(~F.col("line_no").isin(14, 15) & ~(F.col("line_no").isin(10 * n + 4, 10 * n + 5))).drop("n")
    rows = stored(layout.group_rows(layout.tokens(plain.unionByName(extra))), "rows")
    return E.stray_fees(rows).select("rid", F.explode("stray").alias("stray"))


@query(f"""WITH {ITEMS}, g AS (SELECT rid, sum(discount) AS own, CAST(sum(discount) + CASE rid % 4 WHEN 0 THEN 700 WHEN 1 THEN -50 ELSE 0 END AS BIGINT) AS shown, rid % 4 <> 2 AS printed, CASE WHEN rid % 3 = 0 THEN max(price) END AS told FROM items GROUP BY rid)
  SELECT rid, CAST(greatest(0, greatest(CASE WHEN printed THEN shown ELSE 0 END, coalesce(told, 0)) - own) AS BIGINT) AS top FROM g""")
def receipt_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt's discount (E17): the larger of what print sums up and what stood among the options, less what items
    have. Print's sum is more, less, missing or the same; every third receipt has one among its options."""
    items = stored(A.items(spark, sf_dir).select("rid", "price", "discount"), "items")
    rid = F.col("rid")
    sums = stored(items.groupBy("rid").agg(F.sum("discount").alias("own"), F.max("price").alias("most")), "sums")
    printed = sums.filter("rid % 4 <> 2").select("rid", (F.col("own") + F.when(rid % 4 == 0, 700).when(rid % 4 == 1, -50).otherwise(0)).alias("summary_discount"))
    told = sums.filter("rid % 3 = 0").select("rid", F.col("most").alias("amount"))
    return jobs.receipt_discounts(sums.select("rid"), printed, told, items)


@query(f"""WITH {ITEMS}, {CLAIMED}, loose AS (SELECT rid FROM claimed WHERE (rid + 2 * item_no) % 11 = 0 AND (rid + item_no) % 3 = 0)
  SELECT rid, item_no, name, price FROM items WHERE (rid + item_no) % 17 = 0 AND item_no % 2 = 0 AND rid NOT IN (SELECT rid FROM loose)""")
def restorable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed lines that the balance may restore (J8): none that is recovered already, and none on a receipt where the
    model has an item without a price (a null or 0) and without a partner, as that may be the same line."""
    rid, k = F.col("rid"), F.col("item_no")
    missing = A.items(spark, sf_dir).filter((rid + k) % 17 == 0).withColumn("recovered", k % 2 == 1)
    seen = stored(A.claimed(spark, sf_dir), "seen")
    unpriced = (rid + 2 * k) % 11 == 0
    price = F.when(~unpriced, F.col("price")).when(rid % 2 == 0, 0)
    matches = seen.filter((rid + k) % 3 != 0).select("rid", k.alias("v_no"))
    return I.restorable_in(missing, seen.withColumn("price", price), matches).select("rid", "item_no", "name", "price")


@query(f"""WITH {ITEMS}, o AS (SELECT rid, item_no, s AS sub_no, quantity AS q, CASE WHEN s < 3 THEN price ELSE price + 1 END AS price, rid % 2 AS more FROM items, (SELECT unnest([1, 2, 3]) AS s))
  SELECT rid, item_no, CAST(sub_no AS INT) AS sub_no, CAST(CASE WHEN (rid + item_no) % 2 = 0 AND sub_no <= 1 + more THEN price * q ELSE price END AS BIGINT) AS price FROM o""")
def option_line_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options with the price of one, where print has that of the line (J14): of two alike as many change as print shows;
    a third has another price, and items that weren't scaled keep theirs."""
    rid, k = F.col("rid"), F.col("item_no")
    items = stored(A.items(spark, sf_dir).select("rid", "item_no", "quantity", "name", "price"), "items")
    options = items.select("rid", "item_no", "name", "price", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("sub_no"))
    options = options.withColumn("price", F.when(F.col("sub_no") < 3, F.col("price")).otherwise(F.col("price") + 1))
    scaled = items.filter((rid + k) % 2 == 0).select("rid", "item_no", "quantity")
    line = (F.col("price") * F.col("quantity")).alias("price")
    printed = items.select("rid", "item_no", line).unionByName(items.filter("rid % 2 = 1").select("rid", "item_no", line))
    return O.scale_option_prices(options, scaled, printed).select("rid", "item_no", "sub_no", "price")
