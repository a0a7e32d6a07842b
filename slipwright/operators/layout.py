"""From text boxes to printed rows, items, discounts, fee and total. All work is per receipt (rid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipwright import patterns as P
from slipwright.functions import labels as L
from slipwright.functions.money import money_value, row_amounts

MAX_TOKENS = 10_000
# Fixed value: pixels by which a step must pass a limit to be judged without the mean of its row.
SLACK = 0.001


def tokens(lines: DataFrame) -> DataFrame:
    """Boxed lines as tokens; lines without a box are skipped, an unknown confidence is 1."""
    return lines.filter(F.col("x1").isNotNull()).select(
        "rid", "line_no", "text", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.col("x1").cast("double").alias("x1"), F.col("x2").cast("double").alias("x2"),
        (F.col("y2") - F.col("y1")).cast("double").alias("height"), ((F.col("y1") + F.col("y2")) / 2).alias("y"),
    )


def oversized(boxed: DataFrame) -> DataFrame:
    """(rid, n): receipts of more than MAX_TOKENS boxes. They are junk input, for the dead letters: no print has so many,
    and a fold over them would fill memory."""
    return boxed.groupBy("rid").agg(F.count("*").alias("n")).filter(F.col("n") > MAX_TOKENS)


def group_rows(boxed: DataFrame) -> DataFrame:
    """Printed rows (L1): from top to bottom a token joins the open row if it is nearer to the row's mean height than
    0.6 of the smaller of the row's median box height and its own. (rid, row_no, x1, y_center, text, compact, tokens).

    One aggregation by rid, and a fold over the receipt's tokens. Its state is small, as a fold copies it at each step: of
    the open row the number of tokens, the sum of their heights on the page and their box heights in order, and of all
    rows where they begin.
    """
    one = F.struct("y", "line_no", "x1", "x2", "height", "text", "confidence", "amount")
    known = (F.count("y") == F.count("*")) & (F.count("height") == F.count("*"))
    packed = boxed.withColumn("amount", money_value(F.col("text"))).groupBy("rid").agg(F.array_sort(F.collect_list(one)).alias("all"), F.when(known, F.max("height")).alias("_high"), F.when(known, F.min("height")).alias("_low"))
    # where rows lie far apart, no fold is needed: a step of 0.6 of the highest box opens a row in any state, and within
    # 0.6 of the lowest box of their first one all tokens join; SLACK keeps rounded means away from both limits
    far = F.transform("all", lambda t, i: F.when((i == 0) | (t["y"] - F.get("all", i - 1)["y"] >= 0.6 * F.col("_high") + SLACK), i))
    packed = packed.withColumn("_far", F.array_compact(far))
    width = lambda x, k: F.get("all", F.coalesce(F.get("_far", k + 1), F.size("all")) - 1)["y"] - F.get("all", x)["y"]
    packed = packed.withColumn("_plain", F.forall(F.transform("_far", lambda x, k: width(x, k) < 0.6 * F.col("_low") - SLACK), lambda x: x))
    nothing = F.array().cast("array<double>")
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"), nothing.alias("heights"), F.array().cast("array<int>").alias("begins"))

    def step(acc: Column, t: Column) -> Column:
        half = F.floor((acc["n"] + 1) / 2).cast("int")
        median = (F.get(acc["heights"], half - 1) + F.get(acc["heights"], F.floor(acc["n"] / 2).cast("int"))) / 2
        near = F.coalesce((acc["n"] > 0) & (F.abs(t["y"] - acc["sum"] / acc["n"]) < 0.6 * F.least(median, t["height"])), F.lit(False))
        h = t["height"].cast("double")
        put = F.concat(F.filter(acc["heights"], lambda x: x <= h), F.array(h), F.filter(acc["heights"], lambda x: x > h))
        return F.struct(
            (acc["k"] + 1).alias("k"), F.when(near, acc["n"] + 1).otherwise(1).alias("n"), F.when(near, acc["sum"] + t["y"]).otherwise(F.lit(0.0) + t["y"]).alias("sum"),
            F.when(near, put).otherwise(F.array(h)).alias("heights"), F.when(near, acc["begins"]).otherwise(F.concat(acc["begins"], F.array(acc["k"]))).alias("begins"),
        )

    begins = F.when(F.coalesce("_plain", F.lit(False)), F.col("_far")).otherwise(F.aggregate("all", start, step, lambda acc: acc["begins"]))
    ends = lambda b: F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(F.size("all")))
    cut = lambda b: F.zip_with(b, ends(b), lambda x, y: F.slice("all", x + 1, y - x))
    folded = F.flatten(F.transform(F.array(begins), cut))  # an array of one: the fold is run once
    sorted_ = lambda row: F.transform(F.array_sort(F.transform(row, lambda t: F.struct(t["x1"].alias("x1"), t["y"].alias("y"), t["line_no"].alias("line_no"), t.alias("t")))), lambda s: s["t"])
    by_x = lambda row: F.when(F.size(row) == 1, row).otherwise(sorted_(row))
    rows = packed.select("rid", F.posexplode(folded).alias("row_no", "tokens")).withColumn("tokens", by_x(F.col("tokens")))
    mean = F.aggregate("tokens", F.lit(0.0), lambda s, t: s + t["y"]) / F.size("tokens")
    rows = rows.select("rid", "row_no", F.col("tokens")[0]["x1"].alias("x1"), mean.alias("y_center"), F.array_join("tokens.text", " ").alias("text"), "tokens")
    return rows.select("rid", "row_no", "x1", "y_center", "text", L.compact(F.col("text")).alias("compact"), "tokens")


def item_region(rows: DataFrame) -> DataFrame:
    """(rid, first, last): rows of the item region, last exclusive (L4)."""
    return with_region(rows).groupBy("rid").agg(F.first("first").alias("first"), F.first("last").alias("last"))


def with_region(rows: DataFrame) -> DataFrame:
    """``rows`` with ``first`` and ``last`` of their receipt's item region: windows over the receipt's rows, which stay
    where they are, so that no join with the rows' own summary is needed."""
    header = F.col("text").rlike(P.HEADER_NAME) & F.col("text").rlike(P.HEADER_COLUMNS)
    by_receipt = Window.partitionBy("rid")
    marked = rows.withColumn("first", F.coalesce(F.min(F.when(header, F.col("row_no") + 1)).over(by_receipt), F.lit(0)))
    ends = (F.col("row_no") >= F.col("first")) & F.col("compact").rlike(P.REGION_END)
    return marked.withColumn("last", F.coalesce(F.min(F.when(ends, F.col("row_no"))).over(by_receipt), F.count("*").over(by_receipt).cast("int")))


def parse_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with name, quantity, price and name_conf (L5): the right-most amount is the price, the last short
    number that isn't it the quantity, the other tokens with Hangul the name."""
    price_at = F.coalesce(F.array_max(F.transform("tokens", lambda t, i: F.when(t["amount"].isNotNull(), i))), F.lit(-1))
    short = lambda t, i: (i != F.col("_p")) & t["text"].rlike(P.PLAIN_INT) & t["text"].try_cast("int").between(1, 999)
    quantity_at = F.coalesce(F.array_max(F.transform("tokens", lambda t, i: F.when(short(t, i), i))), F.lit(-1))
    names = F.filter("tokens", lambda t, i: (i != F.col("_p")) & (i != F.col("_q")) & t["text"].rlike(P.HANGUL))
    at = lambda c, field: F.when(F.col(c) >= 0, F.element_at("tokens", F.col(c) + 1)[field])
    out = rows.withColumn("_p", price_at).withColumn("_q", quantity_at).withColumn("_names", names)
    return out.withColumns({
        "price": at("_p", "amount"),
        "quantity": at("_q", "text").try_cast("int"),
        "name": F.when(F.size("_names") > 0, F.array_join("_names.text", " ")),
        "name_conf": F.coalesce(F.array_min("_names.confidence"), F.lit(1.0)),
    }).drop("_p", "_q", "_names")


def char_widths(boxed: DataFrame) -> DataFrame:
    """(rid, char_width): median width of a character over Hangul tokens, 1 if there are none."""
    width = F.when(F.col("text").rlike(P.HANGUL), (F.col("x2") - F.col("x1")) / F.char_length("text"))
    return boxed.groupBy("rid").agg(F.coalesce(F.median(width), F.lit(1.0)).alias("char_width"))


def total_label(rows: DataFrame) -> DataFrame:
    """(rid, total_amount, total_is_weak): the last positive labelled amount, else the first labelled one; a weak
    label only counts without a strong one (L9). ``rows`` are parsed rows."""
    key = F.col("compact")
    strong = key.rlike(P.TOTAL_LABEL)
    weak = ~strong & key.rlike(P.TOTAL_LABEL_WEAK) & ~key.rlike(P.DISCOUNT_WORD)
    usable = ~key.rlike(P.TENDER_ROW) & F.col("price").isNotNull()

    def pick(kind: Column) -> Column:
        return F.coalesce(F.max_by(F.col("price"), F.when(usable & kind & (F.col("price") > 0), F.col("row_no"))), F.min_by(F.col("price"), F.when(usable & kind, F.col("row_no"))))

    found = rows.groupBy("rid").agg(pick(strong).alias("s"), pick(weak).alias("w"))
    return found.select("rid", F.coalesce("s", "w").alias("total_amount"), (F.col("s").isNull() & F.col("w").isNotNull()).alias("total_is_weak"))


def restated(rows: DataFrame) -> DataFrame:
    """Negative rows of parsed ``rows``, with whether they repeat the sum of those before: (rid, row_no, price, restated)."""
    before = Window.partitionBy("rid").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    negative = rows.filter(F.col("price") < 0).select("rid", "row_no", "price", "name")
    out = negative.withColumns({"_n": F.count("*").over(before), "_sum": F.sum(F.abs("price")).over(before)})
    same = (F.col("_n") > 0) & (F.abs("price") == F.col("_sum")) & ((F.col("_n") >= 2) | F.col("name").isNotNull())
    return out.select("rid", "row_no", "price", F.coalesce(same, F.lit(False)).alias("restated"))


def _value_digits(tokens_: Column) -> Column:
    return F.exists(tokens_, lambda t: t["text"].rlike("[0-9]") & ~t["text"].rlike(P.HANGUL))


def delivery_fee(rows: DataFrame) -> DataFrame:
    """(rid, delivery_fee) of parsed ``rows`` that have one (L8): fee rows with their amount or one borrowed from the
    nameless row below, less up to two nameless negative rows that follow; equal parent fees count once."""
    order = Window.partitionBy("rid").orderBy("row_no")
    state = F.struct("name", "price", _value_digits(F.col("tokens")).alias("digits"))
    seen = rows.withColumn("_kind", L.fee_label(F.col("name"))).withColumn("_s", state)
    seen = seen.withColumns({f"_f{k}": F.lead("_s", k).over(order) for k in (1, 2, 3)})
    fee = seen.filter(F.col("_kind").isNotNull() & (F.size(F.array_distinct(row_amounts(F.col("tokens")))) <= 1))
    one, two, three = F.col("_f1"), F.col("_f2"), F.col("_f3")
    owned = two.isNotNull() & two["name"].isNotNull() & two["price"].isNull() & ~two["digits"]
    borrow = F.col("price").isNull() & ~F.col("_s.digits") & one.isNotNull() & one["name"].isNull() & (one["price"] > 0) & ~F.coalesce(owned, F.lit(False))
    borrow = F.coalesce(borrow, F.lit(False))
    less = lambda s: F.coalesce(s.isNotNull() & s["name"].isNull() & (s["price"] < 0), F.lit(False))
    below = lambda a, b: F.when(less(a), a["price"] + F.when(less(b), b["price"]).otherwise(0)).otherwise(0)
    amount = F.when(F.col("price").isNotNull(), F.col("price") + below(one, two)).when(borrow, one["price"] + below(two, three))
    found = fee.withColumn("_amount", amount).filter(F.col("_amount").isNotNull())
    parents = F.sum_distinct(F.when(F.col("_kind") == "parent", F.col("_amount")))
    children = F.sum(F.when(F.col("_kind") == "child", F.col("_amount")))
    offs = F.sum(F.when(F.col("_kind") == "off", -F.abs("_amount")))
    zero = F.lit(0).cast("bigint")
    return found.groupBy("rid").agg(F.greatest(zero, F.coalesce(parents, children, zero) + F.coalesce(offs, zero)).alias("delivery_fee"))


def assemble(rows: DataFrame, widths: DataFrame) -> DataFrame:
    """Parsed rows of the item region with ``role`` and ``item_id`` (L6), see ``roles`` for the meaning of each.

    ``rows`` are parsed rows, ``widths`` of ``char_widths``. Every state of a receipt read from top to bottom is a
    value of a window over its rows, so the work is one sort by (rid, row_no) for all of them.
    """
    region = with_region(rows.select("rid", "row_no", "x1", "text", "compact", "name", "quantity", "price", "name_conf")).filter((F.col("row_no") >= F.col("first")) & (F.col("row_no") < F.col("last"))).join(widths, "rid")
    order = Window.partitionBy("rid").orderBy("row_no")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    name, price, key = F.col("name"), F.col("price"), L.compact(F.coalesce("name", F.lit("")))
    negative = F.coalesce(price < 0, F.lit(False))
    fee = F.col("compact").rlike(P.DELIVERY_WORD)
    out = region.withColumns({
        "base_x": F.coalesce(F.min(F.when(name.isNotNull(), F.col("x1"))).over(Window.partitionBy("rid")), F.lit(0.0)),
        "fee": fee,
        "after_fee": F.coalesce(F.last(F.when(fee, True).when(name.isNotNull(), False), ignorenulls=True).over(so_far), F.lit(False)),
        "_n": F.count(F.when(negative & ~fee, 1)).over(before),
        "_sum": F.sum(F.when(negative & ~fee, F.abs(price))).over(before),
        "label": key.rlike(P.LABEL_NAME) | key.rlike(P.TOTAL_LABEL),
        "kind": L.discount_kind(name, price),
        "mark": F.coalesce(L.marked(name), F.lit(False)),
    })
    again = F.coalesce((F.col("_n") > 0) & (F.abs(price) == F.col("_sum")) & ((F.col("_n") >= 2) | name.isNotNull()), F.lit(False))
    out = out.withColumn("cut", negative & ~F.col("fee") & (name.isNull() | again)).withColumn("again", again & negative)
    early = F.col("fee") | F.col("cut") | F.col("label") | F.col("kind").isNotNull()
    indent = F.when(F.col("char_width") != 0, (F.col("x1") - F.col("base_x")) / F.col("char_width")).otherwise(0.0)
    out = out.withColumn("_early", early).withColumn("_opt", ~early & name.isNotNull() & (F.col("mark") | (indent >= 1.5) | negative))
    # an unmarked row a little to the right of an option goes on with the options: islands of such rows
    step = F.col("x1") - F.lag("x1").over(order)
    next_mark = F.coalesce(F.lead("mark").over(order), F.lit(False))
    chained = ~early & ~F.col("_opt") & name.isNotNull() & F.coalesce(price > 0, F.lit(False)) & ((step >= 0.6 * F.col("char_width")) | (next_mark & (step >= 0.3 * F.col("char_width"))))
    out = out.withColumn("_chain", F.coalesce(chained, F.lit(False)))
    out = out.withColumn("_island", F.count(F.when(~F.col("_chain"), 1)).over(so_far))
    out = out.withColumn("_option", F.first("_opt").over(Window.partitionBy("rid", "_island").orderBy("row_no")) & (F.col("_opt") | F.col("_chain")))
    # a chain can only follow an option that has an item above it; priced names are certain items
    plain = ~F.col("_early") & ~F.col("_option")
    out = out.withColumn("_sure_item", plain & name.isNotNull() & price.isNotNull())
    orphan = F.col("_option") & (F.coalesce(F.count(F.when(F.col("_sure_item") | (plain & name.isNull() & (price > 0)), 1)).over(before), F.lit(0)) == 0)
    out = out.withColumn("_orphan", orphan)
    was_orphan = F.coalesce(F.lag("_orphan").over(order), F.lit(False))
    alone = plain & name.isNotNull() & price.isNull()
    priced = plain & name.isNull() & price.isNotNull()
    waiting = F.struct(F.when(alone & ~was_orphan, True).otherwise(False).alias("on"), "name", "quantity", "name_conf")
    event = F.when(F.col("fee") | F.col("cut") | alone | F.col("_sure_item") | priced, waiting)
    out = out.withColumn("_wait", F.last(event, ignorenulls=True).over(before)).withColumn("_waits", F.coalesce(F.col("_wait.on"), F.lit(False)))
    made = F.col("_sure_item") | (priced & (F.col("_waits") | (price > 0)))
    out = out.withColumn("_item", made).withColumn("item_id", F.count(F.when(made, 1)).over(so_far))
    owned = F.col("item_id") > 0
    role = (
        F.when(F.col("fee"), "fee")
        .when(F.col("cut") & F.col("after_fee"), "fee_offset")
        .when(F.col("cut"), F.when(F.col("again") | ~owned, "summary_discount").otherwise("item_discount"))
        .when(F.col("label"), "label")
        .when(F.col("kind") == "total", "summary_discount")
        .when(F.col("kind") == "item", F.when(owned, "item_discount").otherwise("summary_discount"))
        .when(F.col("_option"), F.when(owned, "option").otherwise("orphan_option"))
        .when(F.col("_item"), "item")
        .when(alone, "name")
        .otherwise("other")
    )
    borrowed = F.col("_item") & name.isNull() & F.col("_waits")
    return out.select(
        "rid", "row_no", role.alias("role"), "item_id",
        F.when(borrowed, F.col("_wait.name")).otherwise(name).alias("name"), F.when(borrowed, F.coalesce("quantity", "_wait.quantity")).otherwise(F.col("quantity")).alias("quantity"), "price",
        F.when(borrowed, F.col("_wait.name_conf")).otherwise(F.col("name_conf")).alias("name_conf"), "mark",
    )


def layout_items(assembled: DataFrame) -> DataFrame:
    """(rid, item_id, name, quantity, price, name_conf, discount, discounts, options): items with what is below them."""
    mine = assembled.filter(F.col("item_id") > 0)
    item = lambda c: F.max(F.when(F.col("role") == "item", F.col(c))).alias(c)
    cuts = F.array_sort(F.collect_list(F.when(F.col("role") == "item_discount", F.struct("row_no", F.abs("price").alias("amount")))))
    options = F.array_sort(F.collect_list(F.when(F.col("role") == "option", F.struct("row_no", L.without_marks(F.col("name")).alias("name"), "price", "mark", L.strongly_marked(F.col("name")).alias("strong")))))
    found = mine.groupBy("rid", "item_id").agg(item("name"), item("quantity"), item("price"), item("name_conf"), cuts.alias("cuts"), options.alias("options"))
    return found.select("rid", "item_id", "name", "quantity", "price", "name_conf", F.aggregate("cuts", F.lit(0).cast("bigint"), lambda s, c: s + c["amount"]).alias("discount"), F.transform("cuts", lambda c: c["amount"]).alias("discounts"), F.col("options"))


def receipt_discount(assembled: DataFrame, rows: DataFrame) -> DataFrame:
    """(rid, summary_discount, discount): summary discounts in and behind the item region, and what they exceed the
    items' discounts by (L10)."""
    inside = assembled.filter(F.col("role").isin("summary_discount", "item_discount")).select("rid", "role", F.abs("price").alias("amount"))
    behind = with_region(rows.select("rid", "row_no", "text", "compact", "name", "price")).filter((F.col("row_no") >= F.col("last")) & L.discount_kind(F.col("name"), F.col("price")).isNotNull())
    every = inside.unionByName(behind.select("rid", F.lit("summary_discount").alias("role"), F.abs("price").alias("amount")))
    zero = F.lit(0).cast("bigint")
    summed = every.groupBy("rid").agg(F.coalesce(F.sum(F.when(F.col("role") == "summary_discount", F.col("amount"))), zero).alias("summary_discount"), F.coalesce(F.sum(F.when(F.col("role") == "item_discount", F.col("amount"))), zero).alias("_items"))
    return summed.select("rid", "summary_discount", F.greatest(zero, F.col("summary_discount") - F.col("_items")).alias("discount"))
