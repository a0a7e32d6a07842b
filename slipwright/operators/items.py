"""Repairs of the model's item list, each with its audit row, per receipt (rid) and position (item_no)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipwright import patterns as P
from slipwright.functions import labels as L
from slipwright.functions import money as M
from slipwright.functions import names as N

CORRECTION = ["rid", "field", "before", "after", "reason"]
#: Numbers of lines that print adds to the model's list: recovered at once, or restored by the balance.
RECOVERED, RESTORED = 1_000_000_000, 1_500_000_000


def correction(field: str, before: Column, after: Column, reason: str) -> list[Column]:
    return [F.col("rid"), F.lit(field).alias("field"), before.cast("string").alias("before"), after.cast("string").alias("after"), F.lit(reason).alias("reason")]


def drop_label_rows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items whose name is surely a label go (P4): (kept, corrections)."""
    sure = L.label_level(F.col("name")) == 2
    gone = items.filter(sure).select(*correction("items", F.concat_ws(" ", "name", F.col("price").cast("string")), F.lit("(dropped)"), "label_dropped"))
    return items.filter(~sure), gone


def fold_negatives(items: DataFrame, counted: DataFrame) -> DataFrame:
    """(rid, item_no, amount, action) of negative items (P5): tender, counted (a discount already has it, one for one)
    or discount. ``counted``: (rid, amount, n)."""
    tender = L.hangul(F.coalesce("name", F.lit(""))).rlike(P.TENDER_WORD)
    negative = items.filter("price < 0").select("rid", "item_no", (-F.col("price")).alias("amount"), tender.alias("tender"))
    place = F.row_number().over(Window.partitionBy("rid", "amount", "tender").orderBy("item_no"))
    known = negative.withColumn("_k", place).join(counted, ["rid", "amount"], "left")
    action = F.when(F.col("tender"), "tender").when(F.col("_k") <= F.coalesce("n", F.lit(0)), "counted").otherwise("discount")
    return known.select("rid", "item_no", "amount", action.alias("action"))


def drop_label_options(options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Options whose name is surely a label go (P4): (kept, corrections)."""
    sure = L.label_level(F.col("name")) == 2
    gone = options.filter(sure).select(*correction("item.sub_items", F.concat_ws(" ", "name", F.col("price").cast("string")), F.lit("(dropped)"), "label_dropped"))
    return options.filter(~sure), gone


def without_negatives(items: DataFrame, options: DataFrame, counted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, discounts, corrections): negative items without options leave the list (P5); ``discounts`` (rid, amount)
    are those that the receipt hasn't counted yet."""
    bare = items.join(options.select("rid", "item_no").distinct(), ["rid", "item_no"], "left_anti")
    found = fold_negatives(bare, counted)
    new = found.filter("action = 'discount'").groupBy("rid").agg(F.sum("amount").alias("amount"))
    says = F.when(F.col("action") == "tender", "(removed: a means of payment)").when(F.col("action") == "counted", "(removed: counted already)").otherwise(F.concat(F.lit("discount +"), F.col("amount").cast("string")))
    audit = found.join(items.select("rid", "item_no", "name"), ["rid", "item_no"]).select(*correction("items", F.concat_ws(" ", "name", (-F.col("amount")).cast("string")), says, "negative_item"))
    return items.join(found.select("rid", "item_no"), ["rid", "item_no"], "left_anti").select(*items.columns), new, audit


def restorable_in(missing: DataFrame, seen: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows of ``missing`` that reconciliation may restore: none for a receipt where the model has an item without a
    price and without a partner, since that may be the same line (J8)."""
    loose = seen.filter(F.coalesce(F.col("price"), F.lit(0)) == 0).join(matches.select("rid", F.col("v_no").alias("item_no")), ["rid", "item_no"], "left_anti").select("rid").distinct()
    return missing.filter("not recovered").join(loose, "rid", "left_anti")


def drop_total_echoes(items: DataFrame, totals: DataFrame) -> DataFrame:
    """``items`` without restored lines that repeat a total, or exceed the largest, while other lines are positive.
    ``totals``: (rid, amount)."""
    line = M.line_total(F.col("price"), F.col("options"), F.col("discount"))
    by_receipt = Window.partitionBy("rid")
    rows = items.withColumns({"_others": F.sum(line).over(by_receipt) - line, "_count": F.count("*").over(by_receipt)})
    largest = totals.groupBy("rid").agg(F.max("amount").alias("_largest"))
    rows = rows.join(totals.select("rid", F.col("amount").alias("price"), F.lit(True).alias("_echo")).distinct(), ["rid", "price"], "left")
    rows = rows.join(largest, "rid", "left")
    echo = F.col("from_ocr") & (F.coalesce("_echo", F.lit(False)) | F.coalesce(F.col("price") > F.col("_largest"), F.lit(False))) & (F.col("options") == 0) & (F.col("_others") > 0) & (F.col("_count") >= 2)
    return rows.filter(~echo).select(*items.columns)


def cap_fee(fee: Column, most: int = P.MAX_FEE) -> Column:
    """A fee beyond belief is none."""
    return F.when(fee > most, 0).otherwise(fee)


def has_line_numbers(items: DataFrame) -> DataFrame:
    """(rid, numbered): names begin with numbers that rise strictly, at least three and on 60 % of the names."""
    number = F.regexp_extract(F.trim(F.coalesce("name", F.lit(""))), P.LINE_NUMBER, 1).try_cast("int")
    seen = items.withColumn("_no", number)
    ordered = seen.filter("_no is not null").withColumn("_before", F.lag("_no").over(Window.partitionBy("rid").orderBy("item_no")))
    rising = ordered.groupBy("rid").agg(F.count("*").alias("_n"), F.bool_and(F.coalesce(F.col("_no") > F.col("_before"), F.lit(True))).alias("_rising"))
    names = items.groupBy("rid").agg(F.count("name").alias("_names"))
    out = names.join(rising, "rid", "left")
    return out.select("rid", F.coalesce((F.col("_n") >= 3) & F.col("_rising") & (F.col("_n") >= 0.6 * F.col("_names")), F.lit(False)).alias("numbered"))


def pair_barcode_prices(items: DataFrame) -> DataFrame:
    """A priced line named by a barcode gives price and quantity to the unpriced Hangul line above it, and goes."""
    order = Window.partitionBy("rid").orderBy("item_no")
    bare = F.coalesce(F.col("price"), F.lit(0)) == 0
    orphan = ~F.coalesce(F.col("name").rlike(P.HANGUL), F.lit(False)) & F.coalesce(F.col("name").rlike("[0-9]{8,}"), F.lit(False)) & ~bare
    needs = F.coalesce(F.col("name").rlike(P.HANGUL), F.lit(False)) & bare
    rows = items.withColumns({"_orphan": orphan, "_needs": needs})
    rows = rows.withColumns({"_next": F.lead(F.struct("_orphan", "price", "quantity")).over(order), "_above": F.lag("_needs").over(order)})
    takes = F.col("_needs") & F.coalesce(F.col("_next._orphan"), F.lit(False))
    gives = F.col("_orphan") & F.coalesce("_above", F.lit(False))
    rows = rows.filter(~gives).withColumns({"price": F.when(takes, F.col("_next.price")).otherwise(F.col("price")), "quantity": F.when(takes, F.coalesce("_next.quantity", "quantity")).otherwise(F.col("quantity"))})
    return rows.select(*items.columns)


def scale_unit_prices(items: DataFrame, layout_price: str = "layout_price") -> tuple[DataFrame, DataFrame]:
    """A unit price becomes the line's price where the layout has price x quantity (J14): (items, corrections)."""
    line = F.col("price") * F.col("quantity")
    scaled = F.coalesce(F.col("quantity").between(2, 50) & (F.col("price") > 0) & (F.col(layout_price) == line), F.lit(False))
    fixed = items.withColumn("price", F.when(scaled, line).otherwise(F.col("price")).cast("bigint"))
    return fixed, items.filter(scaled).select(*correction("item.price", F.col("price"), line, "unit_price_scaled"))


def match_items(seen: DataFrame, printed: DataFrame) -> DataFrame:
    """(rid, p_no, v_no, again): the item of the model that each printed item goes with (J2), by a fold over the printed
    items of a receipt in order.

    A printed item with a name takes the first item that none before it took, by the best reason: same Hangul, matching
    name, equal price where no printed name matches that item. If there is none, it is taken for another line of an item
    that was taken before (``again``): the first of a matching name, else the first of equal price. A printed item
    without a name goes by price alone, to items that no printed name matches, and only such lines count as taken for it.

    ``seen``: (rid, item_no, name, price) of the model; ``printed``: the same of the layout, summary lines left out.
    """
    v = seen.select("rid", F.col("item_no").cast("int").alias("v_no"), F.col("name").alias("v_name"), F.col("price").alias("v_price"))
    summary_line = F.coalesce(L.summary_line(F.col("name")), F.lit(False))
    p = printed.filter(~summary_line).select("rid", F.col("item_no").cast("int").alias("p_no"), F.col("name").alias("p_name"), F.col("price").alias("p_price"))
    same, equal = N.same_hangul(F.col("v_name"), F.col("p_name")), F.coalesce(F.col("v_price") == F.col("p_price"), F.lit(False))
    reason = F.when(same, 1).when(N.names_match(F.col("v_name"), F.col("p_name")), 2).when(equal, 3)
    pairs = v.join(p, "rid").withColumn("why", reason).filter("why is not null")
    by_name = F.min("why").over(Window.partitionBy("rid", "v_no")) < 3
    wish = F.struct(F.when((F.col("why") == 3) & by_name, 4).otherwise(F.col("why")).alias("why"), "v_no")
    wishes = pairs.select("rid", "p_no", (F.coalesce("p_name", F.lit("")) != "").alias("named"), wish.alias("w"))
    lists = wishes.groupBy("rid", "p_no", "named").agg(F.array_sort(F.collect_list("w")).alias("wishes"))
    lists = lists.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("p_no", "named", "wishes"))).alias("all"))
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("taken"), none.alias("nameless"), F.array().cast("array<struct<p_no:int,v_no:int,again:boolean>>").alias("pairs"))
    least = lambda wishes: F.array_min(F.transform(wishes, lambda w: w["v_no"]))

    def claim(acc: Column, one: Column) -> Column:
        taken = F.when(one["named"], acc["taken"]).otherwise(acc["nameless"])
        first = F.get(F.filter(one["wishes"], lambda w: (w["why"] < 4) & ~F.array_contains(taken, w["v_no"])), 0)["v_no"]
        other = F.when(one["named"], F.coalesce(least(F.filter(one["wishes"], lambda w: w["why"] < 3)), least(one["wishes"])))
        pick = F.coalesce(first, other)
        grown = lambda name, here: F.when(here & pick.isNotNull(), F.array_union(acc[name], F.array(pick))).otherwise(acc[name]).alias(name)
        pair = F.struct(one["p_no"].alias("p_no"), pick.alias("v_no"), first.isNull().alias("again"))
        return F.struct(grown("taken", one["named"]), grown("nameless", ~one["named"]), F.when(pick.isNotNull(), F.concat(acc["pairs"], F.array(pair))).otherwise(acc["pairs"]).alias("pairs"))

    return lists.select("rid", F.explode(F.aggregate("all", start, claim, lambda acc: acc["pairs"])).alias("m")).select("rid", "m.p_no", "m.v_no", "m.again")


def partners(seen: DataFrame, printed: DataFrame, matches: DataFrame) -> DataFrame:
    """(rid, item_no, pos, layout_price, price_line, discount, discounts, discount_line): what the printed items of an
    item say, one row an item. Its place is that of the first; the price, to hold against the model's, is that of the
    last with a matching name; the discount is the first there is.

    ``printed``: (rid, p_no, name, price, discount, discounts)."""
    rows = matches.select("rid", "p_no", F.col("v_no").alias("item_no")).join(seen.select("rid", "item_no", F.col("name").alias("_v")), ["rid", "item_no"]).join(printed.select("rid", "p_no", "name", "price", "discount", "discounts"), ["rid", "p_no"])
    sure = F.coalesce(N.names_match(F.col("_v"), F.col("name")) & (F.col("price") > 0), F.lit(False))
    priced = F.max(F.when(sure, F.struct("p_no", "price"))).alias("_priced")
    cut = F.min(F.when(F.coalesce("discount", F.lit(0)) != 0, F.struct("p_no", "discount", "discounts"))).alias("_cut")
    out = rows.groupBy("rid", "item_no").agg(F.min("p_no").cast("int").alias("pos"), priced, cut)
    return out.select("rid", "item_no", "pos", F.col("_priced.price").alias("layout_price"), F.col("_priced.p_no").alias("price_line"), "_cut.discount", "_cut.discounts", F.col("_cut.p_no").alias("discount_line"))


def renumbered(items: DataFrame, options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, options) with items numbered from 1 in the order of their numbers; options of other items go."""
    rows = items.withColumn("_new", F.row_number().over(Window.partitionBy("rid").orderBy("item_no")))
    subs = options.join(rows.select("rid", "item_no", "_new"), ["rid", "item_no"]).withColumn("item_no", F.col("_new")).select(*options.columns)
    return rows.withColumn("item_no", F.col("_new")).select(*items.columns), subs


def in_order(items: DataFrame) -> DataFrame:
    """``items`` with their place ``seq`` on the list (S4, E15): the model's lines in its order, then those recovered from
    print in theirs, as their numbers say; a restored line stands behind the last line of the list that is printed above
    it, or first if none is, or last if its own place is unknown. Restored lines go in by the order of print, so that
    each sees those before it: a fold over them, with the list as its state."""
    restored = F.col("item_no") >= RESTORED
    entry = F.struct("item_no", F.col("pos").cast("int").alias("pos"))
    lists = items.groupBy("rid").agg(F.array_sort(F.collect_list(F.when(~restored, entry))).alias("list"), F.array_sort(F.collect_list(F.when(restored, F.struct(F.coalesce(F.col("pos").cast("int"), F.lit(1 << 30)).alias("at"), "item_no")))).alias("back"))

    def insert(done: Column, one: Column) -> Column:
        above = F.array_max(F.transform(done, lambda x, k: F.when(x["pos"] < one["at"], k + 1)))
        place = F.when(one["at"] == 1 << 30, F.size(done)).otherwise(F.coalesce(above, F.lit(0)))
        new = F.struct(one["item_no"].alias("item_no"), F.when(one["at"] < 1 << 30, one["at"]).alias("pos"))
        return F.concat(F.slice(done, F.lit(1), place), F.array(new), F.slice(done, place + 1, F.size(done)))

    placed = lists.select("rid", F.posexplode(F.aggregate("back", F.col("list"), insert)).alias("seq", "x")).select("rid", F.col("x.item_no").alias("item_no"), (F.col("seq") + 1).alias("seq"))
    return items.join(placed, ["rid", "item_no"])


def greedy(pairs: DataFrame) -> DataFrame:
    """(rid, p_no, v_no): each p_no in order takes its best v_no, by (why, v_no), that none before it took.
    ``pairs``: (rid, p_no, v_no, why)."""
    wishes = pairs.groupBy("rid", "p_no").agg(F.array_sort(F.collect_list(F.struct("why", "v_no"))).alias("wishes"))
    lists = wishes.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("p_no", "wishes"))).alias("all"))
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast("array<struct<p_no:int,v_no:int>>").alias("pairs"))

    def claim(acc: Column, one: Column) -> Column:
        free = F.filter(one["wishes"], lambda w: ~F.array_contains(acc["taken"], w["v_no"]))
        pick = F.get(free, 0)["v_no"]
        got = F.size(free) > 0
        return F.struct(F.when(got, F.concat(acc["taken"], F.array(pick))).otherwise(acc["taken"]).alias("taken"), F.when(got, F.concat(acc["pairs"], F.array(F.struct(one["p_no"].alias("p_no"), pick.alias("v_no"))))).otherwise(acc["pairs"]).alias("pairs"))

    return lists.select("rid", F.explode(F.aggregate("all", start, claim, lambda acc: acc["pairs"])).alias("m")).select("rid", "m.p_no", "m.v_no")


def own_lines(matches: DataFrame) -> DataFrame:
    """``matches`` without further lines of an item: each item of the model stays with the first printed line that went
    with it, so the others are lines that no item of the model is left for, however like a taken one they are."""
    return matches.groupBy("rid", "v_no").agg(F.min("p_no").alias("p_no")).select("rid", "p_no", "v_no")


def unmatched(printed: DataFrame, matches: DataFrame) -> DataFrame:
    """Printed, priced items with at least two syllables that no item of the model has (J7, J8): ``recovered`` if the
    name is read surely, else only a candidate for reconciliation."""
    left = printed.join(matches.select("rid", F.col("p_no").alias("item_no")), ["rid", "item_no"], "left_anti")
    left = left.filter(F.col("price").isNotNull() & (F.char_length(L.hangul(F.coalesce("name", F.lit("")))) >= 2))
    return left.withColumn("recovered", F.col("name_conf") >= 0.8).filter("recovered or price > 0")


def summary(corrections: DataFrame) -> DataFrame:
    """(field, reason, n, receipts) of an audit table, with sums over the reasons of a field and over all (E20): there
    reason, or both, are null."""
    return corrections.rollup("field", "reason").agg(F.count("*").alias("n"), F.count_distinct("rid").alias("receipts"))
