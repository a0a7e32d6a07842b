"""Evidence for the amount paid: printed amounts, labels, discounts and payment sections, per receipt (rid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipwright import patterns as P
from slipwright.functions import labels as L
from slipwright.functions import money as M
from slipwright.plans.storage import stored

from .layout import with_region


def in_summary(rows: DataFrame) -> DataFrame:
    """``rows`` with ``summary``: the row lies behind the item region."""
    return with_region(rows).withColumn("summary", F.col("row_no") >= F.col("last")).drop("first", "last")


def amount_counts(rows: DataFrame) -> DataFrame:
    """(rid, amount, n, n_summary): in how many rows an absolute amount is printed (E1, E3). ``rows``: printed rows, or
    ``money_rows`` of them."""
    seen = rows if "money" in rows.columns else in_summary(rows).withColumn("money", M.row_amounts(F.col("tokens")))
    each = seen.select("rid", "row_no", "summary", F.explode(F.array_distinct("money")).alias("signed"))
    return each.groupBy("rid", F.abs("signed").alias("amount")).agg(F.count("*").alias("n"), F.count_if("summary").alias("n_summary"))


def repeated(counts: DataFrame) -> DataFrame:
    """(rid, amount): amounts of at least 1000 in two or more summary rows."""
    return counts.filter((F.col("n_summary") >= 2) & (F.col("amount") >= 1000)).select("rid", "amount")


def flags(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(rid, delivery, fee_unread, unit_price_header)."""
    delivery = lines.groupBy("rid").agg(F.bool_or(F.coalesce(F.col("text").rlike(P.DELIVERY_RECEIPT), F.lit(False))).alias("delivery"))
    seen = in_summary(rows).groupBy("rid").agg(
        F.bool_or(F.col("summary") & L.unread_fee(F.col("text"), F.col("tokens"))).alias("fee_unread"),
        F.bool_or(~F.col("summary") & F.col("compact").contains("단가") & F.col("compact").contains("수량")).alias("unit_price_header"),
    )
    return delivery.join(seen, "rid", "left").select("rid", "delivery", F.coalesce("fee_unread", F.lit(False)).alias("fee_unread"), F.coalesce("unit_price_header", F.lit(False)).alias("unit_price_header"))


def stray_fees(rows: DataFrame) -> DataFrame:
    """(rid, stray): amounts that may be a fee whose label was lost: alone, beside Latin letters only, whole hundreds
    from 500 to 10,000, from two rows before the summary on (E4)."""
    seen = with_region(rows).filter(F.col("row_no") >= F.greatest(F.lit(0), F.col("last") - 2))
    money = M.formatted_amounts(F.col("tokens"))
    bare = (L.hangul(F.col("text")) == "") & F.col("text").rlike("[A-Za-z]") & (F.size(money) == 1)
    one = F.get(money, 0)
    fits = bare & one.between(500, 10_000) & (one % 100 == 0)
    return seen.filter(fits).groupBy("rid").agg(F.array_sort(F.collect_set(one)).alias("stray"))


def summary_keys(rows: DataFrame) -> DataFrame:
    """(rid, key): the Hangul of each summary row."""
    return in_summary(rows).filter("summary").select("rid", L.hangul(F.col("text")).alias("key")).filter("key <> ''")


def money_rows(rows: DataFrame) -> DataFrame:
    """Rows with what evidence needs, without their tokens: amounts, fuzzy amounts, Hangul key, and the place in a payment
    section (E2).

    A later section heading starts anew; the first money row of a section is what was paid. What is read from a row's own
    text comes before the windows, so that these sort no tokens.
    """
    own = rows.withColumns({"money": M.row_amounts(F.col("tokens")), "formatted": M.formatted_amounts(F.col("tokens")), "fuzzy": M.fuzzy_amounts(F.col("text")), "key": L.hangul(F.col("text")), "heading": F.col("compact").rlike(P.PAID_SECTION)})
    order = Window.partitionBy("rid").orderBy("row_no")
    out = in_summary(own.drop("tokens")).withColumn("section", F.count(F.when(F.col("heading"), 1)).over(order))
    paying = (F.col("section") > 0) & ~F.col("heading") & (F.size("money") > 0)
    place = F.count(F.when(F.col("paying"), 1)).over(Window.partitionBy("rid", "section").orderBy("row_no"))
    return out.withColumn("paying", paying).withColumn("place", F.when(F.col("paying"), place))


def _last(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.element_at(values, -1))


def evidence(rows: DataFrame) -> DataFrame:
    """(rid, kind, amount, n): paid, tender, discount (a multiset: n counts rows) and unlabelled amounts.
    ``rows``: printed rows, or ``money_rows`` of them."""
    seen = (rows if "money" in rows.columns else money_rows(rows)).filter(~F.col("heading"))
    key = F.col("key")
    positive = F.filter(F.when(F.size("formatted") > 0, F.col("formatted")).otherwise(F.col("fuzzy")), lambda v: v > 0)
    seen = seen.withColumns({"_tender": key.rlike(P.TENDER_WORD), "_off": key.rlike(P.EVIDENCE_DISCOUNT), "_paid": F.col("compact").rlike(P.PAID_LABEL), "_positive": positive, "_above": F.filter("money", lambda v: v > 0)})
    cuts = F.filter(F.array_distinct(F.concat("money", "fuzzy")), lambda v: (v < 0) | ((v > 0) & F.col("_off")))
    seen = seen.withColumn("_cuts", F.transform(cuts, lambda v: F.abs(v)))
    tender = F.col("_tender") & ~F.col("_off")
    last = F.abs(_last(F.col("money")))
    empty = F.array().cast("array<struct<kind:string,amount:bigint>>")

    def as_kind(kind: str, amounts: Column) -> Column:
        return F.transform(amounts, lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("bigint").alias("amount")))

    in_section = F.when(F.col("place") == 1, as_kind("paid", F.array(last))).when(tender, as_kind("tender", F.array(last))).otherwise(as_kind("discount", F.array(last)))
    paid = F.when(F.col("_paid") & (F.size("_positive") > 0), as_kind("paid", F.array(F.element_at("_positive", -1)))).otherwise(empty)
    fee = key.rlike(P.EVIDENCE_FEE) | key.contains("배달")
    cut = F.when((F.size("_cuts") > 0) & ~fee, as_kind("discount", F.col("_cuts"))).otherwise(empty)
    tenders = F.when(~key.rlike(P.NOT_SPENT), as_kind("tender", F.transform("money", lambda v: F.abs(v)))).otherwise(empty)
    found = F.when(F.col("paying"), in_section).when(F.col("summary") & tender, tenders).otherwise(F.concat(paid, cut))
    labelled = (L.label_level(F.col("text")) > 0) | F.col("_paid") | (F.col("summary") & F.col("_tender"))
    free = F.when((F.size("_above") > 0) & ~labelled, as_kind("unlabelled", F.col("_above"))).otherwise(empty)
    each = seen.select("rid", F.when(F.col("paying") & (F.col("place") > 1) & ~tender, last).alias("cut"), found.alias("_found"), free.alias("_free")).select("rid", "cut", F.explode(F.concat("_found", "_free")).alias("e"))
    # several discounts of a payment section may be added at once: their sum stands for them where it isn't printed
    part = F.sum(F.when(F.col("e.kind") == "discount", F.col("cut"))).alias("_part")
    every = stored(each.groupBy("rid", "e.kind", "e.amount").agg(F.count("*").alias("n"), part), "found")  # read by sections too
    out = every.drop("_part")
    section = every.filter("_part is not null").groupBy("rid").agg(F.sum("_part").cast("bigint").alias("amount"))
    new = section.filter("amount > 0").join(out.filter("kind = 'discount'").select("rid", "amount"), ["rid", "amount"], "left_anti")
    return out.unionByName(new.select("rid", F.lit("discount").alias("kind"), "amount", F.lit(1).cast("bigint").alias("n")))


def unused_discounts(found: DataFrame, used: DataFrame) -> DataFrame:
    """(rid, amount, n): printed discounts less those that items have (rid, amount), as multisets (E5)."""
    printed = found.filter("kind = 'discount'").select("rid", "amount", "n")
    taken = used.groupBy("rid", "amount").agg(F.count("*").alias("m"))
    left = printed.join(taken, ["rid", "amount"], "left").withColumn("n", F.col("n") - F.coalesce("m", F.lit(0)))
    return left.filter("n > 0").select("rid", "amount", "n")


def split_payments(parts: DataFrame, targets: DataFrame) -> DataFrame:
    """(rid, target): the largest target that two to four different parts below it add up to.

    Sums of two are built once; sums of three and four are two-sum joins on what is missing.
    """
    some = parts.select("rid", F.col("amount").alias("p")).distinct().join(parts.groupBy("rid").agg(F.count_distinct("amount").alias("_n")).filter("_n >= 2").select("rid"), "rid")
    a, b = some.withColumnRenamed("p", "a"), some.withColumnRenamed("p", "b")
    two = a.join(b, "rid").filter("a < b").withColumn("s", F.col("a") + F.col("b"))
    goals = targets.select("rid", F.col("amount").alias("target")).distinct()
    hit2 = two.join(goals, (two.rid == goals.rid) & (two.s == goals.target) & (two.b < goals.target)).select(two.rid, "target")
    missing = two.join(goals, "rid").filter("b < target and s < target").withColumn("need", F.col("target") - F.col("s"))
    c = some.withColumnRenamed("p", "c")
    hit3 = missing.join(c, (missing.rid == c.rid) & (missing.need == c.c) & (c.c > missing.b)).select(missing.rid, "target")
    more = two.select(F.col("rid").alias("r"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("s").alias("s2"))
    hit4 = missing.join(more, (missing.rid == more.r) & (missing.need == more.s2) & (more.a2 > missing.b) & (more.b2 < missing.target)).select(missing.rid, "target")
    return hit2.union(hit3).union(hit4).groupBy("rid").agg(F.max("target").alias("target"))


def paid_candidates(found: DataFrame, counts: DataFrame, totals: DataFrame, claimed: DataFrame) -> DataFrame:
    """(rid, value, tier): 0 paid labels, 1 repeated amounts, the total label, and a total less a printed discount,
    2 the model's claim (E6, E7).

    ``totals``: (rid, total_amount, total_is_weak); ``claimed``: (rid, total_amount) of the model.
    """
    paid = found.filter("kind = 'paid' and amount > 0").select("rid", "amount")
    tenders = found.filter("kind = 'tender' and amount > 0").select("rid", "amount")
    label = totals.filter("total_amount > 0").select("rid", F.col("total_amount").alias("base"), "total_is_weak")
    claim = claimed.filter("total_amount > 0").select("rid", F.col("total_amount").alias("base"))
    again = repeated(counts)
    goals = label.select("rid", F.col("base").alias("amount")).unionByName(claim.select("rid", F.col("base").alias("amount"))).unionByName(again)
    split = split_payments(paid.unionByName(tenders), goals.join(paid.select("rid").distinct(), "rid"))
    kept = paid.join(split, "rid", "left").filter("target is null or amount >= target").select("rid", F.col("amount").alias("value"), F.lit(0).alias("tier"))
    bases = label.select("rid", "base").union(claim.select("rid", "base")).distinct()
    cuts = found.filter("kind = 'discount'").select("rid", "amount").distinct()
    less = bases.join(cuts, "rid").withColumn("value", F.col("base") - F.col("amount")).filter("value * 2 >= base")
    less = less.filter(~F.array_contains(M.tax_split(F.col("base")), F.col("value")))
    printed = counts.filter("n_summary > 0").select("rid", F.col("amount").alias("value"))
    less = less.join(printed, ["rid", "value"], "left_semi")
    discounted = less.join(label.select("rid", "base"), ["rid", "base"], "left_semi").select("rid").distinct().withColumn("_cut", F.lit(True))
    label = label.join(discounted, "rid", "left").filter(~(F.col("total_is_weak") & F.coalesce("_cut", F.lit(False))))
    one = again.select("rid", F.col("amount").alias("value")).union(split.select("rid", "target")).union(less.select("rid", "value")).union(label.select("rid", "base")).withColumn("tier", F.lit(1))
    two = claim.select("rid", F.col("base").alias("value"), F.lit(2).alias("tier"))
    return kept.unionByName(one).unionByName(two).distinct()
