"""Whole workloads: layout, matching with the model's reading, and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipwright.functions import labels as L
from slipwright.functions import money as M
from slipwright.functions import names as N
from slipwright.operators import dates as D
from slipwright.operators import evidence, layout, skew, solve
from slipwright.operators import items as I
from slipwright.operators import lexicon as X
from slipwright.operators import options as O
from slipwright.sources.tables import parsed_responses

from .storage import at_once, stored, stored_together


def read_layout(lines: DataFrame) -> dict[str, DataFrame]:
    """Workload A: the tables of printed receipts; those of ``oversized`` (rid, n) are in none of the others."""
    boxed = stored(layout.tokens(lines), "boxes")
    junk = stored(layout.oversized(boxed), "oversized")
    boxed = stored(skew.deskew(boxed.join(junk, "rid", "left_anti")), "tokens")
    rows = stored(layout.parse_rows(layout.group_rows(boxed)), "rows")
    assembled = stored(layout.assemble(rows, layout.char_widths(boxed)), "assembled")
    return {"oversized": junk, "rows": rows, "assembled": assembled, "items": stored(layout.layout_items(assembled), "items"), "totals": layout.total_label(rows), "fees": layout.delivery_fee(rows), "discounts": layout.receipt_discount(assembled, rows)}


def read_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(receipts, items) of the model's reading; leaves of any type become names and whole won."""
    receipts, items, _ = read_answers(responses)
    return receipts.drop("delivery_fee"), items


def read_answers(responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(receipts, items, options) of the model's reading, receipts with its own ``delivery_fee``. JSON is parsed once. A
    ``total_amount`` that is no number is null, which is not the same as 0 (E16). Responses are (rid, raw), or parsed
    already.

    Leaves get their plain types before the table is written: Spark takes a VARIANT for 2 KB wherever it can't know, so
    what is picked from a table with some hundred of them looks so small that joins would send it whole to the driver."""
    parsed = responses if "vlm" in responses.columns else parsed_responses(responses)
    text = lambda c: F.try_variant_get(c, "$", "string")
    option = lambda s: F.struct(L.without_marks(text(s["name"])).alias("name"), M.as_won(s["price"], read_text=False).alias("price"))
    item = lambda i: F.struct(text(i["name"]).alias("name"), M.as_won(i["quantity"], read_text=False).cast("int").alias("quantity"), M.as_won(i["price"], read_text=False).alias("price"), F.transform(i["sub_items"], lambda s: F.when(s.isNotNull(), option(s))).alias("sub_items"))
    plain = parsed.select("rid", "ok", "error", F.col("vlm.store_name").alias("store_name"), F.col("vlm.payment_method").alias("payment_method"), F.col("vlm.purchased_at").alias("purchased_at"), M.number_or_none(F.col("vlm.total_amount")).alias("total_amount"), M.as_won(F.col("vlm.delivery_fee")).alias("delivery_fee"), F.when(F.col("ok"), F.transform("vlm.items", lambda i: F.when(i.isNotNull(), item(i)))).alias("items"))
    plain = stored(plain, "parsed")
    receipts = plain.drop("items").withColumns({c: L.without_placeholder(c) for c in ("store_name", "payment_method", "purchased_at")})
    one = plain.select("rid", F.posexplode("items").alias("at", "i")).filter("i is not null")
    number = (F.col("at") + 1).alias("item_no")
    items = one.select("rid", number, "i.name", "i.quantity", "i.price")
    subs = one.select("rid", number, F.posexplode("i.sub_items").alias("k", "s")).filter("s is not null")
    return receipts, items, subs.select("rid", "item_no", (F.col("k") + 1).alias("sub_no"), "s.name", "s.price")


def reconcile(items: DataFrame, computed: DataFrame, candidates: DataFrame, counts: DataFrame, unused: DataFrame, restorable: DataFrame | None = None, found: DataFrame | None = None, current: DataFrame | None = None, subs: DataFrame | None = None, summary_keys: DataFrame | None = None, header: DataFrame | None = None, fees: DataFrame | None = None) -> dict[str, DataFrame]:
    """Workload C: the chosen edits of each receipt, its items and options after them, what changes for the receipt as a
    whole, and audit rows. ``items`` and the other tables as for ``solve.edits``; ``computed`` and ``fees`` as for
    ``solve.solve``."""
    edits = stored(solve.edits(items, candidates, counts, unused, restorable, header, found, current, subs, summary_keys), "edits")
    solutions = stored(solve.solve(computed, candidates, edits, fees), "solutions")
    out = {"edits": edits, "solutions": solutions, "items": solve.apply_edits(items, edits, solutions, restorable), "changes": solve.receipt_changes(edits, solutions), "audit": solve.edit_audit(items, edits, solutions, subs, restorable)}
    return out | ({} if subs is None else {"options": solve.apply_to_options(subs, items, edits, solutions)})


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _sum_of_options(options: DataFrame) -> DataFrame:
    return options.groupBy("rid", "item_no").agg(F.sum(F.coalesce("price", _zero())).alias("options"))


def receipt_discounts(receipts: DataFrame, printed: DataFrame, told: DataFrame, items: DataFrame) -> DataFrame:
    """(rid, top): a receipt's own discount (E17): the larger of the printed sum (rid, summary_discount) and of what stood
    among its options (rid, amount), less what its items have; never below 0."""
    off = items.groupBy("rid").agg(F.sum("discount").alias("_items"))
    rows = receipts.join(printed.select("rid", "summary_discount"), "rid", "left").join(told.select("rid", F.col("amount").alias("_told")), "rid", "left").join(off, "rid", "left")
    most = F.greatest(F.coalesce("summary_discount", _zero()), F.coalesce("_told", _zero()))
    return rows.select("rid", F.greatest(_zero(), most - F.coalesce("_items", _zero())).alias("top"))


def _printed_tables(lines: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame, DataFrame, DataFrame]:
    """What the merge needs of print alone: the layout, its lines without their numbers, flags, amounts and evidence."""
    printed = read_layout(lines)
    numbered = I.has_line_numbers(printed["items"].withColumnRenamed("item_id", "item_no")).filter("numbered").select("rid", F.lit(True).alias("_numbered"))
    shown = printed["items"].withColumnRenamed("item_id", "p_no").join(numbered, "rid", "left").withColumn("name", F.when(F.col("_numbered"), L.without_line_number(F.col("name"))).otherwise(F.col("name"))).drop("_numbered")
    shown = shown.filter(~F.coalesce(L.summary_line(F.col("name")), F.lit(False))).withColumn("p_no", F.col("p_no").cast("int"))
    flags = evidence.flags(printed["rows"], lines).join(evidence.stray_fees(printed["rows"]), "rid", "left")
    short = stored(evidence.money_rows(printed["rows"]), "money")  # counts and evidence read it
    counts = evidence.amount_counts(short)
    found = lambda: stored(evidence.evidence(short), "evidence")
    return printed, *at_once(lines.sparkSession, lambda: stored(shown, "shown"), lambda: stored(flags, "flags"), lambda: stored(counts, "counts"), found)


def _answered_tables(lines: DataFrame, responses: DataFrame, today: str | None) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """(receipts, items, options, audits) of the answers, before they meet what is printed on their lines."""
    receipts, seen, options = read_answers(responses)
    receipts, dropped = D.drop_midnights(receipts, lines)
    audits = [dropped]
    if today is not None:
        receipts, dated = D.fix_dates(receipts, lines, today)
        receipts, dated = stored_together((receipts, "receipts"), (dated, "audit"))
        audits.append(dated)
    seen = I.pair_barcode_prices(seen.filter(~F.coalesce(L.summary_line(F.col("name")), F.lit(False)))).withColumn("discount", _zero())
    options = options.join(seen.select("rid", "item_no"), ["rid", "item_no"], "left_semi")
    return receipts, *stored_together((seen, "seen"), (options, "options")), audits


def merge(lines: DataFrame, responses: DataFrame, today: str | None = None, lexicon: DataFrame | None = None) -> dict[str, DataFrame]:
    """The merge of both readings (E19): receipts, their items and options, an audit table, edits and solutions.

    Steps are in the order in which each relies on the ones before: texts and dates, the model's list (fees, wrapped
    names, names, hierarchy against print, missed lines, unit prices, marks, discounts), then the balance of what is
    left with the amount paid. Tables are written to the shared folder between groups of steps. ``today``: dates are
    judged as of that day (none: they stay); ``lexicon``: names are repaired by these words and scores (none: not).
    Receipts with a negative total are refunds: from the balance on their items, options and discount go round every step
    and are left as they are (P10). An unread answer has no items.
    """
    spark = lines.sparkSession
    (printed, shown, flags, counts, found), (receipts, seen, options, audits) = at_once(spark, lambda: _printed_tables(lines), lambda: _answered_tables(lines, responses, today))
    audits.append(printed["oversized"].select(*I.correction("ocr_lines", F.col("n"), F.lit("(not laid out)"), "too_many_boxes")))
    claimed_fee = receipts.filter("ok").select("rid", "delivery_fee")
    seen, options, fee, a = O.take_fees(seen, options, printed["fees"], claimed_fee)
    seen, options, fee, a = stored_together((seen, "seen"), (options, "options"), (fee, "fee"), (a, "audit"))
    seen, options, b = O.merge_wrapped_names(seen, options)
    audits += [a, stored(b, "audit")]
    if lexicon is not None:
        sure = lines.filter("confidence >= 0.8")
        seen, options = stored_together((seen, "seen"), (options, "options"))
        names = seen.select("rid", "item_no", F.lit(0).alias("sub_no"), "name").unionByName(options.select("rid", "item_no", F.col("sub_no").cast("int").alias("sub_no"), "name"))
        fixed = stored(X.repair_names(names, sure, lexicon, key=("rid", "item_no", "sub_no")).filter("changed"), "names")
        audits.append(X.name_audit(fixed))
        of_items, of_options = fixed.filter("sub_no = 0").select("rid", "item_no", "corrected"), fixed.filter("sub_no > 0").select("rid", "item_no", "sub_no", "corrected")
        renamed = lambda rows, new, key: rows.join(new, key, "left").withColumn("name", F.coalesce("corrected", "name")).drop("corrected").select(*rows.columns)
        seen, options = renamed(seen, of_items, ["rid", "item_no"]), renamed(options, of_options, ["rid", "item_no", "sub_no"])

    # the printed hierarchy
    below = shown.select("rid", "p_no", F.posexplode("options").alias("k", "o")).select("rid", "p_no", (F.col("k") + 1).alias("sub_no"), "o.name", "o.price", "o.mark", "o.strong")
    seen, options, a = O.promote_options(*stored_together((seen, "seen"), (options, "options")), shown)
    seen, options, a = stored_together((seen, "seen"), (options, "options"), (a, "audit"))
    options, b = O.reassign_options(seen, options, shown, below)
    options, b = stored_together((options, "options"), (b, "audit"))
    seen, options, c = O.demote_items(seen, options, shown, below)
    seen, options, c = stored_together((seen, "seen"), (options, "options"), (c, "audit"))
    audits += [a, b, c]
    lines_of = shown.withColumnRenamed("p_no", "item_no")
    matches = stored(I.match_items(seen, lines_of), "matches")
    options, a = O.attach_options(seen, options, matches, shown, below)
    options, a = stored_together((options, "options"), (a, "audit"))
    audits.append(a)
    partner = I.partners(seen, shown, matches)
    mine = seen.drop("discount").join(partner, ["rid", "item_no"], "left")
    mine = mine.select("rid", "item_no", "name", "quantity", "price", F.coalesce("discount", _zero()).alias("discount"), F.coalesce("layout_price", _zero()).alias("layout_price"), F.lit(False).alias("from_ocr"), "pos")
    missing = I.unmatched(lines_of, matches)
    if lexicon is not None:  # lines that the model missed are repaired too, without an audit row of their own
        missing = stored(missing, "missing")
        better = X.repair_names(missing.select("rid", "item_no", "name"), sure, lexicon, key=("rid", "item_no")).filter("changed").select("rid", "item_no", "corrected")
        missing = missing.join(better, ["rid", "item_no"], "left").withColumn("name", F.coalesce("corrected", "name")).drop("corrected")
    missing = stored(missing, "missing")
    back = missing.filter("recovered")
    audits.append(back.select(*I.correction("items", F.lit("(missed by the model)"), F.col("name"), "ocr_recovered")))
    number = (F.lit(I.RECOVERED) + F.col("item_no")).cast("int").alias("item_no")
    new = back.select("rid", number, "name", "quantity", "price", "discount", F.col("price").alias("layout_price"), F.lit(True).alias("from_ocr"), F.col("item_no").cast("int").alias("pos"))
    answered = receipts.filter("ok").select("rid")
    full = stored(mine.unionByName(new.join(answered, "rid", "left_semi")), "full")
    more = back.select("rid", number, F.posexplode("options").alias("k", "o")).filter("o.price is not null").select("rid", "item_no", (F.col("k") + 1).alias("sub_no"), "o.name", "o.price")
    options = options.unionByName(more.join(answered, "rid", "left_semi"))

    # unit prices, marks, discounts among options
    line = F.col("price") * F.col("quantity")
    fits = F.coalesce(F.col("quantity").between(2, 50) & (F.col("price") > 0) & (F.col("layout_price") == line), F.lit(False))
    scaled = full.filter(fits).select("rid", "item_no", "quantity")
    options = O.scale_option_prices(options, scaled, below.join(partner.select("rid", F.col("price_line").alias("p_no"), "item_no"), ["rid", "p_no"]).select("rid", "item_no", "price"))
    fixed, a = I.scale_unit_prices(full.withColumn("price_is_line", fits))
    fixed, options, b = O.demote_marked(fixed, stored(options, "options"))
    fixed, options, a, b = stored_together((fixed, "fixed"), (options, "options"), (a, "audit"), (b, "audit"))
    audits += [a, b]
    counted = partner.select("rid", "item_no", F.explode("discounts").alias("amount")).groupBy("rid", "item_no", "amount").agg(F.count("*").alias("n"))
    fixed, options, told, a = O.fold_discounts(fixed, options, counted)
    fixed, options, told, a = stored_together((fixed, "fixed"), (options, "options"), (told, "told"), (a, "audit"))
    audits.append(a)
    top = receipt_discounts(answered, printed["discounts"], told, fixed)

    # the balance; refunds go round it
    top, refunds = stored_together((top, "top"), (receipts.filter("total_amount < 0").select("rid"), "refunds"))
    refunded, refunded_options, refunded_top = (t.join(refunds, "rid", "left_semi") for t in (fixed, options, top))
    fixed, options, top = (t.join(refunds, "rid", "left_anti") for t in (fixed, options, top))
    kept, a = I.drop_label_rows(fixed)
    options, b = I.drop_label_options(options.join(kept.select("rid", "item_no"), ["rid", "item_no"], "left_semi"))
    had = kept.filter("discount > 0").select("rid", F.col("discount").alias("amount")).union(top.filter("top > 0").select("rid", F.col("top").alias("amount")))
    kept, cuts, c = I.without_negatives(kept, options, had.groupBy("rid", "amount").agg(F.count("*").alias("n")))
    top = top.join(cuts, "rid", "left").select("rid", (F.col("top") + F.coalesce("amount", _zero())).alias("top"))
    kept, options, top, a, b, c = stored_together((kept, "kept"), (options, "options"), (top, "top"), (a, "audit"), (b, "audit"), (c, "audit"))
    kept, options, d = O.demote_printed(kept, options, printed["rows"], flags.filter("delivery").select("rid"))
    kept, options, d = stored_together((kept, "kept"), (options, "options"), (d, "audit"))
    audits += [a, b, c, d]
    with_sums = lambda rows: rows.join(_sum_of_options(options), ["rid", "item_no"], "left").withColumn("options", F.coalesce("options", _zero()))
    claims = receipts.filter("ok").select("rid", "total_amount").join(refunds, "rid", "left_anti")
    claims = stored(claims, "claims")
    candidates = stored(evidence.paid_candidates(found, counts, printed["totals"], claims).join(claims.select("rid"), "rid", "left_semi"), "candidates")
    totals = candidates.filter("tier < 2").select("rid", F.col("value").alias("amount"))
    whole, options = I.renumbered(I.drop_total_echoes(with_sums(kept), totals), options)
    whole, options = stored_together((whole, "whole"), (options, "options"))
    used = whole.filter("discount > 0").select("rid", F.col("discount").alias("amount")).union(top.filter("top > 0").select("rid", F.col("top").alias("amount")))
    worth = M.line_total(F.col("price"), F.col("options"), F.col("discount"))
    base = whole.groupBy("rid").agg(F.sum(worth).alias("_items")).join(top, "rid").join(fee, "rid", "left")
    base = base.select("rid", (F.col("_items") - F.col("top") + F.coalesce("delivery_fee", _zero())).alias("computed"), "top", F.coalesce("delivery_fee", _zero()).alias("delivery_fee"))
    restorable = I.restorable_in(missing, seen, matches).select("rid", F.col("item_no").cast("int").alias("ref"), "name", "quantity", "price", "discount", F.col("item_no").alias("pos"))
    unused, base, restorable = stored_together((evidence.unused_discounts(found, used), "unused"), (base, "computed"), (restorable, "restorable"))
    # prices of options are line amounts, no discounts
    no_cuts = options.select("rid", F.col("price").alias("amount"), F.lit("unlabelled").alias("kind")).union(below.select("rid", F.col("price").alias("amount"), F.lit("unlabelled").alias("kind"))).distinct()
    fees = base.filter("delivery_fee = 0").select("rid").join(flags, "rid").join(printed["fees"].select("rid"), "rid", "left_anti")
    fees = fees.select("rid", F.col("fee_unread").alias("unread"), F.when(F.col("delivery"), F.coalesce("stray", F.array().cast("array<bigint>"))).otherwise(F.array().cast("array<bigint>")).alias("stray"))
    done = reconcile(whole, base.select("rid", "computed", "top"), candidates, counts, unused, restorable, found.join(no_cuts, ["rid", "kind", "amount"], "left_anti"), top.select("rid", F.col("top").alias("amount")), options, evidence.summary_keys(printed["rows"]), flags.filter("unit_price_header").select("rid"), stored(fees, "fees"))
    audits.append(done["audit"])
    sums = refunded_options.groupBy("rid", "item_no").agg(F.sum(F.coalesce("price", _zero())).alias("options"))
    refunded = refunded.join(sums, ["rid", "item_no"], "left").withColumn("options", F.coalesce("options", _zero()))
    settled = done["items"].unionByName(refunded.select(*[F.col(f.name).cast(f.dataType) for f in done["items"].schema.fields]))
    settled, subs = stored_together((I.in_order(settled), "settled"), (done["options"].unionByName(refunded_options.select(*done["options"].columns)), "subs"))

    extras = top.unionByName(refunded_top).join(fee, "rid", "left")
    out = verdicts(receipts, settled, extras, done, counts, printed["totals"], lines)
    audits.append(out.filter("total_amount is distinct from _claim").select(*I.correction("total_amount", F.coalesce(F.col("_claim").cast("string"), F.lit("null")), F.col("total_amount"), "")[:4], F.when(F.col("total_amount").eqNullSafe(F.col("_label")), "ocr_layout").otherwise("reconciled").alias("reason")))
    audit = reduce(DataFrame.unionByName, audits)
    result = out.drop("_claim", "_label")
    return {"receipts": result, "items": settled, "options": subs, "corrections": audit, "edits": done["edits"], "solutions": done["solutions"]}


def verdicts(receipts: DataFrame, items: DataFrame, extras: DataFrame, done: dict[str, DataFrame], counts: DataFrame, totals: DataFrame, lines: DataFrame) -> DataFrame:
    """Receipts with total, discount, fee and what is verified (E16, P9). ``extras``: (rid, top, delivery_fee).

    A balanced total is verified if print says it: a label or a repeated amount, or its amount stands in more rows than
    items have it. A receipt that doesn't balance falls back on the total label: equal to the model's total, or to the
    sum of the items, or where the model says none; without a label the model's total must be printed, and no larger
    amount repeated. A total of 0 is one that the model says, like any other. Items are verified if the total is, each
    line is worth something, and the equation holds.
    """
    worth = M.line_total(F.col("price"), F.col("options"), F.col("discount"))
    sums = items.groupBy("rid").agg(F.count("*").alias("n_items"), F.sum(worth).alias("_sum"), F.bool_and(worth > 0).alias("_positive"))
    out = receipts.select("rid", "ok", "error", "store_name", "purchased_at", "payment_method", F.when(F.col("ok"), F.col("total_amount")).alias("_claim"))
    out = out.join(done["solutions"].select("rid", "paid", "tier", "edit_ids"), "rid", "left").join(done["changes"], "rid", "left").join(extras.select("rid", "top", F.col("delivery_fee").alias("_fee")), "rid", "left").join(sums, "rid", "left")
    out = out.join(totals.select("rid", F.col("total_amount").alias("_label")), "rid", "left")
    priced = items.join(done["solutions"].select("rid", "paid"), "rid").filter("price = paid").groupBy("rid").agg(F.count("*").alias("_same"))
    out = out.join(priced, "rid", "left").join(counts.select("rid", F.col("amount").alias("paid"), F.col("n").alias("_printed")), ["rid", "paid"], "left")
    larger = evidence.repeated(counts).groupBy("rid").agg(F.max("amount").alias("_repeated"))
    stands = lines.select("rid", F.explode(M.numbers_in(F.col("text"))).alias("_claim")).distinct().withColumn("_stands", F.lit(True))
    out = out.join(larger, "rid", "left").join(stands, ["rid", "_claim"], "left")
    zero, label, claim = _zero(), F.col("_label"), F.col("_claim")
    discount = F.greatest(zero, F.coalesce("top", zero) + F.coalesce("added_discount", zero) - F.coalesce("moved_discount", zero))
    fee = F.coalesce("_fee", zero) + F.coalesce("added_fee", zero)
    out = out.withColumns({"discount": discount, "delivery_fee": fee})
    equation = F.coalesce("_sum", zero) - F.col("discount") + F.col("delivery_fee")
    solved = F.col("paid").isNotNull()
    by_label = label.isNotNull() & (claim.isNull() | (label == claim) | (label == equation))
    by_print = label.isNull() & claim.isNotNull() & F.coalesce("_stands", F.lit(False)) & ~F.coalesce(F.col("_repeated") > claim, F.lit(False))
    total = F.when(solved, F.col("paid")).when(by_label & F.col("ok"), label).otherwise(claim)
    verified = F.when(solved, (F.col("tier") < 2) | (F.coalesce("_printed", zero) > F.coalesce("_same", zero))).otherwise(F.coalesce(by_label | by_print, F.lit(False)))
    verified = F.coalesce(verified & F.col("ok"), F.lit(False))
    out = out.withColumns({"total_amount": total, "total_verified": verified, "n_items": F.coalesce("n_items", zero).cast("int"), "n_edits": F.size(F.coalesce("edit_ids", F.array().cast("array<int>")))})
    sound = F.col("total_verified") & F.coalesce("_positive", F.lit(False)) & F.coalesce(equation == F.col("total_amount"), F.lit(False))
    return out.select("rid", "ok", "error", "store_name", "purchased_at", "payment_method", "total_amount", "discount", "delivery_fee", "n_items", "n_edits", "total_verified", sound.alias("items_verified"), "_claim", "_label")


def envelopes(merged: dict[str, DataFrame], pipeline: dict[str, str] | None = None) -> DataFrame:
    """(rid, month, envelope): one JSON a receipt (S4): ok, error, the nested result with its items and options in order,
    the audit rows, and the settings ``pipeline`` of the run. ``month`` is that of the purchase, null if unknown."""
    options = merged["options"].groupBy("rid", "item_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("sub_no", "name", "price"))), lambda o: F.struct(o["name"].alias("name"), o["price"].alias("price"))).alias("sub_items"))
    none = F.array().cast("array<struct<name:string,price:bigint>>")
    items = merged["items"].drop("options").join(options, ["rid", "item_no"], "left")
    one = F.struct("seq", "name", "quantity", "price", "discount", F.coalesce("sub_items", none).alias("sub_items"))
    lists = items.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(one)), lambda i: F.struct(*[i[c].alias(c) for c in ("name", "quantity", "price", "discount", "sub_items")])).alias("items"))
    audit = merged["corrections"].groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("field", "before", "after", "reason"))).alias("corrections"))
    out = merged["receipts"].join(lists, "rid", "left").join(audit, "rid", "left")
    result = F.when(F.col("ok"), F.struct("store_name", "purchased_at", "payment_method", "items", "total_amount", "discount", "delivery_fee", "total_verified", "items_verified"))
    settings = F.create_map(*[F.lit(x) for pair in sorted((pipeline or {}).items()) for x in pair]) if pipeline else F.lit(None).cast("map<string,string>")
    envelope = F.to_json(F.struct("ok", "error", result.alias("result"), F.coalesce("corrections", F.array().cast("array<struct<field:string,before:string,after:string,reason:string>>")).alias("corrections"), settings.alias("pipeline")), {"ignoreNullFields": "false"})
    return out.select("rid", F.regexp_extract(F.coalesce("purchased_at", F.lit("")), "^([0-9]{4}-[0-9]{2})", 1).alias("month"), envelope.alias("envelope")).withColumn("month", F.when(F.col("month") != "", F.col("month")))


def run_name(pipeline: dict[str, str] | None) -> str:
    """What a run of these settings is called: equal settings, equal names."""
    return ",".join(f"{k}={v}" for k, v in sorted((pipeline or {}).items())) or "plain"


def write_envelopes(merged: dict[str, DataFrame], path: str, pipeline: dict[str, str] | None = None) -> None:
    """Envelopes as JSON lines in a folder a run and month (S4). Runs are told apart by their settings; a run that is
    written again replaces its months that it has receipts of, and leaves other runs and months as they are."""
    out = envelopes(merged, pipeline).withColumn("run", F.lit(run_name(pipeline)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "month").json(path)


def read_runs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Receipts of the runs that ``write_envelopes`` wrote: by name, (rid, total_amount, items_verified, n_edits: audit
    rows of the balance). The names come to the driver: one for each setting that was tried."""
    stored_ = spark.read.schema("rid bigint, envelope string, run string, month string").json(path)
    parsed = stored_.withColumn("e", F.from_json("envelope", "result struct<total_amount: bigint, items_verified: boolean>, corrections array<struct<reason: string>>"))
    balanced = F.size(F.filter("e.corrections", lambda c: c["reason"] == "reconciled"))
    rows = parsed.select("run", "rid", "e.result.total_amount", "e.result.items_verified", balanced.alias("n_edits"))
    names = [r.run for r in stored_.select("run").distinct().orderBy("run").collect()]
    return {name: rows.filter(F.col("run") == name).drop("run") for name in names}


def compare_runs(runs: dict[str, DataFrame], truth: DataFrame | None = None) -> DataFrame:
    """(rid, and for each run <name>_total, <name>_verified, <name>_edits; agree): receipts of several settings side by
    side (E22); ``agree``: all totals are equal. With ``truth`` (rid, total_amount) also <name>_right."""
    every = reduce(DataFrame.unionByName, [df.select("rid", F.lit(name).alias("run"), "total_amount", "items_verified", "n_edits") for name, df in runs.items()])
    wide = every.groupBy("rid").pivot("run", list(runs)).agg(F.first("total_amount").alias("total"), F.first("items_verified").alias("verified"), F.first("n_edits").alias("edits"))
    totals = [F.col(f"{name}_total") for name in runs]
    agree = reduce(lambda a, b: a & b, [totals[0].eqNullSafe(t) for t in totals])
    out = wide.withColumn("agree", agree)
    if truth is None:
        return out
    out = out.join(truth.select("rid", F.col("total_amount").alias("_true")), "rid", "left")
    return out.withColumns({f"{name}_right": F.coalesce(F.col(f"{name}_total") == F.col("_true"), F.lit(False)) for name in runs}).drop("_true")
