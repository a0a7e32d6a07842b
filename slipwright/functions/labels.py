"""What a printed name is: label, discount, delivery fee, option, summary line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipwright import patterns as P


def hangul(text: Column) -> Column:
    """Hangul syllables alone."""
    return F.regexp_replace(text, "[^가-힣]+", "")


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def label_level(name: Column) -> Column:
    """2: surely a label of the summary or payment part, 1: maybe, 0: a product (F8)."""
    raw = F.trim(F.coalesce(name, F.lit("")))
    key = hangul(raw)
    colon = (raw.contains(":") | raw.contains("：")) & raw.rlike(P.LABEL_COLON)  # few names have a colon: no search without
    sure = colon | (raw.contains("VAT") & raw.rlike(P.VAT_WORD)) | key.rlike(P.LABEL_DEFINITE) | key.rlike(P.LABEL_WHOLE)
    return F.when(sure, 2).when(key.rlike(P.LABEL_PROBABLE), 1).otherwise(0)


def discount_kind(name: Column, price: Column) -> Column:
    """"item", "total", or null where it is no discount."""
    key = compact(name)
    is_one = name.isNotNull() & (F.coalesce(price, F.lit(0)) != 0) & key.rlike(P.DISCOUNT_WORD) & ~key.rlike(P.DISCOUNT_DECOY)
    return F.when(is_one, F.when(key.rlike(P.DISCOUNT_TOTAL), "total").otherwise("item"))


def fee_label(name: Column) -> Column:
    """"parent", "child" or "off" of a delivery-fee line, else null."""
    key = compact(name)
    core = F.regexp_replace(key, "^[^가-힣]+", "")
    starts = core.rlike("^" + P.FEE_WORD)
    tail = F.regexp_replace(core, "^" + P.FEE_WORD, "")
    rest = F.regexp_replace(F.regexp_replace(tail, r"\([^)]*\)", ""), r"[0-9][0-9,.]*원?", "")
    only_qualifiers = ~F.regexp_replace(rest, P.FEE_QUALIFIER, "").rlike(P.HANGUL)
    is_fee = key.rlike(P.FEE_END) | (starts & only_qualifiers)
    return F.when(is_fee, F.when(key.rlike(P.FEE_OFF), "off").when(starts & ~tail.rlike(P.FEE_BREAKDOWN), "parent").otherwise("child"))


def non_item(name: Column) -> Column:
    """Not the name of an item."""
    return (label_level(name) > 0) | hangul(F.coalesce(name, F.lit(""))).rlike(P.NON_ITEM_WORD)


def summary_line(name: Column) -> Column:
    return F.trim(F.coalesce(name, F.lit(""))).rlike(P.SUMMARY_LINE)


def marked(name: Column) -> Column:
    """The name begins with an option mark."""
    return name.rlike(P.SUB_PREFIX)


def strongly_marked(name: Column) -> Column:
    return name.rlike(P.STRONG_SUB_MARK)


def without_marks(name: Column) -> Column:
    return F.regexp_replace(name, P.SUB_MARKS, "")


def without_line_number(name: Column) -> Column:
    """The name without a printed line number, never empty."""
    stripped = F.regexp_replace(F.trim(name), P.LINE_NUMBER, "")
    return F.when(stripped == "", name).otherwise(stripped)


def unread_fee(text: Column, tokens: Column) -> Column:
    """A delivery-fee row whose amount is blank or damaged."""
    from .money import fuzzy_amounts

    key = hangul(text)
    is_fee = key.rlike(P.EVIDENCE_FEE) | (key.contains("배달") & (F.char_length(key) <= 5))
    blank = F.exists(tokens, lambda t: (hangul(t["text"]) == "") & (t["text"].rlike(P.PLACEHOLDER) | t["text"].rlike(P.BROKEN_AMOUNT)))
    return ~key.rlike(P.FEE_NOT_FEE) & is_fee & (F.size(fuzzy_amounts(text)) == 0) & blank


def without_placeholder(column: str) -> Column:
    """The prompt's own example text is no value."""
    return F.when(~F.col(column).isin(P.PLACEHOLDERS[column]), F.col(column))


def without_invented_midnight(value: Column, printed: Column) -> Column:
    """The date alone where a midnight was never printed."""
    return F.when(value.rlike(P.MIDNIGHT) & ~F.coalesce(printed, F.lit(False)), F.regexp_extract(value, P.MIDNIGHT, 1)).otherwise(value)


def prints_midnight(text: Column) -> Column:
    return text.rlike(P.PRINTED_MIDNIGHT)
