"""Money columns: exact and damaged literals, coercions, totals, tax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipwright import patterns as P


def money_value(text: Column) -> Column:
    """Whole won of an exactly printed amount, else null (F1)."""
    digits = F.regexp_replace(text, "[,₩원]", "")
    return F.when(text.rlike(P.MONEY) & ~text.rlike(P.BARCODE), digits.cast("bigint"))


def fuzzy_amounts(text: Column) -> Column:
    """Amounts that a damaged text may mean: a broken separator, or a last zero lost; zero dropped (F2)."""

    def found(pattern: str, zeros: int) -> Column:
        one = lambda m: F.translate(m, "-W₩,.;:'`", "").cast("bigint") * 10**zeros
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(m.startswith("-"), -one(m)).otherwise(one(m)))

    return F.filter(F.concat(found(P.FUZZY_FULL, 0), found(P.FUZZY_SHORT, 1)), lambda v: v != 0)


def row_amounts(tokens: Column) -> Column:
    """Exact amounts of a row's tokens, in order."""
    return F.array_compact(tokens["amount"])


def formatted_amounts(tokens: Column) -> Column:
    """Only amounts printed with a comma or a currency sign."""
    return F.filter(tokens, lambda t: t["amount"].isNotNull() & t["text"].rlike("[,₩원]"))["amount"]


def numbers_in(text: Column) -> Column:
    """All grouped or plain digit runs as numbers."""
    return F.transform(F.regexp_extract_all(text, F.lit(P.NUMBER), F.lit(0)), lambda n: F.regexp_replace(n, ",", "").try_cast("bigint"))


def as_won(value: Column, read_text: bool = True) -> Column:
    """Whole won of a VARIANT leaf: fractions are cut, booleans, non-finite numbers and unreadable texts are 0.

    Without ``read_text`` texts are 0 too, as reconciliation wants it.
    """
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    finite = F.abs(number) < 9.2e18  # NaN isn't
    text = money_value(F.trim(F.try_variant_get(value, "$", "string")))
    other = F.when(kind == "STRING", text).when(kind.isin("BOOLEAN", "VOID"), 0) if read_text else F.when(kind.isin("STRING", "BOOLEAN", "VOID"), 0)
    return other.when(finite, number.cast("bigint")).otherwise(0).cast("bigint").alias("won")


def number_or_none(value: Column) -> Column:
    """Whole won of a VARIANT leaf that is a finite number, 0 included; anything else is null."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    stated = kind.isNotNull() & ~kind.isin("STRING", "BOOLEAN", "VOID") & ~F.isnan(number) & (F.abs(number) < 9.2e18)
    return F.when(stated, number.cast("bigint"))


def tax_split(total: Column) -> Column:
    """Tax and net amounts that shops print for a total, by floor, ceiling and half-even rounding."""
    low = F.floor(total / 11).cast("bigint")
    high = F.ceil(total / 11).cast("bigint")
    near = F.bround(total / F.lit(11.0)).cast("bigint")
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.array(v, total - v) for v in (low, high, near)]))))


def line_total(price: Column, options: Column, discount: Column) -> Column:
    """Price and options less discount, nulls as 0."""
    zero = F.lit(0).cast("bigint")
    return F.coalesce(price, zero) + F.coalesce(options, zero) - F.coalesce(discount, zero)
