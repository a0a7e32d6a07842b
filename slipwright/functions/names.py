"""Hangul names: letter sequences, distances and matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipwright import patterns as P

from .labels import hangul


def letters(text: Column) -> Column:
    """Each syllable as first consonant, vowel and last consonant (a sign of its own where there is none) (F16)."""

    def spell(c: Column) -> Column:
        code = F.ascii(c) - 0xAC00
        part = lambda table, k: F.substring(F.lit(table), (k + 1).cast("int"), F.lit(1))
        syllable = F.concat(part(P.ONSETS, F.floor(code / 588)), part(P.VOWELS, F.floor((code % 588) / 28)), part(P.CODAS, code % 28))
        return F.when(code.between(0, 11171), syllable).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), spell), "")


def letter_distance(a: Column, b: Column) -> Column:
    """Edit distance of the letter sequences."""
    return F.levenshtein(letters(a), letters(b))


def names_match(a: Column, b: Column) -> Column:
    """One Hangul key holds the other, or few letters differ; the limit follows the first name."""
    x, y = hangul(F.coalesce(a, F.lit(""))), hangul(F.coalesce(b, F.lit("")))
    limit = F.greatest(F.lit(2), F.floor(F.char_length(letters(x)) / 3).cast("int"))
    return F.when((x == "") | (y == ""), False).otherwise(x.contains(y) | y.contains(x) | (letter_distance(x, y) <= limit))


def same_hangul(a: Column, b: Column) -> Column:
    x, y = hangul(F.coalesce(a, F.lit(""))), hangul(F.coalesce(b, F.lit("")))
    return (x != "") & (x == y)


def similar(a: Column, b: Column) -> Column:
    """Stricter than ``names_match``: equal, held in the other from three syllables on, or an eighth of letters off."""
    x, y = hangul(F.coalesce(a, F.lit(""))), hangul(F.coalesce(b, F.lit("")))
    least = F.least(F.char_length(x), F.char_length(y))
    limit = F.greatest(F.lit(1), F.floor(F.greatest(F.char_length(letters(x)), F.char_length(letters(y))) / 8).cast("int"))
    return (x != "") & ((x == y) | ((least >= 3) & (x.contains(y) | y.contains(x))) | ((least >= 4) & (letter_distance(x, y) <= limit)))
