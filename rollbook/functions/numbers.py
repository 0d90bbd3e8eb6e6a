"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.text import matches, strip

# The spellings accepted as a number. Spark's cast alone would also take
# "12d" and "NaN".
NUMBER = r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity))"


def number(text: Column) -> Column:
    """Parse stripped text as a double; null where it is not a number."""
    return F.when(matches(text, NUMBER), text).try_cast("double")


def integer(c: Column) -> Column:
    """Parse text as a bigint, dropping any fraction; null where it is not a number.

    Plain digits are cast directly, because a double loses digits above 2^53.
    """
    text = strip(c)
    text = F.when(matches(text, NUMBER), text)
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def number_key(c: Column) -> list[Column]:
    """Two columns that are equal exactly where the parsed numbers are equal.

    The first holds whole numbers of up to 64 bits, so that "1", "01" and "1.0" meet in eight
    bytes; the second spells out any other number. Both are null for text that is no number.
    """
    text = strip(c)
    text = F.when(matches(text, NUMBER), text)
    exact = text.try_cast("decimal(38,10)")
    whole = F.coalesce(
        text.try_cast("bigint"), F.when(exact == F.floor(exact), exact).try_cast("bigint")
    )
    other = F.coalesce(exact.cast("string"), text.try_cast("double").cast("string"))
    return [whole, F.when(whole.isNull(), other)]


def is_whole(x: Column) -> Column:
    return x % F.lit(1.0) == 0


def rate(part: Column, whole: Column, digits: int = 6) -> Column:
    """Rounded proportion, 0.0 over an empty whole."""
    return F.coalesce(F.bround(F.try_divide(part, whole), digits), F.lit(0.0))


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    """Rounded proportion, null over an empty whole."""
    return F.bround(F.try_divide(part, whole), digits)


def bin_lower(x: Column, width: int) -> Column:
    """Lower end of the fixed-width bin that holds ``x``."""
    return (F.floor(x / F.lit(width)) * F.lit(width)).cast("bigint")


def marker_size(count: Column, largest: Column) -> Column:
    """Size whose area grows with the count, from 7 to 38."""
    return F.lit(7) + F.lit(31) * F.sqrt(count / largest)
