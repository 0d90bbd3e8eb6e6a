"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# White space that collapsing changes: two or more in a row, or any that is not a blank.
_UNTIDY = r"(?U)[\s\x1c-\x1f]{2,}|[\s\x1c-\x1f&&[^ ]]"

# Printable words with single blanks between them, as nearly all values are; telling them
# apart first is twice as fast as searching every value for something to replace.
_TIDY = r"\A[!-~]*+(?: [!-~]++)*+ ?\z"


def strip(c: Column) -> Column:
    """Remove surrounding white space of any kind (Spark's own trim only removes blanks).

    Plain text that begins and ends in a printable character needs no more than that trim, and
    the trim with a set of characters is several times slower.
    """
    text = F.trim(c)
    plain = F.length(text) == F.octet_length(text)
    printable = plain & (text >= "!") & (F.substring(text, -1, 1) >= "!")
    return F.when(printable, text).otherwise(F.trim(c, F.lit(WHITE_SPACE)))


def blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return c.isNull() | (strip(c) == "")


def present(c: Column) -> Column:
    """Stripped text, null where blank."""
    return F.nullif(strip(c), F.lit(""))


def tidy(c: Column) -> Column:
    """Strip, collapse inner white space to one blank, and make empty text null."""
    collapsed = F.when(c.rlike(_TIDY), c).otherwise(F.regexp_replace(c, _UNTIDY, " "))
    return F.nullif(F.trim(collapsed), F.lit(""))


def fold(c: Column) -> Column:
    """Case-insensitive form for ordering and search; upper first so that ß meets ss."""
    return F.lower(F.upper(c))


def title_case(c: Column) -> Column:
    """Capitalise every run of letters, also after hyphens and apostrophes."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def matches(c: Column, pattern: str) -> Column:
    """Match the whole value; unlike ``$`` this does not forgive a trailing newline."""
    return c.rlike(rf"\A(?:{pattern})\z")


def quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))
