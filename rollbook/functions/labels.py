"""Display text for headline values; null shows as a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def thousands(n: Column) -> Column:
    return F.coalesce(F.format_number(n, 0), F.lit(DASH))


def percent(x: Column) -> Column:
    return F.coalesce(F.concat(F.format_number(x * 100, 1), F.lit("%")), F.lit(DASH))


def miles(x: Column) -> Column:
    return F.coalesce(F.concat(F.format_number(x, 0), F.lit(" mi")), F.lit(DASH))


def year(x: Column) -> Column:
    """Whole years without a decimal, half years with one."""
    whole = F.when(x == F.floor(x), x.cast("bigint").cast("string"))
    return F.coalesce(whole, F.format_string("%.1f", x.cast("double")))
