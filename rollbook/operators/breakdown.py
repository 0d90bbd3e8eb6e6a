"""Counts and shares per category."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.numbers import rate
from rollbook.functions.text import fold
from rollbook.operators.guards import need_columns, need_positive


def by_count(value: str = "value", count: str = "count") -> list[Column]:
    """Largest first, ties by case-insensitive value, then by value."""
    return [F.desc(count), fold(F.col(value)).asc(), F.asc(value)]


def by_value(value: str = "value") -> list[Column]:
    """Numeric labels first in numeric order, then the others case-insensitively."""
    as_number = F.col(value).try_cast("double")
    return [as_number.isNull().asc(), as_number.asc(), fold(F.col(value)).asc(), F.asc(value)]


def category_breakdown(
    df: DataFrame, column: str, limit: int | None = None, sort_by_value: bool = False
) -> DataFrame:
    """``value, count, share`` per non-null value; shares are of all rows, nulls included.

    The total is a scalar subquery over the same counts, so the table is read once: the null
    group is told by its count of values, because a filter on the value itself would be pushed
    below one of the two aggregates, and both readers use both counts, so that their plans are
    equal and the shuffle is reused.
    """
    need_columns(df, [column])
    need_positive(limit, "limit")
    counts = df.groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(column).alias("n_values")
    )
    total = counts.agg(F.sum(F.greatest("n_rows", "n_values"))).scalar()
    known = counts.filter(F.col("n_values") > 0)
    return _breakdown(known.withColumnRenamed("n_rows", "count"), total, limit, sort_by_value)


def _breakdown(
    counts: DataFrame, total: Column, limit: int | None, sort_by_value: bool
) -> DataFrame:
    rows = counts.select(
        F.col("value").cast("string").alias("value"),
        "count",
        rate(F.col("count"), total).alias("share"),
    )
    rows = rows.orderBy(*(by_value() if sort_by_value else by_count()))
    return rows if limit is None else rows.limit(limit)


def value_counts(df: DataFrame, columns: Sequence[str] | Mapping[str, Column]) -> DataFrame:
    """Counts of many columns in one scan and one shuffle: ``series, value, count``.

    Values are text, null is a value. The shuffle is keyed by series and value, so a column
    with one dominant value is summed before it moves.
    """
    if not isinstance(columns, Mapping):
        columns = {name: F.col(f"`{name}`") for name in columns}
    wide = df.select(*(c.cast("string").alias(name) for name, c in columns.items()))
    long = wide.unpivot([], [f"`{name}`" for name in columns], "series", "value")
    return long.groupBy("series", "value").agg(F.count(F.lit(1)).alias("count"))


def summed_breakdown(
    counts: DataFrame, column: str, limit: int | None = None, sort_by_value: bool = False
) -> DataFrame:
    """The breakdown of ``column`` out of a staged table of counts that covers all rows."""
    need_positive(limit, "limit")
    known = counts.filter(F.col(column).isNotNull())
    sums = known.groupBy(F.col(column).alias("value")).agg(F.sum("count").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return _breakdown(sums, total, limit, sort_by_value)


def concentration(breakdown: DataFrame, top: int) -> DataFrame:
    """``share`` of the ``top`` largest categories: the rounded shares are summed, as shown."""
    need_positive(top, "top")
    largest = breakdown.orderBy(*by_count()).limit(top)
    return largest.agg(F.coalesce(F.bround(F.sum("share"), 6), F.lit(0.0)).alias("share"))


def leading(breakdown: DataFrame) -> DataFrame:
    """The largest category; among equals the first in natural order."""
    return breakdown.orderBy(F.desc("count"), *by_value()).limit(1)


def distinct_keys(df: DataFrame, key: str) -> int:
    """Number of distinct non-null keys: partial distinct per task, one shuffle of the keys."""
    return df.agg(F.count_distinct(key)).first()[0]
