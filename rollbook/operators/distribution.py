"""Coverage-aware distributions of a measure per group.

All functions read one row per group and value with its count, so the source is scanned once
and what is left is as small as the number of different values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.numbers import bin_lower, rate
from rollbook.operators.guards import need_columns, need_positive
from rollbook.operators.ordering import quantiles
from rollbook.staging import Staged

QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def measure_counts(df: DataFrame, groups: list[str], measure: str) -> DataFrame:
    """``*groups, value, count``; null groups and null values are kept."""
    need_columns(df, [*groups, measure])
    return df.groupBy(*groups, F.col(measure).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def coverage(counts: DataFrame, group: str) -> DataFrame:
    """Size, known and unknown values and known share per non-null group."""
    known = F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("count"))), F.lit(0))
    sizes = counts.filter(F.col(group).isNotNull()).groupBy(group)
    return sizes.agg(F.sum("count").alias("total_count"), known.alias("known_count")).select(
        group,
        "total_count",
        "known_count",
        (F.col("total_count") - F.col("known_count")).alias("unknown_count"),
        rate(F.col("known_count"), F.col("total_count")).alias("known_share"),
    )


def distribution(staged: Staged, group: str) -> DataFrame:
    """Per non-null group: size, known values, share and unrounded statistics of the known.

    A group without known values has share 0 and null statistics.
    """
    counts = staged.frame.filter(F.col(group).isNotNull())
    known = F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("count"))), F.lit(0))
    sizes = counts.groupBy(group).agg(
        F.sum("count").alias("total_count"),
        known.alias("known_count"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        F.sum(F.col("value") * F.col("count")).cast("double").alias("_sum"),
    )
    middle = quantiles(Staged(counts, staged.rows), [group], "value", "count", QUARTILES)
    return sizes.join(middle, group, "left").select(
        group,
        "total_count",
        "known_count",
        rate(F.col("known_count"), F.col("total_count")).alias("known_share"),
        "minimum",
        "p25",
        "median",
        F.try_divide("_sum", "known_count").alias("mean"),
        "p75",
        "maximum",
    )


def rounded(stats: DataFrame, digits: int = 2) -> DataFrame:
    """Quartiles and mean as shown on the page."""
    return stats.withColumns(
        {c: F.bround(c, digits) for c in ("p25", "median", "mean", "p75")}
    )


def with_known_values(stats: DataFrame) -> DataFrame:
    """Groups that have a median at all."""
    return stats.filter(F.col("median").isNotNull())


def coverage_series(covered: DataFrame, group: str) -> DataFrame:
    """Long form, two series per group."""
    named = covered.select(
        group,
        F.col("known_count").alias("Known range"),
        F.col("unknown_count").alias("Unknown range"),
    )
    return named.unpivot([group], ["`Known range`", "`Unknown range`"], "series", "count")


def histogram(counts: DataFrame, group: str, width: int = 10) -> DataFrame:
    """Non-empty fixed-width bins per group: ``group, lower, upper, label, count``."""
    need_positive(width, "width")
    known = counts.dropna(subset=[group, "value"])
    bins = known.groupBy(group, bin_lower(F.col("value"), width).alias("lower")).agg(
        F.sum("count").alias("count")
    )
    upper = F.col("lower") + F.lit(width - 1)
    label = F.concat(F.col("lower").cast("string"), F.lit("-"), upper.cast("string"))
    return bins.select(
        group, "lower", upper.cast("bigint").alias("upper"), label.alias("label"), "count"
    ).orderBy(group, "lower")
