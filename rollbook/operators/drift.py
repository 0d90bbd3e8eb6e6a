"""Compare observed metrics with versioned thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The layout of a version 1 thresholds file.
VERSION = 1
BASELINE_SCHEMA = """
    version int,
    row_count struct<expected: bigint, relative_tolerance: double>,
    maximum_missing_rates map<string, double>,
    maximum_exact_duplicate_rows bigint,
    maximum_duplicate_vehicle_ids bigint,
    unknown_range_rate struct<expected: double, absolute_tolerance: double>,
    washington_share struct<expected: double, absolute_tolerance: double>
"""
SECTIONS = (
    "version",
    "row_count",
    "maximum_missing_rates",
    "maximum_exact_duplicate_rows",
    "maximum_duplicate_vehicle_ids",
    "unknown_range_rate",
    "washington_share",
)


def _threshold(
    metric: Column, kind: str, lower: Column, upper: Column, expectation: Column
) -> Column:
    return F.struct(
        metric.alias("metric"),
        F.lit(kind).alias("kind"),
        lower.cast("double").alias("lower"),
        upper.cast("double").alias("upper"),
        expectation.alias("expectation"),
    )


def _six(x: Column) -> Column:
    return F.format_string("%.6f", x)


def _at_most(metric: Column, limit: Column, shown: Column) -> Column:
    no_bound = F.lit(None).cast("double")
    return _threshold(metric, "maximum", no_bound, limit, F.concat(F.lit("at most "), shown))


def _band(metric: str, expected: Column, tolerance: Column) -> Column:
    lower, upper = expected - tolerance, expected + tolerance
    text = F.concat(F.lit("between "), _six(lower), F.lit(" and "), _six(upper))
    return _threshold(F.lit(metric), "absolute band", lower, upper, text)


def thresholds(documents: DataFrame) -> DataFrame:
    """Flatten a JSON document (column ``value``) to ``seq, metric, kind, lower, upper, expectation``.

    Bounds are inclusive and a null bound is open. The number of rows is the number of
    configured checks.
    """
    b = documents.select(F.from_json("value", BASELINE_SCHEMA).alias("b")).select("b.*")
    rows = F.col("row_count.expected")
    tolerance = F.col("row_count.relative_tolerance")
    low = F.bround(rows * (1 - tolerance), 0).cast("bigint")
    high = F.bround(rows * (1 + tolerance), 0).cast("bigint")
    row_text = F.concat(
        F.lit("between "), low.cast("string"), F.lit(" and "), high.cast("string")
    )
    counts = [
        _threshold(F.lit("row_count"), "relative band", low, high, row_text),
        *(
            _at_most(F.lit(metric), F.col(section), F.col(section).cast("string"))
            for metric, section in (
                ("exact_duplicate_rows", "maximum_exact_duplicate_rows"),
                ("duplicate_vehicle_ids", "maximum_duplicate_vehicle_ids"),
            )
        ),
    ]
    rates = F.transform(
        F.map_entries("maximum_missing_rates"),
        lambda e: _at_most(F.concat(F.lit("missing_rate."), e["key"]), e["value"], _six(e["value"])),
    )
    bands = [
        _band(name, F.col(f"{name}.expected"), F.col(f"{name}.absolute_tolerance"))
        for name in ("unknown_range_rate", "washington_share")
    ]
    checks = F.concat(F.array(*counts), rates, F.array(*bands))
    return b.select(F.posexplode(checks).alias("seq", "t")).select(F.col("seq") + 1, "t.*").toDF(
        "seq", "metric", "kind", "lower", "upper", "expectation"
    )


def observations(metrics: DataFrame, *counts: tuple[str, DataFrame]) -> DataFrame:
    """Long form ``metric, observed`` of a one-row metrics table and of one-value tables."""
    numeric = metrics.select(
        *(F.col(f"`{name}`").cast("double").alias(name) for name in metrics.columns)
    )
    result = numeric.unpivot([], [f"`{c}`" for c in metrics.columns], "metric", "observed")
    for name, df in counts:
        value = F.col(df.columns[0]).cast("double").alias("observed")
        result = result.unionByName(df.select(F.lit(name).alias("metric"), value))
    return result


def check(bounds: DataFrame, observed: DataFrame) -> DataFrame:
    """``seq, metric, observed, expectation, passed, status`` per threshold.

    A threshold without an observation is an error, not a pass.
    """
    absent = F.raise_error(F.concat(F.lit("No observation for "), F.col("metric")))
    joined = bounds.join(observed, "metric", "left").withColumn(
        "observed", F.when(F.col("observed").isNotNull(), F.col("observed")).otherwise(absent)
    )
    above = F.coalesce(F.col("observed") >= F.col("lower"), F.lit(True))
    below = F.coalesce(F.col("observed") <= F.col("upper"), F.lit(True))
    passed = joined.withColumn("passed", above & below)
    status = F.when(F.col("passed"), "Passed").otherwise("Review required")
    return passed.select(
        "seq", "metric", "observed", "expectation", "passed", status.alias("status")
    ).orderBy("seq")


def verdict(checks: DataFrame) -> DataFrame:
    """One row: checks, passes, whether all passed, and the exit status 0 or 2 of the gate.

    No check at all is not a pass.
    """
    within = F.coalesce(F.bool_and("passed"), F.lit(False))
    return checks.agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.count_if("passed").alias("n_passed"),
        within.alias("is_within_baseline"),
        F.when(within, 0).otherwise(2).alias("status"),
    )
