"""Nested JSON reports with sorted keys, and their files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import fold
from rollbook.operators import drift


def as_array(df: DataFrame, keys: Sequence[Column]) -> Column:
    """A small report table as one array of structs, ordered by ``keys``, as a scalar subquery.

    Only for tables whose size is fixed by configuration: rules, columns, thresholds, top-n.
    """
    fields = F.struct(*(F.col(name) for name in sorted(df.columns)))
    keyed = F.struct(*(key.alias(f"k{i}") for i, key in enumerate(keys)), fields.alias("row"))
    rows = df.agg(F.sort_array(F.collect_list(keyed)).alias("rows"))
    return rows.select(F.transform("rows", lambda r: r["row"])).scalar()


def as_map(df: DataFrame, key: str) -> Column:
    """A small report table as a map from a name to a struct, as a scalar subquery."""
    fields = F.struct(*(F.col(name) for name in sorted(df.columns) if name != key))
    entry = F.struct(F.col(key).alias("key"), fields.alias("value"))
    return df.agg(F.map_from_entries(F.sort_array(F.collect_list(entry)))).scalar()


def to_report(headline: DataFrame, parts: Mapping[str, Column]) -> DataFrame:
    """One JSON document from a one-row headline and nested parts; nulls are written."""
    columns = {name: F.col(f"`{name}`") for name in headline.columns} | dict(parts)
    document = F.struct(*(columns[name].alias(name) for name in sorted(columns)))
    return headline.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("value"))


def quality_report(
    metrics: DataFrame,
    profile: DataFrame,
    checks: DataFrame,
    warning_lines: DataFrame,
    version: int = drift.VERSION,
) -> DataFrame:
    """The quality report as one JSON document."""
    columns = profile.select("column", "missing_count", "missing_rate", "unique_count")
    shown = F.struct("expectation", "metric", "observed", "passed")
    listed = checks.agg(F.sort_array(F.collect_list(F.struct("seq", shown.alias("row")))).alias("rows"))
    within = drift.verdict(checks).select("is_within_baseline").scalar()
    lines = warning_lines.agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("rows"))
    return to_report(
        metrics,
        {
            "columns": as_map(columns, "column"),
            "baseline_checks": listed.select(F.transform("rows", lambda r: r["row"])).scalar(),
            "baseline_version": F.lit(version),
            "is_within_baseline": within,
            "validation_warnings": lines.select(
                F.transform("rows", lambda r: r["line"])
            ).scalar(),
        },
    )


def exploratory_report(
    headline: DataFrame, breakdowns: Mapping[str, DataFrame], range_by_type: DataFrame
) -> DataFrame:
    """The exploratory report as one JSON document; series keep their order."""
    parts = {}
    for name, df in breakdowns.items():
        number, value = F.col("value").try_cast("double"), F.col("value")
        keys = [number, value] if name == "model_year" else [-F.col("count"), fold(value), value]
        parts[name] = as_array(df, keys)
    parts["range_by_vehicle_type"] = as_array(range_by_type, [F.col(range_by_type.columns[0])])
    return to_report(headline, parts)


def write_report(document: DataFrame, path: str) -> None:
    """Write a one-row document; Spark makes the parent folders."""
    document.write.mode("overwrite").text(path)
