"""The quality page and report; always of the full table, whatever the filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from rollbook.contract import Contract
from rollbook.operators import drift, profile
from rollbook.operators.guards import EmptyInput, need_columns
from rollbook.operators.profile import QualityColumns
from rollbook.operators.validate import Report, line_of
from rollbook.plans.load import Snapshot
from rollbook.plans.pages import Exploratory, exploratory
from rollbook.sources.reports import exploratory_report, quality_report, write_report
from rollbook.staging import stage, together

REGISTRATION_QUALITY = QualityColumns(
    key="dol_vehicle_id",
    measure="electric_range_miles",
    longitude="longitude",
    latitude="latitude",
    home_flag="is_washington",
)


@dataclass(frozen=True)
class Quality:
    metrics: DataFrame
    profile: DataFrame
    missingness: DataFrame
    checks: DataFrame
    verdict: DataFrame


def quality(
    full: DataFrame, thresholds: DataFrame, columns: QualityColumns = REGISTRATION_QUALITY
) -> Quality:
    """Metrics, column profile and drift checks; failed checks never hide the metrics.

    Four passes at the same time, each over the columns it needs: the profile, the wide counts,
    the row digests and the keys. Each leaves one row, or one row per column, which is staged.
    """
    need_columns(full, columns.names)
    columns_found, counted, rows, keys = together(
        lambda: stage(profile.column_profile(full)),
        lambda: profile.table_metrics(full, columns).first(),
        lambda: profile.duplicate_rows(full).first()[0],
        lambda: profile.duplicate_keys(full, [columns.key]).first()[0],
    )
    if columns_found.rows == 0:
        raise EmptyInput("Quality reporting requires at least one data row.")
    values = counted.asDict() | {"exact_duplicate_rows": rows, "duplicate_vehicle_ids": keys}
    metrics = full.sparkSession.range(1).select(
        *(F.lit(value).alias(name) for name, value in values.items())
    )
    rates = columns_found.frame.select(
        F.concat(F.lit("missing_rate."), "column").alias("metric"),
        F.col("missing_rate").alias("observed"),
    )
    checks = drift.check(thresholds, drift.observations(metrics).unionByName(rates))
    return Quality(
        metrics,
        columns_found.frame,
        profile.missingness(columns_found.frame),
        checks,
        drift.verdict(checks),
    )


def warning_lines(full: DataFrame, report: Report) -> DataFrame:
    """The report's warnings as rows ``seq, line``."""
    lines = [line_of(row) for row in report.warnings]
    entries = F.array(
        *(F.struct(F.lit(i).alias("seq"), F.lit(x).alias("line")) for i, x in enumerate(lines))
    ).cast("array<struct<seq: int, line: string>>")
    return full.sparkSession.range(1).select(F.inline(entries))


@dataclass(frozen=True)
class QualityPage:
    headline: DataFrame
    files: DataFrame
    warnings: DataFrame
    quality: Quality
    dictionary: DataFrame


def quality_page(
    snapshot: Snapshot,
    contract: Contract,
    thresholds: DataFrame,
    columns: QualityColumns = REGISTRATION_QUALITY,
) -> QualityPage:
    """Source files, quality, warnings and dictionary of a loaded snapshot.

    It takes the snapshot and not a page context, so that no filter can reach it.
    """
    found = quality(snapshot.full, thresholds, columns)
    warnings = warning_lines(snapshot.full, snapshot.report)
    headline = found.verdict.select(
        found.metrics.select("row_count").scalar().alias("row_count"),
        found.metrics.select("column_count").scalar().alias("column_count"),
        F.lit(len(snapshot.report.warnings)).alias("warning_count"),
        F.col("n_passed").alias("baseline_passed_count"),
        F.col("n_checks").alias("baseline_check_count"),
        F.col("is_within_baseline").alias("baseline_passed"),
    )
    dictionary = profile.dictionary_conformance(snapshot.full, contract, found.profile)
    return QualityPage(headline, snapshot.files, warnings, found, dictionary)


def write_exploratory(full: DataFrame, path: str) -> Exploratory:
    """Write the exploratory report and return its tables."""
    found = exploratory(full)
    write_report(
        exploratory_report(found.headline, found.breakdowns, found.range_by_type), path
    )
    return found


def write_quality(full: DataFrame, report: Report, thresholds: DataFrame, path: str) -> Row:
    """Write the report, then return the verdict row; its status 2 means drift."""
    found = quality(full, thresholds)
    document = quality_report(
        found.metrics, found.profile, found.checks, warning_lines(full, report)
    )
    write_report(document, path)
    return found.verdict.first()
