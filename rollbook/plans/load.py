"""From source files to a clean table that passed the gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from rollbook.contract import Contract
from rollbook.operators.clean import clean
from rollbook.operators.filters import FilterColumns, Selection, apply_filters
from rollbook.operators.validate import Report, gate
from rollbook.plans.snapshots import load_version
from rollbook.sources.delimited import read_raw


def load_validated(
    spark: SparkSession,
    path: str,
    contract: Contract,
    multi_line: bool = False,
    keep_raw: str | None = None,
) -> tuple[DataFrame, Report]:
    """Read, validate and return the raw rows; errors raise, warnings are in the report.

    Validation and cleaning each parse the text again. With ``keep_raw`` the rows are written
    once as Parquet to that folder and read from there, so the text is parsed once and later
    passes read only their columns.
    """
    raw = read_raw(spark, path, contract, multi_line)
    if keep_raw is not None:
        stored = raw.toDF(*contract.renames.values())
        stored.write.mode("overwrite").parquet(keep_raw)
        raw = spark.read.schema(stored.schema).parquet(keep_raw).toDF(*contract.columns)
    return raw, gate(raw, contract)


def load_clean(
    spark: SparkSession,
    path: str,
    contract: Contract,
    multi_line: bool = False,
    keep_raw: str | None = None,
) -> tuple[DataFrame, Report]:
    """Load, validate once and clean; the clean table is a lazy projection of the raw rows."""
    raw, report = load_validated(spark, path, contract, multi_line, keep_raw)
    return clean(raw, contract, validate=False), report


@dataclass(frozen=True)
class Snapshot:
    """The full table, its report, and the files it came from with digests and provenance."""

    full: DataFrame
    report: Report
    files: DataFrame


def load_snapshot(
    spark: SparkSession, path: str, contract: Contract, store: str, multi_line: bool = False
) -> Snapshot:
    """The clean table of a source, kept in ``store``, from which every page reads its columns.

    The text of new and changed files is parsed once, in the pass that writes and checks their
    rows; a second load of the same files opens none (:mod:`rollbook.plans.snapshots`).
    """
    version = load_version(spark, path, contract, store, multi_line)
    files = version.files.drop("key", "load", "counts", "contract")
    return Snapshot(version.full, version.report, files)


@dataclass(frozen=True)
class PageContext:
    """Quality reads ``full``; every other page reads ``filtered``."""

    full: DataFrame
    filtered: DataFrame
    selection: Selection


def page_context(full: DataFrame, columns: FilterColumns, selection: Selection) -> PageContext:
    return PageContext(full, apply_filters(full, columns, selection), selection)
