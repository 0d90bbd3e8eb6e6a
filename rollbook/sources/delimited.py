"""Delimited text under an exact header contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.contract import Contract
from rollbook.sources.files import Paths, SourceError, header_issues
from rollbook.staging import stage


def raw_schema(contract: Contract) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in contract.columns])


def check_headers(spark: SparkSession, path: Paths, contract: Contract) -> None:
    """Refuse the source if any file's header differs.

    The message counts the files and tells the first one; the error's ``issues`` has all rows
    of :func:`header_issues`, computed once, as a table.
    """
    issues = stage(header_issues(spark, path, contract)).frame
    bad = issues.agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("*"), "path").alias("row"))
    n, row = bad.first()
    if n:
        raise SourceError(
            f"Source columns do not match the contract in {n:,} cases, first {row.path}: "
            f"{row.problem}; duplicates: {row.duplicates or 'none'}; "
            f"missing: {row.missing or 'none'}; unexpected: {row.unexpected or 'none'}",
            issues,
        )


def read_raw(
    spark: SparkSession,
    path: Paths,
    contract: Contract,
    multi_line: bool = False,
    check: bool = True,
) -> DataFrame:
    """All columns as text in contract order; empty is null and ``NA`` is data.

    Rows with too few or too many fields fail the read. ``multi_line`` allows line breaks
    inside quotes at the price that a file is no longer split among tasks.
    """
    if check:
        check_headers(spark, path, contract)
    return (
        spark.read.schema(raw_schema(contract))
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", True)
        .option("mode", "FAILFAST")
        .csv(path)
    )
