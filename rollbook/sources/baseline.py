"""Versioned thresholds from a JSON file."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators.drift import SECTIONS, VERSION, thresholds


class BaselineError(ValueError):
    """The thresholds file is missing, malformed or of another version."""


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Threshold rows of a one-document JSON file; see :func:`rollbook.operators.drift.thresholds`."""
    try:
        documents = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        raise BaselineError(f"No thresholds can be read from {path}.") from error
    return parse_baseline(documents, path)


def parse_baseline(documents: DataFrame, name: str = "document") -> DataFrame:
    """Check the document (column ``value``) and flatten it.

    Every section must be there with all its numbers; an open or unreadable bound is refused.
    """
    found = documents.select(
        F.try_parse_json("value").isNotNull().alias("sound"),
        F.get_json_object("value", "$.version").alias("version"),
        F.json_object_keys("value").alias("sections"),
    ).take(2)
    if len(found) != 1 or not found[0].sound or found[0].sections is None:
        raise BaselineError(f"{name} is not one JSON object with thresholds.")
    for section in SECTIONS:
        if section not in found[0].sections:
            raise BaselineError(f"{name} has no section {section}.")
    if found[0].version != str(VERSION):
        raise BaselineError(f"{name} has version {found[0].version}; this is version {VERSION}.")
    rows = thresholds(documents)
    bounds = rows.select("metric", "upper", "expectation").collect()
    unset = [row.metric for row in bounds if row.upper is None or row.expectation is None]
    if unset or not bounds:
        raise BaselineError(f"{name} sets no bound for {', '.join(unset) or 'any metric'}.")
    return rows
