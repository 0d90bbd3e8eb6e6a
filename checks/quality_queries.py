"""Profile, duplicates, metrics, drift, dictionary and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import CONTRACT, clean_registration, registration, table
from checks.registry import on_clean, query
from rollbook.operators import drift, profile, validate
from rollbook.plans.pages import exploratory
from rollbook.plans.quality import REGISTRATION_QUALITY, quality
from rollbook.sources import reports
from rollbook.sources.baseline import parse_baseline

# Thresholds that the small tables meet in part, so that passes and failures both occur.
RATES = {
    "county": 0.004,
    "city": 0.02,
    "postal_code": 0.015,
    "legislative_district": 0.03,
    "vehicle_location": 0.006,
    "electric_utility": 0.025,
    "census_tract_2020": 0.05,
    "electric_range_raw": 0.008,
}
BASELINE = json.dumps(
    {
        "version": 1,
        "row_count": {"expected": 15000, "relative_tolerance": 0.2},
        "maximum_missing_rates": RATES,
        "maximum_exact_duplicate_rows": 2,
        "maximum_duplicate_vehicle_ids": 1,
        "unknown_range_rate": {"expected": 0.55, "absolute_tolerance": 0.25},
        "washington_share": {"expected": 0.7, "absolute_tolerance": 0.05},
    }
)


def _thresholds(spark: SparkSession) -> DataFrame:
    return parse_baseline(spark.range(1).select(F.lit(BASELINE).alias("value")))


_CLEAN_TYPES = [f.name for f in CONTRACT.dictionary]


def _profile_sql(source: str, columns: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT {i} AS position, '{c}' AS "column", count(*) AS n_rows,
    count(*) - count("{c}") AS missing_count,
    round_even((count(*) - count("{c}")) / count(*), 6) AS missing_rate,
    count(DISTINCT "{c}") AS unique_count FROM {source}"""
        for i, c in enumerate(columns, start=1)
    )


@query("profile_columns", on_clean(_profile_sql("clean", _CLEAN_TYPES)))
def profile_columns(spark: SparkSession, folder: str) -> DataFrame:
    return _bigint(profile.column_profile(clean_registration(spark, folder)))


def _bigint(df: DataFrame) -> DataFrame:
    return df.withColumn("position", F.col("position").cast("int"))


_EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query("profile_events", _profile_sql("events", _EVENTS))
def profile_events(spark: SparkSession, folder: str) -> DataFrame:
    return _bigint(profile.column_profile(table(spark, folder, "events").select(*_EVENTS)))


_DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@query("profile_documents", _profile_sql("documents", _DOCUMENTS))
def profile_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _bigint(profile.column_profile(table(spark, folder, "documents").select(*_DOCUMENTS)))


@query(
    "missingness_ranking",
    on_clean(
        f"""SELECT "column", missing_count, missing_rate,
    n_rows - missing_count AS populated_count FROM ({_profile_sql("clean", _CLEAN_TYPES)})"""
    ),
)
def missingness_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return profile.missingness(profile.column_profile(clean_registration(spark, folder)))


@query(
    "duplicate_rows",
    """SELECT CAST(sum(n - 1) AS BIGINT) AS exact_duplicate_rows FROM
    (SELECT count(*) AS n FROM documents GROUP BY text, lang, source, n_chars)""",
)
def duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return profile.duplicate_rows(documents, ["text", "lang", "source", "n_chars"])


@query(
    "duplicate_key_extras",
    """SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_keys FROM
    (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
)
def duplicate_key_extras(spark: SparkSession, folder: str) -> DataFrame:
    return profile.duplicate_keys(
        table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"]
    )


_METRICS = """SELECT count(*) AS row_count, CAST(22 AS BIGINT) AS column_count,
    count(*) - count(electric_range_miles) AS unknown_range_count,
    round_even((count(*) - count(electric_range_miles)) / count(*), 6) AS unknown_range_rate,
    count(*) FILTER (WHERE longitude IS NOT NULL AND latitude IS NOT NULL)
        AS complete_coordinate_count,
    round_even(count(*) FILTER (WHERE longitude IS NOT NULL AND latitude IS NOT NULL)
        / count(*), 6) AS complete_coordinate_rate,
    count(*) FILTER (WHERE is_washington) AS washington_vehicle_count,
    round_even(count(*) FILTER (WHERE is_washington) / count(*), 6) AS washington_share
    FROM clean"""


@query("quality_metrics", on_clean(_METRICS))
def quality_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return profile.table_metrics(clean_registration(spark, folder), REGISTRATION_QUALITY)


def _missing_rate(column: str) -> str:
    return f"round_even((count(*) - count({column})) / count(*), 6)"


_RATE_CHECKS = "\n".join(
    f"UNION ALL SELECT {i}, 'missing_rate.{name}', {name}, 'at most {bound:.6f}', {name} <= {bound} FROM m"
    for i, (name, bound) in enumerate(RATES.items(), start=4)
)

_CHECKS = f"""
m AS (SELECT count(*) AS n,
    count(*) - count(DISTINCT dol_vehicle_id) AS key_extras,
    (SELECT coalesce(sum(k - 1), 0) FROM (SELECT count(*) AS k FROM clean GROUP BY ALL
        HAVING false)) AS row_extras,
    {", ".join(f"{_missing_rate(name)} AS {name}" for name in RATES)},
    {_missing_rate("electric_range_miles")} AS unknown_range,
    round_even(count(*) FILTER (WHERE is_washington) / count(*), 6) AS washington FROM clean),
checks AS (
SELECT 1 AS seq, 'row_count' AS metric, CAST(n AS DOUBLE) AS observed,
    'between 12000 and 18000' AS expectation, n BETWEEN 12000 AND 18000 AS passed FROM m
UNION ALL SELECT 2, 'exact_duplicate_rows',
    (SELECT CAST(count(*) AS DOUBLE) FROM clean) -
    (SELECT count(*) FROM (SELECT DISTINCT * FROM clean)), 'at most 2',
    (SELECT count(*) FROM clean) - (SELECT count(*) FROM (SELECT DISTINCT * FROM clean)) <= 2 FROM m
UNION ALL SELECT 3, 'duplicate_vehicle_ids', key_extras, 'at most 1', key_extras <= 1 FROM m
{_RATE_CHECKS}
UNION ALL SELECT {len(RATES) + 4}, 'unknown_range_rate', unknown_range,
    'between 0.300000 and 0.800000', unknown_range BETWEEN 0.3 AND 0.8 FROM m
UNION ALL SELECT {len(RATES) + 5}, 'washington_share', washington,
    'between 0.650000 and 0.750000', washington BETWEEN 0.65 AND 0.75 FROM m)"""


@query(
    "drift_checks",
    on_clean(
        "SELECT *, CASE WHEN passed THEN 'Passed' ELSE 'Review required' END AS status FROM checks",
        _CHECKS,
    ),
)
def drift_checks(spark: SparkSession, folder: str) -> DataFrame:
    return quality(clean_registration(spark, folder), _thresholds(spark)).checks


@query(
    "drift_verdict",
    on_clean(
        """SELECT count(*) AS n_checks, count(*) FILTER (WHERE passed) AS n_passed,
    bool_and(passed) AS is_within_baseline,
    CASE WHEN bool_and(passed) THEN 0 ELSE 2 END AS status FROM checks""",
        _CHECKS,
    ),
)
def drift_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """The same verdict from one wide aggregate and the two duplicate counts."""
    df = clean_registration(spark, folder)
    named = list(RATES)
    observed = drift.observations(
        profile.table_metrics(df, REGISTRATION_QUALITY, named),
        ("exact_duplicate_rows", profile.duplicate_rows(df)),
        ("duplicate_vehicle_ids", profile.duplicate_keys(df, [REGISTRATION_QUALITY.key])),
    )
    return drift.verdict(drift.check(_thresholds(spark), observed))


_DICTIONARY = ", ".join(
    f"('{f.name}', '{f.source}', '{f.type}', {str(f.nullable).lower()}, '{f.description}')"
    for f in CONTRACT.dictionary
)
_NULLS = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count FROM clean"
    for c in _CLEAN_TYPES
)


@query(
    "dictionary_conformance",
    on_clean(
        f"""SELECT d."column", d.source, d.expected_type, d.nullable, d.description,
    d.expected_type AS actual_type, n.missing_count,
    CASE WHEN NOT d.nullable AND n.missing_count > 0 THEN 'unexpected nulls' ELSE 'ok' END AS status
    FROM (VALUES {_DICTIONARY}) AS d("column", source, expected_type, nullable,
        description)
    JOIN ({_NULLS}) AS n USING ("column")"""
    ),
)
def dictionary_conformance(spark: SparkSession, folder: str) -> DataFrame:
    return profile.dictionary_conformance(clean_registration(spark, folder), CONTRACT)


@query("quality_report_json")
def quality_report_json(spark: SparkSession, folder: str) -> DataFrame:
    raw = registration(spark, folder)
    found = quality(clean_registration(spark, folder), _thresholds(spark))
    lines = validate.report_text(
        validate.issue_counts(raw, CONTRACT).filter(F.col("severity") == "warning")
    )
    return reports.quality_report(
        found.metrics, found.profile, found.checks, lines.select("seq", "line")
    )


@query("exploratory_report_json")
def exploratory_report_json(spark: SparkSession, folder: str) -> DataFrame:
    found = exploratory(clean_registration(spark, folder), recent_from=2000)
    return reports.exploratory_report(
        found.headline, found.breakdowns, found.range_by_type
    )
