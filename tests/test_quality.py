import json

import pytest
from conftest import only, rows
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from rollbook.operators import drift, profile
from rollbook.operators.guards import EmptyInput, MissingColumns
from rollbook.operators.validate import validate
from rollbook.plans.load import load_snapshot
from rollbook.plans.quality import quality, quality_page, write_quality
from rollbook.registration import DICTIONARY
from rollbook.sources.baseline import BaselineError, load_baseline, parse_baseline

BASELINE = {
    "version": 1,
    "row_count": {"expected": 2, "relative_tolerance": 0.2},
    "maximum_missing_rates": {"county": 0.001, "city": 0.5},
    "maximum_exact_duplicate_rows": 0,
    "maximum_duplicate_vehicle_ids": 0,
    "unknown_range_rate": {"expected": 0.5, "absolute_tolerance": 0.1},
    "washington_share": {"expected": 1.0, "absolute_tolerance": 0.02},
}


def thresholds(spark, **changes):
    document = json.dumps(BASELINE | changes)
    return parse_baseline(spark.range(1).select(F.lit(document).alias("value")))


def profiles(df, **options):
    return {r.column: r for r in profile.column_profile(df, **options).collect()}


@pytest.mark.parametrize("approximate", [False, True])
def test_profile(spark, contract, raw, approximate):
    df = raw.with_(0, county=None).clean(spark, contract)
    found = profiles(df, approximate=approximate)
    assert [r.column for r in sorted(found.values(), key=lambda r: r.position)] == df.columns
    county, state = found["county"], found["state"]
    assert (county.missing_count, county.missing_rate, county.unique_count) == (1, 0.5, 1)
    assert (state.missing_count, state.unique_count, state.n_rows) == (0, 1, 2)
    assert profile.column_profile(df.limit(0), approximate).isEmpty()


def test_profile_shuffles_by_column_and_value(spark, contract, raw):
    plan = profile.column_profile(raw.clean(spark, contract))._jdf.queryExecution().executedPlan()
    assert "hashpartitioning(column" in plan.toString()
    assert "SinglePartition" not in plan.toString()


def test_missingness_order(spark, contract, raw):
    df = raw.with_(0, county=None, city=None).with_(1, city=None).clean(spark, contract)
    found = rows(profile.missingness(profile.column_profile(df)))
    assert found[0] == ("city", 2, 1.0, 0)
    assert [r[0] for r in found[1:3]] == ["county", "electric_range_miles"]
    names = [r[0] for r in found if r[2] == 0]
    assert names == sorted(names)


def test_duplicate_rows_and_keys(spark, contract, raw):
    raw.more(0, county=None).more(0, county=None).more(0).more(1, make="X")
    df = raw.clean(spark, contract)
    assert rows(profile.duplicate_rows(df)) == [(2,)]
    assert rows(profile.duplicate_keys(df, ["dol_vehicle_id"])) == [(4,)]
    nulls = spark.sql("SELECT * FROM VALUES (NULL), (NULL), ('a') AS t(k)")
    assert rows(profile.duplicate_keys(nulls, ["k"])) == [(1,)]
    assert rows(profile.duplicate_rows(nulls.limit(0))) == [(0,)]


def test_row_digests_tell_shifted_values_apart(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 'bc'), ('ab', 'c'), ('', NULL), (NULL, '') AS t(x, y)")
    assert rows(profile.duplicate_rows(df)) == [(0,)]


def test_metrics(spark, contract, raw):
    df = raw.more(0, dol_vehicle_id="3", state="OR", vehicle_location="x").clean(spark, contract)
    from rollbook.plans.quality import REGISTRATION_QUALITY

    assert only(profile.table_metrics(df, REGISTRATION_QUALITY)) == {
        "row_count": 3,
        "column_count": 22,
        "unknown_range_count": 1,
        "unknown_range_rate": 0.333333,
        "complete_coordinate_count": 2,
        "complete_coordinate_rate": 0.666667,
        "washington_vehicle_count": 2,
        "washington_share": 0.666667,
    }


def test_all_checks_pass(spark, contract, raw):
    found = quality(raw.clean(spark, contract), thresholds(spark))
    assert only(found.verdict) == {
        "n_checks": 7,
        "n_passed": 7,
        "is_within_baseline": True,
        "status": 0,
    }
    assert [tuple(r)[1:4] for r in found.checks.collect()] == [
        ("row_count", 2.0, "between 2 and 2"),
        ("exact_duplicate_rows", 0.0, "at most 0"),
        ("duplicate_vehicle_ids", 0.0, "at most 0"),
        ("missing_rate.county", 0.0, "at most 0.001000"),
        ("missing_rate.city", 0.0, "at most 0.500000"),
        ("unknown_range_rate", 0.5, "between 0.400000 and 0.600000"),
        ("washington_share", 1.0, "between 0.980000 and 1.020000"),
    ]


def test_the_failing_check_is_named(spark, contract, raw):
    df = raw.clean(spark, contract)
    far = thresholds(spark, row_count={"expected": 10, "relative_tolerance": 0.2})
    found = quality(df, far)
    failed = [r.metric for r in found.checks.collect() if not r.passed]
    assert failed == ["row_count"]
    assert [r.status for r in found.checks.collect()].count("Review required") == 1
    assert only(found.verdict)["status"] == 2
    assert only(found.metrics)["row_count"] == 2


def test_missing_rate_over_its_limit(spark, contract, raw):
    df = raw.with_(0, county=None, city=None).clean(spark, contract)
    failed = [r.metric for r in quality(df, thresholds(spark)).checks.collect() if not r.passed]
    assert failed == ["missing_rate.county"]


def test_a_threshold_without_a_column_is_an_error(spark, contract, raw):
    unknown = thresholds(spark, maximum_missing_rates={"nope": 0.1})
    with pytest.raises(SparkRuntimeException, match="missing_rate.nope"):
        quality(raw.clean(spark, contract), unknown).checks.collect()


def test_bad_input(spark, contract, raw):
    df = raw.clean(spark, contract)
    with pytest.raises(MissingColumns, match="latitude"):
        quality(df.drop("latitude"), thresholds(spark))
    with pytest.raises(EmptyInput):
        quality(df.limit(0), thresholds(spark))


def test_baseline_file(spark, tmp_path):
    path = tmp_path / "baseline.json"
    with pytest.raises(BaselineError):
        load_baseline(spark, str(path))
    path.write_text(json.dumps(BASELINE, indent=2))
    assert load_baseline(spark, str(path)).count() == 7
    path.write_text("{")
    with pytest.raises(BaselineError, match="not one JSON object"):
        load_baseline(spark, str(path))


@pytest.mark.parametrize("gone", ["washington_share", "maximum_missing_rates"])
def test_baseline_sections(spark, gone):
    document = json.dumps({k: v for k, v in BASELINE.items() if k != gone})
    with pytest.raises(BaselineError, match=gone):
        parse_baseline(spark.range(1).select(F.lit(document).alias("value")))


def test_baseline_version(spark):
    with pytest.raises(BaselineError, match="version 1|has version"):
        thresholds(spark, version=2)


def test_row_bounds_round_half_even(spark):
    found = thresholds(spark, row_count={"expected": 5, "relative_tolerance": 0.1}).first()
    assert found.expectation == "between 4 and 6"


def test_dictionary_matches_the_clean_table(spark, contract, raw):
    df = raw.clean(spark, contract)
    found = profile.dictionary_conformance(df, contract).collect()
    assert len(found) == len(DICTIONARY) and {r.status for r in found} == {"ok"}


def test_dictionary_deviations(spark, contract, raw):
    df = raw.with_(0, make=None).clean(spark, contract)
    df = df.drop("model").withColumn("extra", F.lit(1)).withColumn("city", F.lit(1))
    found = {r.column: r.status for r in profile.dictionary_conformance(df, contract).collect()}
    odd = {c: s for c, s in found.items() if s != "ok"}
    assert odd == {
        "make": "unexpected nulls",
        "model": "missing",
        "extra": "undocumented",
        "city": "wrong type",
    }


def test_written_report(spark, contract, raw, tmp_path):
    raw.with_(0, postal_code="ABC", county=None)
    path = str(tmp_path / "a" / "b" / "report")
    report = validate(raw.frame(spark), contract)
    verdict = write_quality(raw.clean(spark, contract), report, thresholds(spark), path)
    assert (verdict.is_within_baseline, verdict.status) == (False, 2)
    text = spark.read.text(path).first().value
    document = json.loads(text)
    assert text == json.dumps(document, sort_keys=True, separators=(",", ":"))
    assert document["row_count"] == 2 and document["baseline_version"] == 1
    assert document["columns"]["county"] == {
        "missing_count": 1,
        "missing_rate": 0.5,
        "unique_count": 1,
    }
    assert document["is_within_baseline"] is False
    assert [c["metric"] for c in document["baseline_checks"]][:2] == [
        "row_count",
        "exact_duplicate_rows",
    ]
    assert document["validation_warnings"] == [
        "[missing_optional_value] 'County' contains blank values. (1 rows)",
        "[invalid_postal_format] Postal Code should contain four or five digits before cleaning. (1 rows)",
    ]


def test_long_text_is_profiled_by_digest(spark):
    df = spark.sql("SELECT * FROM VALUES ('a'), (repeat('a', 64)), (repeat('a', 64)), "
                   "(repeat('b', 99)), (sha2(repeat('b', 99), 256)) AS t(x)")
    assert profiles(df)["x"].unique_count == 4


def test_quality_page(spark, contract, raw, tmp_path):
    source = str(tmp_path / "csv")
    raw.with_(0, county=None).frame(spark).coalesce(1).write.option("header", True).csv(source)
    snapshot = load_snapshot(spark, source, contract, str(tmp_path / "clean"))
    page = quality_page(snapshot, contract, thresholds(spark))
    assert only(page.headline) == {
        "row_count": 2,
        "column_count": 22,
        "warning_count": 1,
        "baseline_passed_count": 6,
        "baseline_check_count": 7,
        "baseline_passed": False,
    }
    assert [r.line for r in page.warnings.collect()] == [
        "[missing_optional_value] 'County' contains blank values. (1 rows)"
    ]
    assert len(only(page.files)["sha256"]) == 64
    assert page.dictionary.filter("status <> 'ok'").isEmpty()


def test_observations_reject_nothing(spark):
    metrics = spark.sql("SELECT 1 AS a, 0.5D AS b")
    more = ("c", spark.sql("SELECT 7L AS x"))
    assert sorted(rows(drift.observations(metrics, more))) == [("a", 1.0), ("b", 0.5), ("c", 7.0)]


@pytest.mark.parametrize(
    "change",
    [
        {"maximum_missing_rates": None},
        {"row_count": {}},
        {"maximum_exact_duplicate_rows": None},
        {"maximum_exact_duplicate_rows": "zero"},
        {"maximum_missing_rates": {"county": None}},
        {"washington_share": {"expected": 1.0}},
    ],
)
def test_open_bounds_are_refused(spark, change):
    with pytest.raises(BaselineError):
        thresholds(spark, **change)


def test_no_checks_are_no_pass(spark):
    none = spark.createDataFrame([], "passed boolean")
    (row,) = drift.verdict(none).collect()
    assert (row.n_checks, row.is_within_baseline, row.status) == (0, False, 2)


def test_signed_zeros_are_duplicates(spark):
    df = spark.createDataFrame([(0.0, "a"), (-0.0, "a"), (float("nan"), "a")], "x double, y string")
    assert profile.duplicate_rows(df).first()[0] == 3 - df.distinct().count() == 1
