import pytest
from conftest import Raw, rows
from pyspark.sql import functions as F

from rollbook.operators import validate
from rollbook.operators.clean import clean


def codes(report, severity):
    return [i.code for i in report.issues if i.severity == severity]


def test_fixture_is_valid(spark, contract, raw):
    report = validate.validate(raw.frame(spark), contract)
    assert report.is_valid and report.issues == ()


def test_four_warnings_do_not_block(spark, contract, raw):
    raw.with_(
        0,
        postal_code="ABC",
        census_tract_2020="123",
        vehicle_location="POINT (500 200)",
        legislative_district="50",
    )
    report = validate.gate(raw.frame(spark), contract)
    assert set(codes(report, "warning")) == {
        "invalid_postal_format",
        "invalid_census_tract",
        "invalid_vehicle_location",
        "invalid_legislative_district",
    }
    assert [i.n_rows for i in report.issues] == [1, 1, 1, 1]


@pytest.mark.parametrize(
    "cells, expected",
    [
        ({"electric_range_raw": "-1"}, ["negative_electric_range"]),
        ({"dol_vehicle_id": "-5"}, ["non_positive_vehicle_id"]),
        ({"dol_vehicle_id": "0"}, ["non_positive_vehicle_id"]),
        ({"dol_vehicle_id": "0206050403.0"}, ["duplicate_vehicle_id"]),
        ({"ev_type": "Hydrogen"}, ["unexpected_category"]),
        ({"model_year": "20x0"}, ["invalid_integer"]),
        ({"model_year": "2020.5"}, ["invalid_integer"]),
        ({"model_year": "2020.0"}, []),
        ({"model_year": "1700"}, ["implausible_model_year"]),
        ({"model_year": "2029"}, ["implausible_model_year"]),
        ({"model_year": " "}, ["missing_required_value", "missing_required_value"]),
        ({"dol_vehicle_id": None}, ["missing_required_value", "missing_required_value"]),
        ({"vin_prefix": None}, ["missing_required_value", "invalid_vin_prefix"]),
        ({"vin_prefix": "5YJ3E1EA5O"}, ["invalid_vin_prefix"]),
        ({"vin_prefix": " 7TSTA0EV1A "}, []),
        ({"make": ""}, ["missing_required_value"]),
    ],
)
def test_errors(spark, contract, raw, cells, expected):
    df = raw.with_(0, **cells).frame(spark)
    report = validate.validate(df, contract)
    assert codes(report, "error") == expected
    assert [r.code for r in validate.issues(df, contract).collect()] == [
        i.code for i in report.issues
    ]
    if expected:
        with pytest.raises(validate.ContractViolation) as caught:
            validate.gate(df, contract)
        assert expected[0] in str(caught.value)
        assert caught.value.report.errors == report.errors


@pytest.mark.parametrize(
    "cells, expected",
    [
        ({"state": "Wash"}, "invalid_state_format"),
        ({"county": "  "}, "missing_optional_value"),
        ({"legislative_district": "14.5"}, "invalid_legislative_district"),
        ({"legislative_district": "x"}, "invalid_legislative_district"),
        ({"vehicle_location": "POINT  (1 2)"}, "invalid_vehicle_location"),
    ],
)
def test_warnings(spark, contract, raw, cells, expected):
    report = validate.validate(raw.with_(0, **cells).frame(spark), contract)
    assert report.is_valid and codes(report, "warning") == [expected]


def test_duplicates_count_every_row_of_a_group(spark, contract, raw):
    raw.more(0).more(0)
    report = validate.validate(raw.frame(spark), contract)
    assert [(i.code, i.n_rows) for i in report.errors] == [("duplicate_vehicle_id", 3)]


def test_unexpected_values_are_previewed_in_order(spark, contract):
    raw = Raw()
    for value in ("G", "b", "A", "F", "C", "E", "A"):
        raw.more(0, ev_type=f" {value} ", dol_vehicle_id=str(len(raw.rows) + 1))
    df = raw.frame(spark)
    message = "'Electric Vehicle Type' contains unreviewed values: 'A', 'C', 'E', 'F', 'G'."
    (issue,) = validate.validate(df, contract).issues
    assert (issue.message, issue.n_rows) == (message, 7)
    assert rows(validate.issues(df, contract)) == [tuple(issue)]
    line = rows(validate.report_text(validate.issues(df, contract)))[0][2]
    assert line == validate.line_of(issue) == f"[unexpected_category] {message} (7 rows)"


def test_wrong_columns_stop_the_checks(spark, contract, raw):
    df = raw.frame(spark)
    reordered = df.select(*(f"`{c}`" for c in reversed(df.columns)))
    for changed in (df.drop("County"), reordered):
        report = validate.validate(changed, contract)
        assert [i.code for i in report.issues] == ["invalid_columns"]
        assert [r.code for r in validate.issues(changed, contract).collect()] == ["invalid_columns"]


def test_empty_input_stops_the_checks(spark, contract, raw):
    df = raw.frame(spark).limit(0)
    assert validate.validate(df, contract).issues[0].code == "empty_dataset"
    found = validate.issues(df, contract).collect()
    assert [(r.code, r.n_rows) for r in found] == [("empty_dataset", None)]
    assert validate.report_text(validate.issues(df, contract)).first().line == (
        "[empty_dataset] The source file contains no data rows."
    )


def test_outside_vocabulary(spark):
    df = spark.sql("SELECT * FROM VALUES (' a '), ('b'), ('b'), (NULL), ('c') AS t(v)")
    known = spark.sql("SELECT * FROM VALUES ('a'), ('a'), ('x') AS t(k)")
    assert sorted(rows(validate.outside_vocabulary(df, "v", known))) == [("b", 2), ("c", 1)]


def test_verdict(spark, contract, raw):
    df = raw.with_(0, county=None, make=None).frame(spark)
    found = rows(validate.verdict(validate.issues(df, contract)))
    assert found == [(1, 1, False)]
    assert rows(validate.verdict(validate.issues(Raw().frame(spark), contract))) == [(0, 0, True)]


def test_clean_refuses_invalid_rows(spark, contract, raw):
    with pytest.raises(validate.ContractViolation):
        clean(raw.with_(0, make=None).frame(spark), contract)


def test_one_pass_for_all_row_rules(spark, contract, raw):
    """The wide count reads the source once and shuffles one row per task."""
    plan = validate._counts(raw.frame(spark), contract)._jdf.queryExecution().executedPlan()
    assert plan.toString().count("Exchange SinglePartition") == 1
    assert "hashpartitioning" not in plan.toString()


def test_previews_are_limited_before_the_shuffle(spark, contract, raw):
    found = validate.vocabulary_previews(raw.frame(spark), contract)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_duplicated_values_ignore_null(spark):
    df = spark.sql("SELECT * FROM VALUES (1), (1), (2), (NULL), (NULL) AS t(k)")
    assert rows(validate.duplicated_values(df, [F.col("k")])) == [(2,)]
