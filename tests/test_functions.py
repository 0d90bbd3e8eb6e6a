import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollbook.functions import labels, numbers, points, text


def one(spark, value, kind, *expressions):
    df = spark.range(1).select(F.lit(value).cast(kind).alias("x"))
    return tuple(df.select(*(e(F.col("x")).alias(f"c{i}") for i, e in enumerate(expressions))).first())


@pytest.mark.parametrize(
    "value, stripped, tidied",
    [
        ("  a  b ", "a  b", "a b"),
        ("\t\na  b　", "a  b", "a b"),
        ("a b", "a b", "a b"),
        ("\x1ca\x1d\x1eb", "a\x1d\x1eb", "a b"),
        ("   ", "", None),
        ("", "", None),
        (None, None, None),
        ("NA", "NA", "NA"),
    ],
)
def test_white_space(spark, value, stripped, tidied):
    assert one(spark, value, "string", text.strip, text.tidy) == (stripped, tidied)


@settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.text("aß é\t\n  \x1f\x85'", max_size=12), min_size=20, max_size=60))
def test_white_space_like_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    found = rows(df.select(text.strip(F.col("x")), text.tidy(F.col("x")), text.blank(F.col("x"))))
    assert found == [(v.strip(), " ".join(v.split()) or None, not v.strip()) for v in values]


@pytest.mark.parametrize(
    "value, parsed, whole",
    [
        ("2020", 2020.0, 2020),
        ("2020.0", 2020.0, 2020),
        ("1e3", 1000.0, 1000),
        (".5", 0.5, 0),
        ("14.5", 14.5, 14),
        ("-3", -3.0, -3),
        ("+7.", 7.0, 7),
        ("9007199254740993", 9007199254740992.0, 9007199254740993),
        ("inf", float("inf"), None),
        ("12d", None, None),
        ("NaN", None, None),
        ("0x10", None, None),
        ("1_0", None, None),
        ("True", None, None),
        ("12\n3", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_numbers(spark, value, parsed, whole):
    assert one(spark, value, "string", numbers.number, numbers.integer) == (parsed, whole)


@pytest.mark.parametrize(
    "same, different",
    [
        (("1", "01", " 1.0", "1e0", "+1"), "2"),
        (("1.5", "15e-1"), "1"),
        (("9007199254740993", "9007199254740993.0"), "9007199254740992"),
        (("99999999999999999999", "099999999999999999999.0"), "99999999999999999998"),
        (("1e60", "10e59"), "1e61"),
    ],
)
def test_number_keys(spark, same, different):
    def key(value):
        return one(spark, value, "string", *(lambda c, i=i: numbers.number_key(c)[i] for i in (0, 1)))

    assert len({key(value) for value in same}) == 1
    assert key(different) != key(same[0])
    assert key("x") == key(None) == (None, None)


@pytest.mark.parametrize(
    "value, lon, lat, inside",
    [
        ("POINT (-120.5 46.25)", -120.5, 46.25, True),
        ("POINT (500 200)", 500.0, 200.0, False),
        ("POINT  (1 2)", None, None, False),
        ("POINT (1 2)\n", None, None, False),
        ("point (1 2)", None, None, False),
        (None, None, None, False),
    ],
)
def test_points(spark, value, lon, lat, inside):
    bounds = lambda c: points.in_bounds(points.longitude(c), points.latitude(c))
    assert one(spark, value, "string", points.longitude, points.latitude, bounds) == (lon, lat, inside)


def test_rates(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 3), (0, 0), (5, 8) AS t(n, d)")
    found = rows(df.select(numbers.rate(F.col("n"), F.col("d")), numbers.share(F.col("n"), F.col("d"))))
    assert found == [(0.333333, 0.333333), (0.0, None), (0.625, 0.625)]


def test_bins_floor_negative_values(spark):
    df = spark.sql("SELECT * FROM VALUES (0), (9), (10), (266), (-1) AS t(x)")
    assert [r[0] for r in rows(df.select(numbers.bin_lower(F.col("x"), 10)))] == [0, 0, 10, 260, -10]


def test_title_case_and_fold(spark):
    assert one(spark, "alfa-romeo o'NEIL", "string", text.title_case) == ("Alfa-Romeo O'Neil",)
    assert one(spark, "STRAßE", "string", text.fold) == ("strasse",)


def test_whole_value_match(spark):
    assert one(spark, "98052\n", "string", lambda c: text.matches(c, r"\d{5}")) == (False,)
    assert one(spark, "ab", "string", lambda c: text.matches(c, "a|ab")) == (True,)


def test_labels(spark):
    assert one(spark, 1234567, "bigint", labels.thousands, labels.miles) == ("1,234,567", "1,234,567 mi")
    assert one(spark, None, "bigint", labels.thousands, labels.miles) == ("—", "—")
    assert one(spark, 0.123456, "double", labels.percent) == ("12.3%",)
    assert one(spark, 2021.5, "double", labels.year) == ("2021.5",)
    assert one(spark, 2021.0, "double", labels.year) == ("2021",)


def test_marker_size(spark):
    assert one(spark, 25, "bigint", lambda c: numbers.marker_size(c, F.lit(100)))[0] == 22.5
