import pytest
from conftest import rows

from rollbook.operators import filters
from rollbook.operators.filters import Selection
from rollbook.operators.guards import EmptyInput, MissingColumns
from rollbook.registration import FILTERS


@pytest.fixture
def clean(spark, contract, raw):
    raw.more(0, dol_vehicle_id="3", state="OR", county="Lane", city="Eugene")
    raw.more(1, dol_vehicle_id="4", model_year=None)
    return raw.clean(spark, contract)


def keys(df):
    return sorted(r.dol_vehicle_id for r in df.collect())


def chosen(**values):
    return Selection(2000, 2030, home_only=False, chosen=values)


def test_empty_selection_keeps_all_with_a_year(clean):
    assert keys(filters.apply_filters(clean, FILTERS, chosen())) == ["104020301", "206050403", "3"]


def test_scope_and_inclusive_years(clean):
    assert keys(filters.apply_filters(clean, FILTERS, Selection(2018, 2018))) == ["104020301"]
    assert keys(filters.apply_filters(clean, FILTERS, Selection(2021, 2022))) == ["206050403"]


def test_levels_compose(clean):
    assert keys(filters.apply_filters(clean, FILTERS, chosen(make=("VELOMAR", "X")))) == ["104020301", "3"]
    both = chosen(make=("VELOMAR",), county=("Lane",), ev_type_code=("BEV",))
    assert keys(filters.apply_filters(clean, FILTERS, both)) == ["3"]
    assert keys(filters.apply_filters(clean, FILTERS, chosen(cafv_status=("Not eligible",)))) == []


def test_inverted_years_are_refused():
    with pytest.raises(ValueError):
        Selection(2021, 2018)


def test_missing_columns(clean):
    with pytest.raises(MissingColumns, match="make"):
        filters.apply_filters(clean.drop("make"), FILTERS, chosen())
    with pytest.raises(MissingColumns):
        filters.available_values(clean, "nope")


def test_available_values_ignore_case(spark):
    df = spark.sql("SELECT * FROM VALUES ('b'), ('A'), (NULL), ('b'), ('C') AS t(v)")
    assert rows(filters.available_values(df, "v")) == [("A",), ("b",), ("C",)]


def test_predicates_reach_the_scan(spark, clean, tmp_path):
    path = str(tmp_path / "clean")
    clean.write.parquet(path)
    asked = Selection(2018, 2022, chosen={"make": ("ALDER",)})
    kept = filters.apply_filters(spark.read.parquet(path), FILTERS, asked)
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = kept.groupBy("make").count()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(model_year,2018)" in plan and "EqualTo(state,WA)" in plan
    assert "longitude" not in plan.split("ReadSchema")[1]


def test_facets(clean):
    found = set(rows(filters.facets(clean, FILTERS, chosen(ev_type_code=("BEV",)))))
    assert {v for level, v in found if level == "ev_type_code"} == {"BEV", "PHEV"}
    assert {v for level, v in found if level == "make"} == {"VELOMAR"}
    assert {v for level, v in found if level == "county"} == {"Quillton", "Lane"}


def test_cascade_drops_stale_values(clean):
    asked = chosen(ev_type_code=("BEV",), make=("ALDER",), county=("Lane", "Larch"))
    settled, options = filters.cascade(clean, FILTERS, asked)
    assert settled.chosen == {"ev_type_code": ("BEV",), "county": ("Lane",)}
    found = set(rows(options))
    assert {v for level, v in found if level == "make"} == {"VELOMAR"}
    assert {v for level, v in found if level == "cafv_status"} == {"Eligible"}


def test_cascade_keeps_the_order_of_choice(clean):
    settled, _ = filters.cascade(clean, FILTERS, chosen(make=("VELOMAR", "NONE", "ALDER")))
    assert settled.chosen == {"make": ("VELOMAR", "ALDER")}


def test_default_selection(clean):
    assert filters.default_selection(clean, FILTERS) == Selection(2018, 2022)
    with pytest.raises(EmptyInput):
        filters.default_selection(clean.limit(0), FILTERS)


def test_description(spark):
    text = filters.describe(FILTERS, Selection(2011, 2024))
    assert text == (
        "Washington only · Model years 2011-2024 · All EV types · All makes · All counties · "
        "All CAFV statuses"
    )
    text = filters.describe(FILTERS, chosen(make=("A", "B"), county=("x", "y", "z")))
    assert text == (
        "All source states · Model years 2000-2030 · All EV types · A, B · 3 counties selected · "
        "All CAFV statuses"
    )
    stamped = filters.with_context(spark.range(1), FILTERS, Selection(1, 2))
    assert stamped.first().filter_context.startswith("Washington only · Model years 1-2")


def test_search_is_literal_and_ignores_case(clean):
    places = ["state", "county", "city"]
    assert keys(filters.search(clean, places, "  lane EUGENE ")) == ["3"]
    assert keys(filters.search(clean, places, "ya.ima")) == []
    assert len(keys(filters.search(clean, places, " "))) == 4
