"""Results of the page builders on small tables, by both ways of ranking."""

import pytest
from conftest import Raw, only, rows
from pyspark.sql import functions as F

from rollbook.operators import breakdown, distribution, grid, places, ranking
from rollbook.operators.guards import EmptyInput, MissingColumns
from rollbook.operators.places import PlaceColumns
from rollbook.plans import pages
from rollbook.staging import stage


@pytest.fixture
def clean(spark, contract, raw):
    return raw.clean(spark, contract)


def tuples(df, *names):
    return [tuple(row[n] for n in names) for row in df.collect()]


def test_breakdown_share_is_of_all_rows(spark, contract, raw):
    df = raw.with_(0, county=None).clean(spark, contract)
    assert rows(breakdown.category_breakdown(df, "county")) == [("Larch", 1, 0.5)]


def test_breakdown_ties_ignore_case(spark):
    df = spark.sql("SELECT * FROM VALUES ('b'), ('A'), ('a'), ('C'), ('C') AS t(v)")
    assert tuples(breakdown.category_breakdown(df, "v"), "value") == [("C",), ("A",), ("a",), ("b",)]
    assert tuples(breakdown.category_breakdown(df, "v", limit=1), "value", "count") == [("C", 2)]


def test_breakdown_in_natural_order(spark):
    df = spark.sql("SELECT * FROM VALUES ('10'), ('9'), ('b'), ('A'), ('1e1') AS t(v)")
    found = tuples(breakdown.category_breakdown(df, "v", sort_by_value=True), "value")
    assert found == [("9",), ("10",), ("1e1",), ("A",), ("b",)]


def test_breakdown_arguments(spark, clean):
    with pytest.raises(MissingColumns, match="nope"):
        breakdown.category_breakdown(clean, "nope")
    for limit in (0, -1):
        with pytest.raises(ValueError):
            breakdown.category_breakdown(clean, "make", limit=limit)


def test_breakdown_reads_its_column_once_and_reuses_the_shuffle(spark, tmp_path, clean):
    path = str(tmp_path / "clean")
    clean.write.parquet(path)
    found = breakdown.category_breakdown(spark.read.parquet(path), "make")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
    assert "ReadSchema: struct<make:string>" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_leading_category_is_the_first_among_equals(spark):
    df = spark.sql("SELECT * FROM VALUES (2021), (2018), (2018), (2021), (2019) AS t(y)")
    found = breakdown.leading(breakdown.category_breakdown(df, "y", sort_by_value=True))
    assert rows(found) == [("2018", 2, 0.4)]


def test_overview(spark, clean):
    page = pages.overview(clean)
    assert only(page.headline) == {
        "vehicle_count": 2,
        "bev_count": 1,
        "bev_share": 0.5,
        "known_range_count": 1,
        "known_range_share": 0.5,
        "eligible_count": 1,
        "eligible_share": 0.5,
        "median_model_year": 2020.0,
    }
    assert tuples(page.model_years, "value") == [("2018",), ("2022",)]
    assert tuples(page.top_makes, "value", "count", "share") == [("ALDER", 1, 0.5), ("VELOMAR", 1, 0.5)]
    assert tuples(page.leading_year, "value") == [("2018",)]


def test_overview_counts_distinct_keys(spark, contract, raw):
    df = raw.more(0).clean(spark, contract)
    headline = only(pages.overview(df, top_makes=1).headline)
    assert (headline["vehicle_count"], headline["bev_count"], headline["bev_share"]) == (2, 2, 1.0)


def test_exploratory(spark, contract, raw):
    df = raw.more(0, dol_vehicle_id="3", county=None, electric_range_raw="100").clean(spark, contract)
    page = pages.exploratory(df)
    headline = only(page.headline)
    assert headline["vehicle_count"] == 3
    assert (headline["model_year_min"], headline["model_year_max"]) == (2018, 2022)
    assert headline["model_year_median"] == 2018.0
    assert (headline["make_count"], headline["county_count"]) == (2, 2)
    assert (headline["recent_model_year_count"], headline["recent_model_year_share"]) == (1, 0.333333)
    assert headline["top_10_make_share"] == 1.0
    assert headline["top_5_county_share"] == 0.666666
    assert tuples(page.breakdowns["make"], "value", "count") == [("VELOMAR", 2), ("ALDER", 1)]
    found = {r.ev_type_code: r for r in page.range_by_type.collect()}
    assert (found["BEV"].p25, found["BEV"].median, found["BEV"]["mean"]) == (132.75, 165.5, 165.5)
    assert (found["PHEV"].known_share, found["PHEV"].median, found["PHEV"].maximum) == (0.0, None, None)


def test_market(spark, contract, raw):
    """The same model label under two makes stays two models."""
    raw.more(0, dol_vehicle_id="3", make="OTHER").more(0, dol_vehicle_id="4")
    page = pages.market(raw.clean(spark, contract))
    found = tuples(page.models.orderBy("rank"), "rank", "label", "count", "share", "cumulative_share")
    assert found == [
        (1, "LARK 2 — VELOMAR", 2, 0.5, 0.5),
        (2, "TREKKER — ALDER", 1, 0.25, 0.75),
        (3, "LARK 2 — OTHER", 1, 0.25, 1.0),
    ]
    assert only(page.headline) == {
        "vehicle_count": 4,
        "make_count": 3,
        "make_model_count": 3,
        "leading_make": "VELOMAR",
        "leading_make_count": 2,
        "leading_make_share": 0.5,
        "top_10_make_share": 1.0,
    }
    assert rows(page.leading_makes) == [(1, "VELOMAR"), (2, "ALDER"), (3, "OTHER")]
    cells = tuples(page.grid, "make", "model_year", "count")
    assert cells == [
        ("VELOMAR", 2018, 2),
        ("VELOMAR", 2022, 0),
        ("ALDER", 2018, 0),
        ("ALDER", 2022, 1),
        ("OTHER", 2018, 1),
        ("OTHER", 2022, 0),
    ]
    assert rows(grid.matrix(page.grid, "make", "model_year", [2018, 2022])) == [
        (1, "VELOMAR", 2, 0),
        (2, "ALDER", 0, 1),
        (3, "OTHER", 1, 0),
    ]
    reached = rows(ranking.threshold_ranks(page.makes))
    assert reached == [(0.5, 1), (0.75, 2), (0.9, 3)]
    assert tuples(ranking.top_n(page.makes, 1), "label") == [("VELOMAR",)]


def test_grid_counts_rows_without_model(spark, contract, raw):
    raw.more(0, dol_vehicle_id="3", model=None)
    page = pages.market(raw.clean(spark, contract), grid_makes=1)
    assert tuples(page.makes.orderBy("rank"), "label", "count") == [("ALDER", 1), ("VELOMAR", 1)]
    assert rows(page.leading_makes) == [(1, "ALDER")]
    page = pages.market(raw.clean(spark, contract))
    assert ("VELOMAR", 2018, 2) in tuples(page.grid, "make", "model_year", "count")


def test_geography(spark, contract, raw):
    """The same county name in two states stays two; a repeated coordinate is one point."""
    raw.more(0, dol_vehicle_id="3", state="OR").more(0, dol_vehicle_id="4")
    raw.more(1, dol_vehicle_id="5", vehicle_location=None)
    page = pages.geography(raw.clean(spark, contract))
    assert tuples(page.counties.orderBy("rank"), "rank", "label", "count") == [
        (1, "Larch, WA", 2),
        (2, "Quillton, WA", 2),
        (3, "Quillton, OR", 1),
    ]
    assert tuples(page.cities.orderBy("rank"), "label", "county") == [
        ("Harborview, WA", "Larch"),
        ("Quillton, WA", "Quillton"),
        ("Quillton, OR", "Quillton"),
    ]
    assert only(page.headline) == {
        "vehicle_count": 5,
        "state_count": 2,
        "county_count": 3,
        "city_count": 3,
        "leading_county": "Larch, WA",
        "leading_county_count": 2,
        "leading_county_share": 0.4,
        "coordinate_vehicle_count": 4,
        "coordinate_coverage": 0.8,
    }
    assert tuples(page.points, "state", "city", "count") == [
        ("WA", "Quillton", 2),
        ("OR", "Quillton", 1),
        ("WA", "Harborview", 1),
    ]
    for df in (page.counties, page.cities, page.points):
        assert "dol_vehicle_id" not in df.columns
    sizes = tuples(places.with_marker_size(page.points), "size")
    assert [round(s[0], 4) for s in sizes] == [38.0, 28.9203, 28.9203]
    table = places.place_table(page.points, PlaceColumns())
    assert table.columns == ["state", "county", "city", "count"]


def test_ranges(spark, contract, raw):
    df = raw.more(0, dol_vehicle_id="3").clean(spark, contract)
    page = pages.ranges(df)
    headline = only(page.headline)
    assert (headline["known_range_count"], headline["known_range_share"]) == (2, 0.666667)
    assert (headline["median_known_range"], headline["unknown_cafv_count"]) == (231.0, 1)
    assert rows(page.bins) == [("BEV", 230, 239, "230-239", 2)]
    found = {r.ev_type_code: r for r in page.statistics.collect()}
    assert (found["BEV"].minimum, found["BEV"].median, found["BEV"].maximum) == (231, 231.0, 231)
    assert (found["PHEV"].known_count, found["PHEV"].median, found["PHEV"]["mean"]) == (0, None, None)
    assert sorted(rows(page.coverage)) == [("BEV", 2, 2, 0, 1.0), ("PHEV", 1, 0, 1, 0.0)]
    long = sorted(rows(distribution.coverage_series(page.coverage, "ev_type_code")))
    assert long[0] == ("BEV", "Known range", 2) and len(long) == 4
    assert tuples(distribution.with_known_values(page.statistics), "ev_type_code") == [("BEV",)]
    assert tuples(page.statuses, "value", "count") == [("Eligible", 2), ("Unknown", 1)]


def test_ranges_without_known_values(spark, contract, raw):
    df = raw.with_(0, electric_range_raw="0").clean(spark, contract)
    page = pages.ranges(df)
    assert only(page.headline)["median_known_range"] is None
    assert rows(page.bins) == []


BUILDERS = [pages.overview, pages.exploratory, pages.market, pages.geography, pages.ranges]


@pytest.mark.parametrize("build", BUILDERS)
def test_empty_and_incomplete_input(spark, clean, build):
    with pytest.raises(EmptyInput):
        build(clean.limit(0))
    with pytest.raises(MissingColumns):
        build(clean.drop("make", "county", "ev_type_code"))


def test_columns_without_values(spark, contract):
    def without(**cells):
        raw = Raw()
        for i in range(2):
            raw.with_(i, **cells)
        return raw.clean(spark, contract)

    for build in (pages.overview, pages.exploratory, pages.market):
        with pytest.raises(EmptyInput):
            build(without(model_year=None))
    with pytest.raises(EmptyInput):
        pages.market(without(model=None))
    with pytest.raises(EmptyInput):
        pages.geography(without(city=None))
    with pytest.raises(EmptyInput):
        pages.ranges(without(ev_type="Steam"))


def test_limits_must_be_positive(spark, clean):
    for call in (
        lambda: pages.overview(clean, top_makes=0),
        lambda: pages.market(clean, grid_makes=-1),
        lambda: pages.ranges(clean, width=0),
        lambda: pages.ranges(clean, width=2.5),
    ):
        with pytest.raises(ValueError):
            call()


def test_top_counts_never_build_the_whole_ranking(spark):
    df = spark.range(1000).select((F.col("id") % 500).alias("k"))
    counts = stage(df.groupBy("k").agg(F.count("*").alias("count")))
    top = ranking.top_counts(counts, ["k"], 3)
    assert top.rows == 3
    plan = top.frame._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_many_leaders_make_a_small_plan(spark):
    df = spark.range(6000).select((F.col("id") % 3000).alias("k"), (F.col("id") % 4).alias("y"))
    cells = stage(df.groupBy("k", "y").agg(F.count("*").alias("count")))
    by_k = ranking.regroup(cells, ["k"], ["k"])
    found = grid.complete_grid(cells.frame, "k", ranking.leaders(by_k, ["k"], 2500), "y")
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    cells = found.collect()
    assert len(cells) == 10_000 and {r.position for r in cells} == set(range(1, 2501))
    assert sum(r["count"] for r in cells) == 5000


def test_counts_are_observed_while_they_are_staged(spark):
    df = spark.range(10).withColumn("half", F.when(F.col("id") < 5, F.col("id")))
    kept = stage(df, "id", {"halves": F.count("half")})
    assert (kept.rows, kept.total, kept.seen) == (10, 45, {"halves": 5})
    none = stage(df.limit(0), "id", {"halves": F.count("half")})
    assert (none.rows, none.total, none.seen) == (0, 0, {"halves": 0})
