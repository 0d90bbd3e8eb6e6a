"""Filters, breakdowns, rankings, grids, places and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import clean_registration, table
from checks.registry import on_clean, query
from rollbook.operators import breakdown, distribution, filters, grid, places, ranking
from rollbook.operators.ordering import number_rows, quantiles
from rollbook.operators.places import PlaceColumns
from rollbook.plans import pages
from rollbook.registration import FILTERS
from rollbook.staging import stage

RECENT = 2000
PLACES = PlaceColumns()

# Filters

SELECTION = filters.Selection(
    first_year=1996,
    last_year=2000,
    chosen={
        "ev_type_code": ("BEV",),
        "make": ("MAKE 1", "MAKE 2", "MAKE 3", "MAKE 5"),
        "cafv_status": ("Eligible", "Unknown"),
    },
)
# "MAKE 99" and "County 77" do not exist; no county survives, so the level means all.
STALE = filters.Selection(
    first_year=1996,
    last_year=2000,
    chosen={
        "ev_type_code": ("BEV",),
        "make": ("MAKE 99", "MAKE 5", "MAKE 1"),
        "county": ("County 77",),
        "cafv_status": ("Unknown",),
    },
)
_SCOPE = "state = 'WA' AND model_year BETWEEN 1996 AND 2000"
_MAKES = "make IN ('MAKE 1', 'MAKE 2', 'MAKE 3', 'MAKE 5')"
_FILTERED = (
    f"SELECT * FROM clean WHERE {_SCOPE} AND ev_type_code = 'BEV' AND {_MAKES} "
    "AND cafv_status IN ('Eligible', 'Unknown')"
)


@query("filter_global", on_clean(_FILTERED))
def filter_global(spark: SparkSession, folder: str) -> DataFrame:
    return filters.apply_filters(clean_registration(spark, folder), FILTERS, SELECTION)


@query(
    "filter_context",
    on_clean(
        f"""SELECT ev_type_code, count(*) AS count, 'Washington only · Model years 1996-2000 · ' ||
    'BEV · 4 makes selected · All counties · Eligible, Unknown' AS filter_context
    FROM ({_FILTERED}) GROUP BY ev_type_code"""
    ),
)
def filter_context(spark: SparkSession, folder: str) -> DataFrame:
    kept = filters.apply_filters(clean_registration(spark, folder), FILTERS, SELECTION)
    return filters.with_context(kept.groupBy("ev_type_code").count(), FILTERS, SELECTION)


@query("available_values", "SELECT DISTINCT p_type AS value FROM part WHERE p_type IS NOT NULL")
def available_values(spark: SparkSession, folder: str) -> DataFrame:
    return filters.available_values(table(spark, folder, "part"), "p_type")


def _offers(*levels: tuple[str, str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT DISTINCT '{column}' AS level, {column} AS value FROM clean "
        f"WHERE {_SCOPE} AND {condition} AND {column} IS NOT NULL"
        for column, condition in levels
    )


@query(
    "facet_cascade",
    on_clean(
        _offers(
            ("ev_type_code", "true"),
            ("make", "ev_type_code = 'BEV'"),
            ("county", f"ev_type_code = 'BEV' AND {_MAKES}"),
            ("cafv_status", f"ev_type_code = 'BEV' AND {_MAKES}"),
        )
    ),
)
def facet_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return filters.facets(clean_registration(spark, folder), FILTERS, SELECTION)


_ALIVE = "ev_type_code = 'BEV' AND make IN ('MAKE 5', 'MAKE 1')"


@query(
    "facet_stale",
    on_clean(
        "SELECT *, 'Washington only · Model years 1996-2000 · BEV · MAKE 5, MAKE 1 · "
        "All counties · Unknown' AS filter_context FROM ("
        + _offers(
            ("ev_type_code", "true"),
            ("make", "ev_type_code = 'BEV'"),
            ("county", _ALIVE),
            ("cafv_status", _ALIVE),
        )
        + ")"
    ),
)
def facet_stale(spark: SparkSession, folder: str) -> DataFrame:
    settled, options = filters.cascade(clean_registration(spark, folder), FILTERS, STALE)
    return filters.with_context(options, FILTERS, settled)


@query(
    "filter_default",
    on_clean(
        """SELECT make, count(*) AS count FROM clean WHERE state = 'WA' AND model_year BETWEEN
    (SELECT min(model_year) FROM clean) AND (SELECT max(model_year) FROM clean) GROUP BY make"""
    ),
)
def filter_default(spark: SparkSession, folder: str) -> DataFrame:
    df = clean_registration(spark, folder)
    selection = filters.default_selection(df, FILTERS)
    return filters.apply_filters(df, FILTERS, selection).groupBy("make").count()


_POINTS = """SELECT state, county, city, longitude, latitude, count(*) AS count FROM clean
    WHERE state IS NOT NULL AND county IS NOT NULL AND city IS NOT NULL
    AND longitude IS NOT NULL AND latitude IS NOT NULL GROUP BY ALL"""


@query(
    "place_search",
    on_clean(
        f"""SELECT state, county, city, count FROM ({_POINTS})
    WHERE contains(lower(state || ' ' || county || ' ' || city), 'county 1 city 1')"""
    ),
)
def place_search(spark: SparkSession, folder: str) -> DataFrame:
    points = pages.geography(clean_registration(spark, folder), PLACES).points
    found = filters.search(points, PLACES.names, "  County 1 CITY 1 ")
    return places.place_table(found, PLACES)


# Breakdowns


def _breakdown_sql(source: str, column: str, tail: str = "") -> str:
    return f"""SELECT CAST({column} AS VARCHAR) AS value, count(*) AS count,
    round_even(count(*) / (SELECT count(*) FROM {source}), 6) AS share
    FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} {tail}"""


@query("category_ranked", _breakdown_sql("orders", "o_orderpriority"))
def category_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return breakdown.category_breakdown(table(spark, folder, "orders"), "o_orderpriority")


@query("category_natural", _breakdown_sql("part", "p_size"))
def category_natural(spark: SparkSession, folder: str) -> DataFrame:
    return breakdown.category_breakdown(
        table(spark, folder, "part"), "p_size", sort_by_value=True
    )


@query(
    "category_limited",
    _breakdown_sql("lineitem", "l_partkey", "ORDER BY 2 DESC, lower(value), value LIMIT 25"),
)
def category_limited(spark: SparkSession, folder: str) -> DataFrame:
    return breakdown.category_breakdown(table(spark, folder, "lineitem"), "l_partkey", limit=25)


@query("category_with_nulls", on_clean(_breakdown_sql("clean", "county")))
def category_with_nulls(spark: SparkSession, folder: str) -> DataFrame:
    return breakdown.category_breakdown(clean_registration(spark, folder), "county")


@query(
    "value_counts",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS series, CAST({c} AS VARCHAR) AS value, count(*) AS count "
        f"FROM lineitem GROUP BY {c}"
        for c in ("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey")
    ),
)
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]
    return breakdown.value_counts(table(spark, folder, "lineitem"), columns)


def _top_share(column: str, top: int) -> str:
    return f"""(SELECT round_even(sum(share), 6) FROM (
    {_breakdown_sql("clean", column, f"ORDER BY 2 DESC, lower(value), value LIMIT {top}")}))"""


@query(
    "eda_headline",
    on_clean(
        f"""SELECT count(*) AS vehicle_count, min(model_year) AS model_year_min,
    max(model_year) AS model_year_max, median(model_year) AS model_year_median,
    count(DISTINCT make) AS make_count, count(DISTINCT model) AS model_count,
    count(DISTINCT county) AS county_count, count(DISTINCT city) AS city_count,
    count(*) FILTER (WHERE model_year >= {RECENT}) AS recent_model_year_count,
    round_even(count(*) FILTER (WHERE model_year >= {RECENT}) / count(*), 6)
        AS recent_model_year_share,
    {_top_share("make", 10)} AS top_10_make_share,
    {_top_share("county", 5)} AS top_5_county_share FROM clean"""
    ),
)
def eda_headline(spark: SparkSession, folder: str) -> DataFrame:
    return pages.exploratory(clean_registration(spark, folder), recent_from=RECENT).headline


_EDA = {
    "model_year": "",
    "ev_type_code": "",
    "cafv_status": "",
    "make": "ORDER BY 2 DESC, lower(value), value LIMIT 10",
    "model": "ORDER BY 2 DESC, lower(value), value LIMIT 10",
    "county": "ORDER BY 2 DESC, lower(value), value LIMIT 10",
    "city": "ORDER BY 2 DESC, lower(value), value LIMIT 10",
}


@query(
    "eda_breakdowns",
    on_clean(
        "\nUNION ALL\n".join(
            f"SELECT '{c}' AS series, * FROM ({_breakdown_sql('clean', c, tail)})"
            for c, tail in _EDA.items()
        )
    ),
)
def eda_breakdowns(spark: SparkSession, folder: str) -> DataFrame:
    found = pages.exploratory(clean_registration(spark, folder), recent_from=RECENT)
    result = None
    for name, df in found.breakdowns.items():
        named = df.withColumn("series", F.lit(name))
        result = named if result is None else result.unionByName(named)
    return result


@query(
    "eda_concentration",
    """SELECT round_even(sum(share), 6) AS share FROM (
    SELECT round_even(count(*) / (SELECT count(*) FROM part), 6) AS share
    FROM part GROUP BY p_brand ORDER BY count(*) DESC, lower(p_brand), p_brand LIMIT 10)""",
)
def eda_concentration(spark: SparkSession, folder: str) -> DataFrame:
    found = breakdown.category_breakdown(table(spark, folder, "part"), "p_brand")
    return breakdown.concentration(found, 10)


def _distribution_sql(source: str, group: str, value: str) -> str:
    return f"""SELECT {group}, count(*) AS total_count, count({value}) AS known_count,
    round_even(count({value}) / count(*), 6) AS known_share,
    min({value}) AS minimum, round(quantile_cont({value}, 0.25), 6) AS p25,
    round(median({value}), 6) AS median, round_even(avg({value}), 2) AS mean,
    round(quantile_cont({value}, 0.75), 6) AS p75, max({value}) AS maximum
    FROM {source} WHERE {group} IS NOT NULL GROUP BY {group}"""


def _six_digits(stats: DataFrame) -> DataFrame:
    shown = {c: F.round(c, 6) for c in ("p25", "median", "p75")}
    return stats.withColumns(shown | {"mean": F.bround("mean", 2)})


@query(
    "range_by_type_eda", on_clean(_distribution_sql("clean", "ev_type_code", "electric_range_miles"))
)
def range_by_type_eda(spark: SparkSession, folder: str) -> DataFrame:
    found = pages.exploratory(clean_registration(spark, folder), recent_from=RECENT)
    return _six_digits(found.range_by_type)


# Overview


@query(
    "overview_headline",
    on_clean(
        """SELECT count(DISTINCT dol_vehicle_id) AS vehicle_count,
    count(*) FILTER (WHERE ev_type_code = 'BEV') AS bev_count,
    count(electric_range_miles) AS known_range_count,
    count(*) FILTER (WHERE cafv_status = 'Eligible') AS eligible_count,
    round_even(count(*) FILTER (WHERE ev_type_code = 'BEV') / count(DISTINCT dol_vehicle_id), 6)
        AS bev_share,
    round_even(count(electric_range_miles) / count(DISTINCT dol_vehicle_id), 6)
        AS known_range_share,
    round_even(count(*) FILTER (WHERE cafv_status = 'Eligible')
        / count(DISTINCT dol_vehicle_id), 6) AS eligible_share,
    median(model_year) AS median_model_year FROM clean WHERE state = 'WA'"""
    ),
)
def overview_headline(spark: SparkSession, folder: str) -> DataFrame:
    return pages.overview(_home(spark, folder)).headline


def _home(spark: SparkSession, folder: str) -> DataFrame:
    return clean_registration(spark, folder).filter(F.col("state") == "WA")


_HOME = "(SELECT * FROM clean WHERE state = 'WA')"


@query(
    "overview_series",
    on_clean(
        "\nUNION ALL\n".join(
            f"SELECT '{c}' AS series, * FROM ({_breakdown_sql(_HOME, c, tail)})"
            for c, tail in (
                ("model_year", ""),
                ("ev_type_code", ""),
                ("make", "ORDER BY 2 DESC, lower(value), value LIMIT 5"),
            )
        )
    ),
)
def overview_series(spark: SparkSession, folder: str) -> DataFrame:
    page = pages.overview(_home(spark, folder))
    named = {
        "model_year": page.model_years,
        "ev_type_code": page.vehicle_types,
        "make": page.top_makes,
    }
    result = None
    for name, df in named.items():
        part = df.withColumn("series", F.lit(name))
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "overview_leading_year",
    on_clean(_breakdown_sql(_HOME, "model_year", "ORDER BY 2 DESC, model_year LIMIT 1")),
)
def overview_leading_year(spark: SparkSession, folder: str) -> DataFrame:
    return pages.overview(_home(spark, folder)).leading_year


# Market

_VEHICLES = "(SELECT count(DISTINCT dol_vehicle_id) FROM clean)"
_MAKE_ORDER = "count(*) DESC, lower(make), make"
_MODEL_ORDER = "count(*) DESC, lower(make), lower(model), make, model"


def _rank_sql(columns: str, label: str, order: str, source: str, total: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY {order}) AS rank, {label} AS label, {columns},
    count(*) AS count, round_even(count(*) / {total}, 6) AS share,
    round_even(sum(count(*)) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) / {total}, 6)
        AS cumulative_share FROM {source} GROUP BY {columns}"""


_CATEGORIZED = "(SELECT * FROM clean WHERE make IS NOT NULL AND model IS NOT NULL)"
_RANK_MAKES = _rank_sql("make", "make", _MAKE_ORDER, _CATEGORIZED, _VEHICLES)
_RANK_MODELS = _rank_sql(
    "make, model", "model || ' — ' || make", _MODEL_ORDER, _CATEGORIZED, _VEHICLES
)


@query("rank_makes", on_clean(_RANK_MAKES))
def rank_makes(spark: SparkSession, folder: str) -> DataFrame:
    return pages.market(clean_registration(spark, folder)).makes


@query("rank_models", on_clean(_RANK_MODELS))
def rank_models(spark: SparkSession, folder: str) -> DataFrame:
    return pages.market(clean_registration(spark, folder)).models


_PART_ORDER = (
    "count(*) DESC, lower(p_brand), lower(p_type), p_brand, p_type"
)


@query(
    "rank_parts",
    _rank_sql(
        "p_brand, p_type",
        "p_type || ' — ' || p_brand",
        _PART_ORDER,
        "part",
        "(SELECT count(*) FROM part)",
    ),
)
def rank_parts(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    counts = stage(part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("count")))
    total = breakdown.distinct_keys(part, "p_partkey")
    label = ranking.pair_label("p_type", "p_brand", " — ")
    return ranking.rank_counts(counts, ["p_brand", "p_type"], total, label)


@query(
    "rank_order_customers",
    """SELECT row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS rank, o_custkey,
    count(*) AS count, CAST(sum(count(*)) OVER (ORDER BY count(*) DESC, o_custkey
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM orders GROUP BY o_custkey""",
)
def rank_order_customers(spark: SparkSession, folder: str) -> DataFrame:
    """The way for tables that do not fit one task, whatever the size."""
    orders = table(spark, folder, "orders")
    counts = stage(orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("count")))
    order = [F.desc("count"), F.asc("o_custkey")]
    return number_rows(counts, order, {"running": "count"})


@query(
    "market_headline",
    on_clean(
        f"""SELECT {_VEHICLES} AS vehicle_count, count(*) AS make_count,
    (SELECT count(*) FROM (SELECT DISTINCT make, model FROM {_CATEGORIZED})) AS make_model_count,
    max(label) FILTER (WHERE rank = 1) AS leading_make,
    max(count) FILTER (WHERE rank = 1) AS leading_make_count,
    max(share) FILTER (WHERE rank = 1) AS leading_make_share,
    round_even(sum(share) FILTER (WHERE rank <= 10), 6) AS top_10_make_share
    FROM ({_RANK_MAKES})"""
    ),
)
def market_headline(spark: SparkSession, folder: str) -> DataFrame:
    return pages.market(clean_registration(spark, folder)).headline


_GRID = f"""SELECT t.rank AS position, t.make, y.model_year, coalesce(c.count, 0) AS count
    FROM (SELECT rank, make FROM ({_RANK_MAKES}) WHERE rank <= 10) t
    CROSS JOIN (SELECT DISTINCT model_year FROM clean WHERE model_year IS NOT NULL) y
    LEFT JOIN (SELECT make, model_year, count(*) AS count FROM clean GROUP BY ALL) c
    ON c.make = t.make AND c.model_year = y.model_year"""


@query("heatmap_grid", on_clean(_GRID))
def heatmap_grid(spark: SparkSession, folder: str) -> DataFrame:
    return pages.market(clean_registration(spark, folder)).grid


_YEARS = range(1995, 2002)


@query(
    "heatmap_matrix",
    on_clean(
        "SELECT position, make, "
        + ", ".join(
            f'CAST(sum(count) FILTER (WHERE model_year = {y}) AS BIGINT) AS "{y}"' for y in _YEARS
        )
        + f" FROM ({_GRID}) GROUP BY position, make"
    ),
)
def heatmap_matrix(spark: SparkSession, folder: str) -> DataFrame:
    found = pages.market(clean_registration(spark, folder)).grid
    return grid.matrix(found, "make", "model_year", _YEARS)


@query(
    "heatmap_brands",
    """WITH sold AS (SELECT p_brand, year(l_shipdate) AS ship_year FROM lineitem
    JOIN part ON l_partkey = p_partkey),
    top AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, lower(p_brand), p_brand)
        AS position FROM sold GROUP BY p_brand)
    SELECT position, t.p_brand, y.ship_year, coalesce(c.count, 0) AS count
    FROM (SELECT * FROM top WHERE position <= 5) t
    CROSS JOIN (SELECT DISTINCT ship_year FROM sold) y
    LEFT JOIN (SELECT p_brand, ship_year, count(*) AS count FROM sold GROUP BY ALL) c
    ON c.p_brand = t.p_brand AND c.ship_year = y.ship_year""",
)
def heatmap_brands(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    shipped = table(spark, folder, "lineitem").groupBy(
        "l_partkey", F.year("l_shipdate").alias("ship_year")
    ).agg(F.count(F.lit(1)).alias("count"))
    sold = shipped.join(part, shipped.l_partkey == part.p_partkey)
    cells = stage(sold.groupBy("p_brand", "ship_year").agg(F.sum("count").alias("count")))
    by_brand = ranking.regroup(cells, ["p_brand"], ["p_brand"])
    top = ranking.leaders(by_brand, ["p_brand"], 5)
    return grid.complete_grid(cells.frame, "p_brand", top, "ship_year")


@query(
    "heatmap_parts",
    """WITH sold AS (SELECT l_partkey, year(l_shipdate) AS ship_year FROM lineitem),
    top AS (SELECT l_partkey, row_number() OVER (ORDER BY count(*) DESC,
        lower(CAST(l_partkey AS VARCHAR)), l_partkey) AS position FROM sold GROUP BY l_partkey)
    SELECT position, t.l_partkey, y.ship_year, coalesce(c.count, 0) AS count
    FROM (SELECT * FROM top WHERE position <= 10000) t
    CROSS JOIN (SELECT DISTINCT ship_year FROM sold) y
    LEFT JOIN (SELECT l_partkey, ship_year, count(*) AS count FROM sold GROUP BY ALL) c
    ON c.l_partkey = t.l_partkey AND c.ship_year = y.ship_year""",
)
def heatmap_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The grid of up to ten thousand leading parts."""
    shipped = table(spark, folder, "lineitem")
    cells = stage(
        shipped.groupBy("l_partkey", F.year("l_shipdate").alias("ship_year")).agg(
            F.count(F.lit(1)).alias("count")
        )
    )
    by_part = ranking.regroup(cells, ["l_partkey"], ["l_partkey"])
    top = ranking.leaders(by_part, ["l_partkey"], 10_000)
    return grid.complete_grid(cells.frame, "l_partkey", top, "ship_year")


_RANK_BRANDS = _rank_sql(
    "p_brand",
    "p_brand",
    "count(*) DESC, lower(p_brand), p_brand",
    "part",
    "(SELECT count(*) FROM part)",
)


def _rank_brands(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    counts = stage(part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("count")))
    total = breakdown.distinct_keys(part, "p_partkey")
    return ranking.rank_counts(counts, ["p_brand"], total, F.col("p_brand"))


@query(
    "concentration_thresholds",
    f"""SELECT t.threshold, min(r.rank) AS rank FROM
    (VALUES (CAST(0.5 AS DOUBLE)), (0.75), (0.9)) t(threshold)
    JOIN ({_RANK_BRANDS}) r ON r.cumulative_share >= t.threshold GROUP BY t.threshold""",
)
def concentration_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.threshold_ranks(_rank_brands(spark, folder))


@query("top_n_view", f"SELECT * FROM ({_RANK_BRANDS}) WHERE rank <= 5")
def top_n_view(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.top_n(_rank_brands(spark, folder), 5)


@query(
    "top_n_customers",
    _rank_sql(
        "o_custkey",
        "CAST(o_custkey AS VARCHAR)",
        "count(*) DESC, lower(CAST(o_custkey AS VARCHAR)), o_custkey",
        "orders",
        "(SELECT count(DISTINCT o_orderkey) FROM orders)",
    )
    + " QUALIFY rank <= 20",
)
def top_n_customers(spark: SparkSession, folder: str) -> DataFrame:
    """The first ranks without the complete ranking."""
    orders = table(spark, folder, "orders")
    counts = stage(orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("count")))
    top = ranking.top_counts(counts, ["o_custkey"], 20)
    total = breakdown.distinct_keys(orders, "o_orderkey")
    return ranking.rank_counts(top, ["o_custkey"], total, F.col("o_custkey").cast("string"))


# Geography

_COUNTY_ORDER = "count(*) DESC, lower(county), lower(state), county, state"
_CITY_ORDER = "count(*) DESC, lower(city), lower(state), lower(county), city, state, county"
_RANK_COUNTIES = _rank_sql(
    "state, county",
    "county || ', ' || state",
    _COUNTY_ORDER,
    "(SELECT * FROM clean WHERE state IS NOT NULL AND county IS NOT NULL)",
    _VEHICLES,
)
_RANK_CITIES = _rank_sql(
    "state, county, city",
    "city || ', ' || state",
    _CITY_ORDER,
    "(SELECT * FROM clean WHERE state IS NOT NULL AND county IS NOT NULL AND city IS NOT NULL)",
    _VEHICLES,
)


@query(
    "rank_counties", on_clean(f"SELECT * EXCLUDE (cumulative_share) FROM ({_RANK_COUNTIES})")
)
def rank_counties(spark: SparkSession, folder: str) -> DataFrame:
    return pages.geography(clean_registration(spark, folder), PLACES).counties


@query("rank_cities", on_clean(f"SELECT * EXCLUDE (cumulative_share) FROM ({_RANK_CITIES})"))
def rank_cities(spark: SparkSession, folder: str) -> DataFrame:
    return pages.geography(clean_registration(spark, folder), PLACES).cities


@query(
    "geo_headline",
    on_clean(
        f"""SELECT {_VEHICLES} AS vehicle_count,
    (SELECT count(DISTINCT state) FROM clean) AS state_count,
    (SELECT count(*) FROM ({_RANK_COUNTIES})) AS county_count,
    (SELECT count(*) FROM ({_RANK_CITIES})) AS city_count,
    CAST(sum(count) AS BIGINT) AS coordinate_vehicle_count,
    round_even(sum(count) / {_VEHICLES}, 6) AS coordinate_coverage,
    (SELECT label FROM ({_RANK_COUNTIES}) WHERE rank = 1) AS leading_county,
    (SELECT count FROM ({_RANK_COUNTIES}) WHERE rank = 1) AS leading_county_count,
    (SELECT share FROM ({_RANK_COUNTIES}) WHERE rank = 1) AS leading_county_share
    FROM ({_POINTS})"""
    ),
)
def geo_headline(spark: SparkSession, folder: str) -> DataFrame:
    return pages.geography(clean_registration(spark, folder), PLACES).headline


@query("map_points", on_clean(_POINTS))
def map_points(spark: SparkSession, folder: str) -> DataFrame:
    return pages.geography(clean_registration(spark, folder), PLACES).points


@query(
    "marker_size",
    on_clean(
        f"""SELECT state, county, city, longitude, latitude, count,
    round(7 + 31 * sqrt(count / (SELECT max(count) FROM ({_POINTS}))), 6) AS size
    FROM ({_POINTS})"""
    ),
)
def marker_size(spark: SparkSession, folder: str) -> DataFrame:
    points = pages.geography(clean_registration(spark, folder), PLACES).points
    return places.with_marker_size(points).withColumn("size", F.round("size", 6))


# Range and eligibility


@query(
    "range_headline",
    on_clean(
        f"""SELECT {_VEHICLES} AS vehicle_count, count(electric_range_miles) AS known_range_count,
    count(*) FILTER (WHERE cafv_status = 'Eligible') AS eligible_count,
    count(*) FILTER (WHERE cafv_status = 'Unknown') AS unknown_cafv_count,
    round_even(count(electric_range_miles) / {_VEHICLES}, 6) AS known_range_share,
    round_even(count(*) FILTER (WHERE cafv_status = 'Eligible') / {_VEHICLES}, 6)
        AS eligible_share,
    round_even(count(*) FILTER (WHERE cafv_status = 'Unknown') / {_VEHICLES}, 6)
        AS unknown_cafv_share,
    round_even(median(electric_range_miles), 2) AS median_known_range FROM clean"""
    ),
)
def range_headline(spark: SparkSession, folder: str) -> DataFrame:
    return pages.ranges(clean_registration(spark, folder)).headline


_STATS = f"""SELECT * REPLACE (round_even(p25, 2) AS p25, round_even(median, 2) AS median,
    round_even(p75, 2) AS p75) FROM
    ({_distribution_sql("clean", "ev_type_code", "electric_range_miles")})"""


@query("range_stats", on_clean(_STATS))
def range_stats(spark: SparkSession, folder: str) -> DataFrame:
    return pages.ranges(clean_registration(spark, folder)).statistics


@query(
    "range_intervals",
    on_clean(
        """SELECT make, count(*) AS total_count, count(electric_range_miles) AS known_count,
    min(electric_range_miles) AS minimum, round_even(median(electric_range_miles), 2) AS median,
    max(electric_range_miles) AS maximum FROM clean WHERE cafv_status <> 'Unknown'
    OR make <> 'MAKE 4' GROUP BY make HAVING count(electric_range_miles) > 0"""
    ),
)
def range_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Groups without known values drop out of the interval view."""
    df = clean_registration(spark, folder)
    df = df.filter((F.col("cafv_status") != "Unknown") | (F.col("make") != "MAKE 4"))
    counts = stage(distribution.measure_counts(df, ["make"], "electric_range_miles"))
    stats = distribution.rounded(distribution.distribution(counts, "make"))
    return distribution.with_known_values(stats).select(
        "make", "total_count", "known_count", "minimum", "median", "maximum"
    )


@query(
    "range_coverage",
    on_clean(
        f"""SELECT ev_type_code, total_count, known_count,
    total_count - known_count AS unknown_count, known_share FROM ({_STATS})"""
    ),
)
def range_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return pages.ranges(clean_registration(spark, folder)).coverage


@query(
    "range_coverage_long",
    on_clean(
        f"""SELECT ev_type_code, 'Known range' AS series, known_count AS count FROM ({_STATS})
    UNION ALL SELECT ev_type_code, 'Unknown range', total_count - known_count FROM ({_STATS})"""
    ),
)
def range_coverage_long(spark: SparkSession, folder: str) -> DataFrame:
    covered = pages.ranges(clean_registration(spark, folder)).coverage
    return distribution.coverage_series(covered, "ev_type_code")


@query("event_value_stats", _distribution_sql("events", "event_type", "value"))
def event_value_stats(spark: SparkSession, folder: str) -> DataFrame:
    counts = stage(
        distribution.measure_counts(table(spark, folder, "events"), ["event_type"], "value")
    )
    return _six_digits(distribution.distribution(counts, "event_type"))


_PRICES = """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10,
    round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
    round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY l_returnflag"""


@query("price_quantiles", _PRICES)
def price_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact quantiles by range, the way for values that do not fit one task."""
    lineitem = table(spark, folder, "lineitem")
    counts = stage(distribution.measure_counts(lineitem, ["l_returnflag"], "l_extendedprice"))
    asked = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    found = quantiles(counts, ["l_returnflag"], "value", "count", asked)
    return found.select("l_returnflag", *(F.round(name, 6).alias(name) for name in asked))


def _bins_sql(source: str, group: str, value: str, width: int) -> str:
    lower = f"CAST(floor({value} / {width}) * {width} AS BIGINT)"
    return f"""SELECT {group}, {lower} AS lower, {lower} + {width - 1} AS upper,
    CAST({lower} AS VARCHAR) || '-' || CAST({lower} + {width - 1} AS VARCHAR) AS label,
    count(*) AS count FROM {source} WHERE {group} IS NOT NULL AND {value} IS NOT NULL
    GROUP BY {group}, {lower}"""


@query(
    "range_histogram", on_clean(_bins_sql("clean", "ev_type_code", "electric_range_miles", 10))
)
def range_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return pages.ranges(clean_registration(spark, folder)).bins


@query("quantity_histogram", _bins_sql("lineitem", "l_returnflag", "l_quantity", 5))
def quantity_histogram(spark: SparkSession, folder: str) -> DataFrame:
    counts = distribution.measure_counts(
        table(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity"
    )
    return distribution.histogram(counts, "l_returnflag", 5)


@query("status_breakdown", on_clean(_breakdown_sql("clean", "cafv_status")))
def status_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return pages.ranges(clean_registration(spark, folder)).statuses
