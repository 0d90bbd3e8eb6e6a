"""The result sets of each page.

Every builder reads the (filtered) table at most twice: once for a small table of counts, which
is staged, and once for the number of distinct keys. All results are derived from the staged
counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.numbers import share
from rollbook.operators import breakdown, distribution, grid, places, ranking
from rollbook.operators.guards import EmptyInput, need_columns, need_positive, need_some
from rollbook.operators.ordering import quantiles
from rollbook.staging import Staged, stage, together


@dataclass(frozen=True)
class Columns:
    """Clean columns the pages use, and the values they single out."""

    key: str = "dol_vehicle_id"
    year: str = "model_year"
    type: str = "ev_type_code"
    status: str = "cafv_status"
    make: str = "make"
    model: str = "model"
    county: str = "county"
    city: str = "city"
    measure: str = "electric_range_miles"
    main_type: str = "BEV"
    eligible: str = "Eligible"
    unknown: str = "Unknown"


def _need_rows(staged: Staged) -> None:
    if staged.rows == 0:
        raise EmptyInput("The input has no rows.")


def _complete(names: list[str]) -> Column:
    """Whether none of the columns is null."""
    known = F.lit(True)
    for name in names:
        known = known & F.col(name).isNotNull()
    return known


def _count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("count"))), F.lit(0))


def _summed(cells: Staged, *names: str) -> Staged:
    """Counts over fewer columns; the bound of the staged table holds for them too."""
    sums = cells.frame.groupBy(*names).agg(F.sum("count").alias("count"))
    return Staged(sums, cells.rows)


def _median(values: Staged, value: str) -> float:
    found = quantiles(values, [], value, "count", {"median": 0.5}).first()
    if found is None:
        raise EmptyInput(f"No values of {value} in the input.")
    return found[0]


@dataclass(frozen=True)
class Overview:
    headline: DataFrame
    model_years: DataFrame
    vehicle_types: DataFrame
    top_makes: DataFrame
    leading_year: DataFrame


def overview(
    df: DataFrame,
    columns: Columns = Columns(),
    top_makes: int = 5,
) -> Overview:
    """Distinct vehicles, type and status shares, known coverage, median year, and series."""
    c = columns
    need_columns(df, [c.key, c.type, c.year, c.measure, c.status, c.make])
    need_positive(top_makes, "top_makes")
    known = F.col(c.measure).isNotNull().alias("known")
    cells, vehicles = together(
        lambda: stage(
            df.groupBy(c.year, c.type, c.status, c.make, known).agg(
                F.count(F.lit(1)).alias("count")
            )
        ),
        lambda: breakdown.distinct_keys(df, c.key),
    )
    _need_rows(cells)
    median = _median(_summed(cells, c.year), c.year)
    headline = cells.frame.agg(
        F.lit(vehicles).cast("bigint").alias("vehicle_count"),
        _count_if(F.col(c.type) == c.main_type).alias("bev_count"),
        _count_if(F.col("known")).alias("known_range_count"),
        _count_if(F.col(c.status) == c.eligible).alias("eligible_count"),
    ).select(
        "*",
        *(
            share(F.col(f"{name}_count"), F.col("vehicle_count")).alias(f"{name}_share")
            for name in ("bev", "known_range", "eligible")
        ),
        F.lit(median).alias("median_model_year"),
    )
    years = breakdown.summed_breakdown(cells.frame, c.year, sort_by_value=True)
    return Overview(
        headline,
        years,
        breakdown.summed_breakdown(cells.frame, c.type),
        breakdown.summed_breakdown(cells.frame, c.make, limit=top_makes),
        breakdown.leading(years),
    )


@dataclass(frozen=True)
class Exploratory:
    headline: DataFrame
    breakdowns: dict[str, DataFrame]
    range_by_type: DataFrame


def exploratory(
    df: DataFrame,
    columns: Columns = Columns(),
    recent_from: int = 2021,
    top: int = 10,
    top_counties: int = 5,
) -> Exploratory:
    """Composition, concentration and known range of a whole table; shares are of rows."""
    c = columns
    ranked = (c.make, c.model, c.county, c.city)
    sets = ((c.year, c.type, c.status, c.make, c.model), (c.county, c.city), (c.type, c.measure))
    names = list(dict.fromkeys(name for group in sets for name in group))
    need_columns(df, names)
    # All three groupings in one scan and one shuffle, told apart by the set they belong to.
    grouped = df.groupingSets(sets, *names).agg(
        F.grouping_id().alias("set"), F.count(F.lit(1)).alias("count")
    )
    cells = stage(grouped, "count")
    _need_rows(cells)
    rows = cells.total // len(sets)

    def of_set(group: tuple[str, ...]) -> DataFrame:
        left_out = sum(1 << i for i, name in enumerate(reversed(names)) if name not in group)
        return cells.frame.filter(F.col("set") == left_out).select(*group, "count")

    types, places_, measures = (of_set(group) for group in sets)
    years = Staged(types, cells.rows)
    median = _median(_summed(years, c.year), c.year)

    def of(name: str, **options) -> DataFrame:
        source = places_ if name in sets[1] else types
        return breakdown.summed_breakdown(source, name, **options)

    breakdowns = {c.year: of(c.year, sort_by_value=True), c.type: of(c.type)}
    breakdowns |= {c.status: of(c.status)} | {name: of(name, limit=top) for name in ranked}
    composition = types.agg(
        F.min(c.year).alias("model_year_min"),
        F.max(c.year).alias("model_year_max"),
        _count_if(F.col(c.year) >= recent_from).alias("recent_model_year_count"),
        F.count_distinct(c.make).alias("make_count"),
        F.count_distinct(c.model).alias("model_count"),
    )
    located = places_.agg(
        F.count_distinct(c.county).alias("county_count"),
        F.count_distinct(c.city).alias("city_count"),
    )
    headline = composition.select(
        F.lit(rows).cast("bigint").alias("vehicle_count"),
        "*",
        *(located.select(name).scalar().alias(name) for name in located.columns),
        share(F.col("recent_model_year_count"), F.lit(rows)).alias("recent_model_year_share"),
        F.lit(median).alias("model_year_median"),
        breakdown.concentration(breakdowns[c.make], top).scalar().alias("top_10_make_share"),
        breakdown.concentration(breakdowns[c.county], top_counties)
        .scalar()
        .alias("top_5_county_share"),
    )
    by_type = Staged(measures.withColumnRenamed(c.measure, "value"), cells.rows)
    stats = distribution.distribution(by_type, c.type)
    return Exploratory(headline, breakdowns, stats.withColumn("mean", F.bround("mean", 2)))


@dataclass(frozen=True)
class Market:
    headline: DataFrame
    makes: DataFrame
    models: DataFrame
    grid: DataFrame
    leading_makes: DataFrame


def market(
    df: DataFrame,
    columns: Columns = Columns(),
    grid_makes: int = 10,
) -> Market:
    """Complete make and make/model rankings, concentration, and the make by year grid."""
    c = columns
    need_columns(df, [c.key, c.make, c.model, c.year])
    need_positive(grid_makes, "grid_makes")
    cells, vehicles = together(
        lambda: stage(
            df.groupBy(c.make, c.model, c.year).agg(F.count(F.lit(1)).alias("count")),
            seen={"pairs": F.count_if(_complete([c.make, c.model])), "years": F.count(c.year)},
        ),
        lambda: breakdown.distinct_keys(df, c.key),
    )
    _need_rows(cells)
    by_make = ranking.regroup(cells, [c.make], [c.make, c.model])
    by_model = ranking.regroup(cells, [c.make, c.model], [c.make, c.model])
    need_some(cells.seen["pairs"], f"rows with {c.make} and {c.model}")
    need_some(cells.seen["years"], f"values of {c.year}")
    label = ranking.pair_label(c.model, c.make, " — ")
    makes, models = together(
        lambda: ranking.rank_counts(by_make, [c.make], vehicles, F.col(c.make)),
        lambda: ranking.rank_counts(by_model, [c.make, c.model], vehicles, label),
    )
    headline = ranking.headline(makes).select(
        F.lit(vehicles).cast("bigint").alias("vehicle_count"),
        F.col("n_groups").alias("make_count"),
        by_model.frame.agg(F.count(F.lit(1))).scalar().alias("make_model_count"),
        F.col("leader").alias("leading_make"),
        F.col("leader_count").alias("leading_make_count"),
        F.col("leader_share").alias("leading_make_share"),
        F.col("top_share").alias("top_10_make_share"),
    )
    leaders = ranking.leaders(by_make, [c.make], grid_makes)
    return Market(
        headline, makes, models, grid.complete_grid(cells.frame, c.make, leaders, c.year), leaders
    )


@dataclass(frozen=True)
class Geography:
    headline: DataFrame
    counties: DataFrame
    cities: DataFrame
    points: DataFrame


def geography(
    df: DataFrame,
    columns: places.PlaceColumns = places.PlaceColumns(),
    key: str = "dol_vehicle_id",
) -> Geography:
    """County and city rankings, aggregate points and coordinate coverage, without row keys."""
    p = columns
    need_columns(df, [key, *p.all])
    cells, vehicles = together(
        lambda: stage(
            places.place_counts(df, p), seen={"named": F.count_if(_complete(p.names))}
        ),
        lambda: breakdown.distinct_keys(df, key),
    )
    _need_rows(cells)
    need_some(cells.seen["named"], "rows with county and city")
    by_county = ranking.regroup(cells, [p.state, p.county], [p.state, p.county])
    leader = ranking.top_counts(by_county, [p.county, p.state], 1).frame
    label = ranking.pair_label(p.county, p.state, ", ")

    def distinct(names: list[str]) -> Column:
        return F.count_distinct(F.when(_complete(names), F.struct(*names)))

    located = F.coalesce(F.sum(F.when(_complete(p.all), F.col("count"))), F.lit(0))
    counted = cells.frame.agg(
        F.lit(vehicles).cast("bigint").alias("vehicle_count"),
        distinct([p.state]).alias("state_count"),
        distinct([p.state, p.county]).alias("county_count"),
        distinct(p.names).alias("city_count"),
        located.alias("coordinate_vehicle_count"),
    )
    total = F.lit(vehicles)
    headline = counted.select(
        "*",
        share(F.col("coordinate_vehicle_count"), total).alias("coordinate_coverage"),
        leader.select(label).scalar().alias("leading_county"),
        leader.select("count").scalar().alias("leading_county_count"),
        leader.select(share(F.col("count"), total)).scalar().alias("leading_county_share"),
    )
    counties, cities = together(
        lambda: places.rank_counties(cells, p, vehicles),
        lambda: places.rank_cities(cells, p, vehicles),
    )
    return Geography(headline, counties, cities, places.map_points(cells.frame, p))


@dataclass(frozen=True)
class Ranges:
    headline: DataFrame
    statistics: DataFrame
    coverage: DataFrame
    bins: DataFrame
    statuses: DataFrame


def ranges(
    df: DataFrame,
    columns: Columns = Columns(),
    width: int = 10,
) -> Ranges:
    """Known-range coverage, statistics and bins per type, and eligibility statuses."""
    c = columns
    need_columns(df, [c.key, c.type, c.measure, c.status])
    need_positive(width, "width")
    cells, vehicles = together(
        lambda: stage(
            distribution.measure_counts(df, [c.type, c.status], c.measure),
            seen={"types": F.count(c.type)},
        ),
        lambda: breakdown.distinct_keys(df, c.key),
    )
    _need_rows(cells)
    need_some(cells.seen["types"], f"values of {c.type}")

    by_type = _summed(cells, c.type, "value")
    statistics, median = together(
        lambda: distribution.rounded(distribution.distribution(by_type, c.type)),
        lambda: quantiles(_summed(cells, "value"), [], "value", "count", {"median": 0.5}),
    )

    headline = cells.frame.agg(
        F.lit(vehicles).cast("bigint").alias("vehicle_count"),
        _count_if(F.col("value").isNotNull()).alias("known_range_count"),
        _count_if(F.col(c.status) == c.eligible).alias("eligible_count"),
        _count_if(F.col(c.status) == c.unknown).alias("unknown_cafv_count"),
    ).select(
        "*",
        *(
            share(F.col(f"{name}_count"), F.col("vehicle_count")).alias(f"{name}_share")
            for name in ("known_range", "eligible", "unknown_cafv")
        ),
        F.bround(median.scalar(), 2).alias("median_known_range"),
    )
    return Ranges(
        headline,
        statistics,
        distribution.coverage(by_type.frame, c.type),
        distribution.histogram(by_type.frame, c.type, width),
        breakdown.summed_breakdown(cells.frame, c.status),
    )
