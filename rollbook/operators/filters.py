"""The filters that every analysis shares, their options and their description."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import fold, strip
from rollbook.operators.guards import EmptyInput, need_columns
from rollbook.staging import stage


@dataclass(frozen=True)
class FilterColumns:
    """What is filtered: scope, year, and ``levels`` of (column, noun) from outer to inner."""

    state: str
    home: str
    home_label: str
    year: str
    levels: tuple[tuple[str, str], ...]

    @property
    def names(self) -> list[str]:
        return [self.state, self.year, *(column for column, _ in self.levels)]


@dataclass(frozen=True)
class Selection:
    """Chosen values. A level that is absent or empty means all values."""

    first_year: int
    last_year: int
    home_only: bool = True
    chosen: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.first_year > self.last_year:
            raise ValueError("The first year cannot exceed the last year.")


def predicate(columns: FilterColumns, selection: Selection, depth: int | None = None) -> Column:
    """One condition for scope, years and the first ``depth`` levels (default all)."""
    keep = F.col(columns.year).between(selection.first_year, selection.last_year)
    if selection.home_only:
        keep = keep & (F.col(columns.state) == columns.home)
    return keep & _levels(columns, selection.chosen, len(columns.levels) if depth is None else depth)


def apply_filters(df: DataFrame, columns: FilterColumns, selection: Selection) -> DataFrame:
    """Keep the selected rows; a null in a filtered column drops the row."""
    need_columns(df, columns.names)
    return df.filter(predicate(columns, selection))


def available_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values in case-insensitive order."""
    need_columns(df, [column])
    values = df.select(F.col(column).cast("string").alias("value")).dropna().distinct()
    return values.orderBy(fold(F.col("value")), "value")


def facets(df: DataFrame, columns: FilterColumns, selection: Selection) -> DataFrame:
    """Options of every level, ``level, value``, each given scope, years and the outer levels.

    One scan: the distinct combinations of the levels, which are few, are found per task first,
    and each then offers its value to the levels whose outer conditions it meets.
    """
    return _offers(_combinations(df, columns, selection), columns, selection.chosen)


def cascade(
    df: DataFrame, columns: FilterColumns, selection: Selection
) -> tuple[Selection, DataFrame]:
    """Drop chosen values that are no longer offered, level by level, and give the options left.

    A level whose values are all gone means all. The source is read once, for its distinct
    value combinations within scope and years; the levels are then settled on that table, each
    bringing at most the chosen values to the driver.
    """
    combinations = stage(_combinations(df, columns, selection)).frame
    settled: dict[str, tuple[str, ...]] = {}
    for depth, (name, _) in enumerate(columns.levels):
        wanted = selection.chosen.get(name, ())
        if not wanted:
            continue
        offered = combinations.filter(_levels(columns, settled, depth))
        found = offered.filter(F.col(name).isin(*wanted)).select(name).distinct().collect()
        alive = {row[0] for row in found}
        settled[name] = tuple(value for value in wanted if value in alive)
    chosen = {name: values for name, values in settled.items() if values}
    return replace(selection, chosen=chosen), _offers(combinations, columns, chosen)


def _combinations(df: DataFrame, columns: FilterColumns, selection: Selection) -> DataFrame:
    """Distinct values of all levels together, within scope and years."""
    need_columns(df, columns.names)
    within = df.filter(predicate(columns, selection, 0))
    return within.select(*(name for name, _ in columns.levels)).distinct()


def _offers(
    combinations: DataFrame, columns: FilterColumns, chosen: Mapping[str, tuple[str, ...]]
) -> DataFrame:
    offers = [
        F.struct(
            F.lit(name).alias("level"),
            F.when(_levels(columns, chosen, depth), F.col(name)).alias("value"),
        )
        for depth, (name, _) in enumerate(columns.levels)
    ]
    options = combinations.select(F.inline(F.array(*offers)))
    return options.filter(F.col("value").isNotNull()).distinct()


def _levels(columns: FilterColumns, chosen: Mapping[str, tuple[str, ...]], depth: int) -> Column:
    """The conditions of the first ``depth`` levels."""
    keep = F.lit(True)
    for column, _ in columns.levels[:depth]:
        if chosen.get(column):
            keep = keep & F.col(column).isin(*chosen[column])
    return keep


def default_selection(df: DataFrame, columns: FilterColumns) -> Selection:
    """Home scope and the full year bounds of the unfiltered table."""
    low, high = df.agg(F.min(columns.year), F.max(columns.year)).first()
    if low is None:
        raise EmptyInput(f"No values of {columns.year} in the input.")
    return Selection(first_year=low, last_year=high)


def describe(columns: FilterColumns, selection: Selection) -> str:
    """One line naming scope, years and levels; up to two values are spelled out."""

    def level(column: str, noun: str) -> str:
        values = selection.chosen.get(column, ())
        if not values:
            return f"All {noun}"
        return ", ".join(values) if len(values) <= 2 else f"{len(values)} {noun} selected"

    scope = columns.home_label if selection.home_only else "All source states"
    years = f"Model years {selection.first_year}-{selection.last_year}"
    return " · ".join([scope, years, *(level(*entry) for entry in columns.levels)])


def with_context(df: DataFrame, columns: FilterColumns, selection: Selection) -> DataFrame:
    """Stamp every row of a result with the filters it was computed under."""
    return df.withColumn("filter_context", F.lit(describe(columns, selection)))


def search(df: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows whose joined columns contain the needle, literally and ignoring case."""
    need_columns(df, columns)
    if not needle.strip():
        return df
    text = fold(F.concat_ws(" ", *columns))
    return df.filter(F.contains(text, fold(strip(F.lit(needle)))))
