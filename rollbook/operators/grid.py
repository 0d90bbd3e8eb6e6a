"""Zero-filled grids of leading groups by year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete_grid(cells: DataFrame, name: str, leaders: DataFrame, year: str) -> DataFrame:
    """Every leader in every year of the whole table, absent pairs with count 0.

    ``leaders`` has ``position`` from 1 and ``name``, as :func:`ranking.leaders` gives them. The
    cells are made from the leaders, each with the list of all years, and take the counts of
    those that occur; years held only by other groups are kept. Nothing is collected, and
    neither plan nor rows grow with the groups that do not lead.
    """
    known = cells.filter(F.col(year).isNotNull())
    years = known.agg(F.array_sort(F.collect_set(year))).scalar()
    every = leaders.select("position", name, F.explode(years).alias(year))
    counts = (
        known.join(leaders.select(name), name, "left_semi")
        .groupBy(name, year)
        .agg(F.sum("count").alias("count"))
    )
    filled = every.join(counts, [name, year], "left")
    count = F.coalesce("count", F.lit(0).cast("long")).alias("count")
    return filled.select("position", name, year, count).orderBy("position", year)


def matrix(grid: DataFrame, name: str, year: str, years: Sequence[int]) -> DataFrame:
    """The grid with one row per leader and one column per year."""
    wide = grid.groupBy("position", name).pivot(year, list(years)).agg(F.sum("count"))
    return wide.fillna(0).orderBy("position")
