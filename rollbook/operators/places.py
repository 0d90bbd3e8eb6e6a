"""Aggregates of places and coordinates that carry no row key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.numbers import marker_size
from rollbook.operators.guards import need_columns
from rollbook.operators.ranking import pair_label, rank_counts, regroup
from rollbook.staging import Staged


@dataclass(frozen=True)
class PlaceColumns:
    """Place names from wide to narrow, and the coordinate."""

    state: str = "state"
    county: str = "county"
    city: str = "city"
    longitude: str = "longitude"
    latitude: str = "latitude"

    @property
    def names(self) -> list[str]:
        return [self.state, self.county, self.city]

    @property
    def all(self) -> list[str]:
        return [*self.names, self.longitude, self.latitude]


def place_counts(df: DataFrame, columns: PlaceColumns) -> DataFrame:
    """Counts by place and coordinate, nulls kept: everything else is derived from these."""
    need_columns(df, columns.all)
    return df.groupBy(*columns.all).agg(F.count(F.lit(1)).alias("count"))


def rank_counties(cells: Staged, columns: PlaceColumns, total: int) -> DataFrame:
    """Counties within their state; the same name in two states stays two."""
    groups = [columns.state, columns.county]
    counts = regroup(cells, groups, groups)
    label = pair_label(columns.county, columns.state, ", ")
    ranked = rank_counts(counts, [columns.county, columns.state], total, label)
    return ranked.drop("cumulative_share")


def rank_cities(cells: Staged, columns: PlaceColumns, total: int) -> DataFrame:
    """Cities within county and state."""
    counts = regroup(cells, columns.names, columns.names)
    label = pair_label(columns.city, columns.state, ", ")
    order = [columns.city, columns.state, columns.county]
    return rank_counts(counts, order, total, label).drop("cumulative_share")


def point_order(columns: PlaceColumns) -> list[Column]:
    return [F.desc("count"), *(F.col(name).asc() for name in columns.all)]


def map_points(cells: DataFrame, columns: PlaceColumns) -> DataFrame:
    """Counts per place and coordinate where all five are known, largest first."""
    return cells.dropna(subset=columns.all).orderBy(*point_order(columns))


def with_marker_size(points: DataFrame) -> DataFrame:
    """Add the drawing size; the largest count is a scalar subquery."""
    largest = points.agg(F.max("count")).scalar()
    return points.withColumn("size", marker_size(F.col("count"), largest))


def place_table(points: DataFrame, columns: PlaceColumns) -> DataFrame:
    """One row per point for search, without coordinates."""
    return points.select(*columns.names, "count").orderBy(F.desc("count"), *columns.names)
