"""Well-known-text points as two doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the accepted point form, longitude before latitude.
POINT = r"POINT \((-?\d+(?:\.\d+)?) (-?\d+(?:\.\d+)?)\)"


def _part(c: Column, group: int) -> Column:
    text = F.regexp_extract(c, rf"\A{POINT}\z", group)
    return F.nullif(text, F.lit("")).try_cast("double")


def longitude(c: Column) -> Column:
    return _part(c, 1)


def latitude(c: Column) -> Column:
    return _part(c, 2)


def in_bounds(lon: Column, lat: Column) -> Column:
    """True for a point on the globe, false where it is not or was not parsed."""
    inside = lon.between(-180, 180) & lat.between(-90, 90)
    return F.coalesce(inside, F.lit(False))
