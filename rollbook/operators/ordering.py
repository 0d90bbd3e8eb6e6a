"""Ranks, running totals and exact quantiles over a global order.

A window without partitions would move all rows to one task. Instead the rows are sorted by
range, which is even because the order keys are unique, numbered within their slice, and shifted
by the totals of the slices before it; only those totals, one row per slice, meet in one task.
The steps are the same at every size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.staging import Staged, written

_AT = "_at"
_SLICE = "_slice"
_POSITION_BITS = 33  # monotonically_increasing_id: partition above, row within it below


def _sliced(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows sorted by range and kept, with their place and the number of their slice."""
    placed = written(df.orderBy(*order).withColumn(_AT, F.monotonically_increasing_id()))
    return placed.withColumn(_SLICE, F.shiftright(_AT, _POSITION_BITS))


def number_rows(
    staged: Staged, order: Sequence[Column], running: Mapping[str, str] | None = None
) -> DataFrame:
    """Add ``rank`` from 1 and running totals (new name to column) in a total order.

    ``order`` must be unique per row.
    """
    running = dict(running or {})
    columns = staged.frame.columns
    ordered = _sliced(staged.frame, order)
    totals = ordered.groupBy(_SLICE).agg(
        F.count(F.lit(1)).alias("_rows"),
        *(F.sum(column).alias(f"_sum_{name}") for name, column in running.items()),
    )
    # One row per slice, so at most as many as there are shuffle partitions.
    before = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        _SLICE,
        *(
            F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name)
            for name in totals.columns[1:]
        ),
    )
    in_slice = Window.partitionBy(_SLICE).orderBy(_AT)
    so_far = in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    position = F.col(_AT).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return ordered.join(F.broadcast(offsets), _SLICE).select(
        *columns,
        (F.col("_rows") + position + 1).alias("rank"),
        *(
            (F.col(f"_sum_{name}") + F.sum(column).over(so_far)).alias(name)
            for name, column in running.items()
        ),
    )


def quantiles(
    staged: Staged,
    by: Sequence[str],
    value: str,
    count: str,
    probabilities: Mapping[str, float],
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    ``staged`` holds one row per group and value with its number of occurrences; null values
    and values that do not occur are ignored, and groups without values are absent. The values
    are sorted once, by group and value. A running count within each slice and group, shifted by
    what the group has in earlier slices, gives every value's place; each quantile is picked by
    position. The shifts are one row per slice and group met there, and are joined by both, so
    that a group with most of the values is spread over its slices.
    """
    known = staged.frame.filter(F.col(value).isNotNull() & (F.col(count) > 0))
    keyed = known.groupBy(*by, value).agg(F.sum(count).alias(count))
    if not by:
        keyed = keyed.withColumn("_all", F.lit(0))
    groups = list(by) or ["_all"]
    keys = [_SLICE, *groups]
    ordered = _sliced(keyed, [*(F.col(name) for name in groups), F.col(value)])
    here = ordered.groupBy(*keys).agg(F.sum(count).alias("_here"))
    whole = Window.partitionBy(*groups)
    earlier = whole.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    shifts = here.select(
        *keys,
        F.coalesce(F.sum("_here").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_here").over(whole).alias("_total"),
    )
    so_far = Window.partitionBy(*keys).orderBy(_AT)
    so_far = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = ordered.withColumn("_upto", F.sum(count).over(so_far))
    # Null-safe, as a group key may be null.
    placed = ordered.alias("o").join(
        shifts.alias("s"),
        on=[F.col(f"o.{name}").eqNullSafe(F.col(f"s.{name}")) for name in keys],
    )
    upto = F.col("_upto") + F.col("_before")
    picks = []
    for i, p in enumerate(probabilities.values()):
        at = F.lit(p) * (F.col("_total") - 1)
        low = F.min(F.when(upto > F.floor(at), F.col(f"o.{value}")))
        high = F.min(F.when(upto > F.ceil(at), F.col(f"o.{value}")))
        picks += [low.alias(f"_low{i}"), high.alias(f"_high{i}")]
    picked = placed.groupBy(*(F.col(f"o.{name}").alias(name) for name in groups)).agg(
        F.max("_total").alias("_total"), *picks
    )
    results = []
    for i, (name, p) in enumerate(probabilities.items()):
        at = F.lit(p) * (F.col("_total") - 1)
        low, high = F.col(f"_low{i}").cast("double"), F.col(f"_high{i}").cast("double")
        results.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return picked.select(*by, *results)
