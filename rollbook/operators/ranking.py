"""Rankings of counted groups with shares, cumulative shares and full identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.text import fold
from rollbook.functions.numbers import share
from rollbook.operators.guards import need_positive
from rollbook.operators.ordering import number_rows
from rollbook.staging import Staged

THRESHOLDS = (0.5, 0.75, 0.9)


def regroup(cells: Staged, names: Sequence[str], present: Sequence[str]) -> Staged:
    """Sum counts over fewer columns, without rows null in ``present``.

    The result has at most the rows of ``cells``, so its bound carries over.
    """
    kept = cells.frame.dropna(subset=list(present))
    return Staged(kept.groupBy(*names).agg(F.sum("count").alias("count")), cells.rows)


def ranking_order(names: Sequence[str]) -> list[Column]:
    """Largest first, then the names in turn, ignoring case; raw names make the order total."""
    return [
        F.desc("count"),
        *(fold(F.col(name)).asc() for name in names),
        *(F.col(name).asc() for name in names),
    ]


def rank_counts(
    counts: Staged, order_names: Sequence[str], total: int, label: Column
) -> DataFrame:
    """``rank, label, <groups>, count, share, cumulative_share``, complete.

    Shares are of ``total``; the cumulative share rounds the running count, it does not add up
    rounded shares.
    """
    groups = [name for name in counts.frame.columns if name != "count"]
    numbered = number_rows(counts, ranking_order(order_names), {"running": "count"})
    return numbered.select(
        "rank",
        label.alias("label"),
        *groups,
        "count",
        share(F.col("count"), F.lit(total)).alias("share"),
        share(F.col("running"), F.lit(total)).alias("cumulative_share"),
    )


def top_counts(counts: Staged, order_names: Sequence[str], limit: int) -> Staged:
    """The largest groups only: a distributed top-n, so a complete ranking is never built."""
    need_positive(limit, "limit")
    top = counts.frame.orderBy(*ranking_order(order_names)).limit(limit)
    return Staged(top, min(limit, counts.rows))


def leaders(counts: Staged, order_names: Sequence[str], limit: int) -> DataFrame:
    """``position`` from 1 and the name of the ``limit`` largest groups of one column.

    The first ``limit`` rows of all tasks are merged before they are numbered, in one task.
    """
    (name,) = (c for c in counts.frame.columns if c != "count")
    top = top_counts(counts, order_names, limit).frame
    order = Window.orderBy(*ranking_order(order_names))
    return top.select(F.row_number().over(order).alias("position"), name)


def top_n(ranking: DataFrame, limit: int) -> DataFrame:
    need_positive(limit, "limit")
    return ranking.filter(F.col("rank") <= limit)


def headline(ranking: DataFrame, top: int = 10) -> DataFrame:
    """One row: number of groups, leader, its count and share, and the share of the top groups.

    The leader and the top share need the first ranks only; the rounded shares are summed.
    """
    first = F.col("rank") == 1
    return ranking.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.max(F.when(first, F.col("label"))).alias("leader"),
        F.max(F.when(first, F.col("count"))).alias("leader_count"),
        F.max(F.when(first, F.col("share"))).alias("leader_share"),
        F.bround(F.sum(F.when(F.col("rank") <= top, F.col("share"))), 6).alias("top_share"),
    )


def threshold_ranks(
    ranking: DataFrame, thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """First rank at which the cumulative share reaches each threshold; null if it never does."""
    reached = ranking.agg(
        *(
            F.min(F.when(F.col("cumulative_share") >= t, F.col("rank"))).alias(f"t{i}")
            for i, t in enumerate(thresholds)
        )
    )
    rows = [
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("rank"))
        for i, t in enumerate(thresholds)
    ]
    return reached.select(F.inline(F.array(*rows)))


def pair_label(inner: str, outer: str, between: str) -> Column:
    return F.concat(F.col(inner), F.lit(between), F.col(outer))
