from contextlib import contextmanager

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from rollbook.operators.ordering import number_rows, quantiles
from rollbook.staging import Staged, stage

#: Without adaptive execution, small slices are not merged.
SMALL_SLICES = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "7"}


@contextmanager
def settings(spark, values):
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@pytest.fixture(scope="module")
def counts(spark):
    """5,000 groups; a third of them share one count."""
    df = spark.range(5000).select(
        F.format_string("g%04d", F.col("id")).alias("name"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), 900) + 1).alias("count"),
    )
    return stage(df)


def test_ranks_and_running_totals(spark, counts):
    order = [F.desc("count"), F.asc("name")]
    found = number_rows(counts, order, {"upto": "count"}).toPandas()
    expected = counts.frame.toPandas().sort_values(
        ["count", "name"], ascending=[False, True], ignore_index=True
    )
    expected["rank"] = expected.index + 1
    expected["upto"] = expected["count"].cumsum()
    found = found.sort_values("rank", ignore_index=True)[["name", "count", "rank", "upto"]]
    pd.testing.assert_frame_equal(found, expected, check_dtype=False)


def test_order_is_by_range(spark, counts):
    found = number_rows(counts, [F.desc("count"), F.asc("name")], {"upto": "count"})
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Only the slice totals may meet in one partition; the rows are windowed by slice.
    assert "windowspecdefinition(_slice" in plan
    assert plan.count("Exchange SinglePartition") == 1
    assert "BroadcastExchange" in plan


def test_quantiles_match_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(
        {
            "g": rng.choice(["a", "b", "c"], 3000, p=[0.8, 0.19, 0.01]),
            "v": np.where(rng.random(3000) < 0.3, np.nan, rng.integers(0, 400, 3000)),
        }
    )
    pdf.loc[pdf.g == "c", "v"] = np.nan
    df = spark.createDataFrame(
        [(g, None if np.isnan(v) else float(v)) for g, v in pdf.itertuples(index=False)],
        "g string, v double",
    )
    cells = stage(df.groupBy("g", F.col("v").alias("value")).agg(F.count("*").alias("count")))
    asked = {"low": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "high": 1.0}
    found = quantiles(cells, ["g"], "value", "count", asked).collect()
    expected = pdf.dropna().groupby("g")["v"].quantile(list(asked.values())).unstack()
    assert {r.g for r in found} == {"a", "b"}
    for row in found:
        assert np.allclose([row[name] for name in asked], expected.loc[row.g])


def test_a_hot_group_is_spread_over_slices(spark):
    df = spark.range(997).select(
        F.when(F.col("id") % 5 > 0, "a").otherwise("b").alias("g"),
        (F.pmod(F.xxhash64("id"), 100_000) / 1000).alias("value"),
        F.lit(1).alias("count"),
    )
    asked = {"p25": 0.25, "p50": 0.5, "p99": 0.99}
    one_slice = sorted(rows(quantiles(Staged(df, 997), ["g"], "value", "count", asked)))
    with settings(spark, SMALL_SLICES):
        found = quantiles(Staged(df, 997), ["g"], "value", "count", asked)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted(rows(found)) == one_slice
    # No single task orders the values, and a group is dealt out by slice too.
    assert "Exchange SinglePartition" not in plan
    assert "hashpartitioning(_slice" in plan
    values = df.toPandas()
    expected = values.groupby("g")["value"].quantile(list(asked.values())).unstack()
    assert [row[0] for row in one_slice] == list(expected.index)
    assert np.allclose([row[1:] for row in one_slice], expected.to_numpy())


def test_overall_quantile(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1), (2, 1), (4, 2), (NULL, 9) AS t(value, count)")
    cells = Staged(df, df.count())
    found = rows(quantiles(cells, [], "value", "count", {"m": 0.5}))
    assert found == [(3.0,)]
    none = Staged(df.filter("value IS NULL"), 1)
    assert rows(quantiles(none, [], "value", "count", {"m": 0.5})) == []


def test_null_groups_are_groups(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 1, 1), (NULL, 5, 1), (NULL, 6, 1) AS t(g, value, count)")
    found = rows(quantiles(Staged(df, 3), ["g"], "value", "count", {"m": 0.5}))
    assert sorted(found, key=str) == [("a", 1.0), (None, 5.5)]
