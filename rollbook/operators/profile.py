"""Completeness, cardinality and duplicates of a whole, unfiltered table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.numbers import rate
from rollbook.functions.text import fold
from rollbook.operators.guards import need_columns

# The kinds of values a profile tells apart, with the type that holds each.
KINDS = {"text": "string", "whole": "bigint", "real": "double"}

# Text of this many bytes is profiled by its digest, which is exactly as long in hexadecimal:
# shorter text can never look like one, and no value moves with more bytes than this.
LONG_TEXT = 64


@dataclass(frozen=True)
class QualityColumns:
    """Columns the quality metrics are about."""

    key: str
    measure: str
    longitude: str
    latitude: str
    home_flag: str

    @property
    def names(self) -> list[str]:
        return [self.key, self.measure, self.longitude, self.latitude, self.home_flag]


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """``position, column, n_rows, missing_count, missing_rate, unique_count`` per column.

    Exact: all columns in one scan, counted per value before the shuffle; the shuffle is keyed by
    column and value, so neither a wide column nor a dominant value lands in one task.
    ``approximate`` replaces the distinct counts by sketches and needs no shuffle of values.
    """
    if approximate:
        profile = _sketched(df)
    else:
        present = reduce(or_, (F.col(kind).isNotNull() for kind in KINDS))
        counts = _typed_counts(df).withColumn("present", present)
        profile = counts.groupBy("column").agg(
            F.sum("count").alias("n_rows"),
            F.sum(F.when(F.col("present"), 0).otherwise(F.col("count"))).alias("missing_count"),
            F.count_if("present").alias("unique_count"),
        )
    names = F.array(*(F.lit(name) for name in df.columns))
    return profile.select(
        F.array_position(names, F.col("column")).alias("position"),
        "column",
        "n_rows",
        "missing_count",
        rate(F.col("missing_count"), F.col("n_rows")).alias("missing_rate"),
        "unique_count",
    )


def _typed(c: Column, kind: T.DataType) -> dict[str, Column]:
    """The value in the one column of its kind, so that numbers need not become text."""
    match kind:
        case T.DateType():
            return {"whole": F.unix_date(c).cast("bigint")}
        case T.TimestampType():
            return {"whole": F.unix_micros(c)}
        case T.BooleanType() | T.IntegralType():
            return {"whole": c.cast("bigint")}
        case T.FloatType() | T.DoubleType():
            return {"real": c.cast("double")}
        case _:
            text = c.cast("string")
            long = F.octet_length(text) >= LONG_TEXT
            return {"text": F.when(long, F.sha2(text, 256)).otherwise(text)}


def _typed_counts(df: DataFrame) -> DataFrame:
    """``column, text, whole, real, count``: every value of every column with its count."""
    wide, sets = [], []
    for i, field in enumerate(df.schema):
        values = _typed(F.col(f"`{field.name}`"), field.dataType)
        wide += [
            values.get(kind, F.lit(None)).cast(t).alias(f"{kind}{i}") for kind, t in KINDS.items()
        ]
        sets.append(f"({', '.join(f'{kind}{i}' for kind in KINDS)}) AS `{field.name}`")
    long = df.sparkSession.sql(
        f"SELECT * FROM {{wide}} UNPIVOT INCLUDE NULLS "
        f"(({', '.join(KINDS)}) FOR column IN ({', '.join(sets)}))",
        wide=df.select(*wide),
    )
    return long.groupBy("column", *KINDS).agg(F.count(F.lit(1)).alias("count"))


def _sketched(df: DataFrame) -> DataFrame:
    aggregates = [F.count(F.lit(1)).alias("n")]
    entries = []
    for i, name in enumerate(df.columns):
        c = F.col(f"`{name}`")
        aggregates += [
            F.count_if(c.isNull()).alias(f"m{i}"),
            F.approx_count_distinct(c).alias(f"u{i}"),
        ]
        entries.append(
            F.struct(
                F.lit(name).alias("column"),
                F.col("n").alias("n_rows"),
                F.col(f"m{i}").alias("missing_count"),
                F.col(f"u{i}").alias("unique_count"),
            )
        )
    return df.agg(*aggregates).filter(F.col("n") > 0).select(F.inline(F.array(*entries)))


def missingness(profile: DataFrame) -> DataFrame:
    """Columns by missing rate, then case-insensitive name."""
    return profile.select(
        "column",
        "missing_count",
        "missing_rate",
        (F.col("n_rows") - F.col("missing_count")).alias("populated_count"),
    ).orderBy(F.desc("missing_rate"), fold(F.col("column")), "column")


def row_digest(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 of a row of ``df``, by default of all its columns.

    Lengths are part of the text, so different rows give different text. Zero has no sign.
    """
    types = dict(df.dtypes)
    parts = []
    for name in columns or df.columns:
        value = F.col(f"`{name}`")
        if types[name] in ("float", "double"):
            value = F.when(value == 0, F.lit(0).cast(types[name])).otherwise(value)
        text = value.cast("string")
        sized = F.concat(F.length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(sized, F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _extras(keyed: DataFrame, name: str) -> DataFrame:
    """Rows beyond the first of each key; null is a key like any other."""
    counts = keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(name))


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row. Only 32 bytes per distinct row are shuffled."""
    digests = df.select(row_digest(df, columns).alias("digest"))
    return _extras(digests, "exact_duplicate_rows")


def duplicate_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that repeat an earlier key, compared as text."""
    need_columns(df, columns)
    return _extras(df.select(*columns), "duplicate_keys")


def table_metrics(
    df: DataFrame, columns: QualityColumns, missing_rates: Sequence[str] = ()
) -> DataFrame:
    """One row of counts and rates; one scan of the columns concerned and no shuffle of rows.

    ``missing_rates`` adds a ``missing_rate.<column>`` for each name.
    """
    need_columns(df, [*columns.names, *missing_rates])
    located = F.col(columns.longitude).isNotNull() & F.col(columns.latitude).isNotNull()
    counts = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col(columns.measure).isNull()).alias("unknown_range_count"),
        F.count_if(located).alias("complete_coordinate_count"),
        F.count_if(F.col(columns.home_flag)).alias("washington_vehicle_count"),
        *(F.count_if(F.col(name).isNull()).alias(f"missing.{name}") for name in missing_rates),
    )
    rows = F.col("row_count")
    return counts.select(
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        "unknown_range_count",
        rate(F.col("unknown_range_count"), rows).alias("unknown_range_rate"),
        "complete_coordinate_count",
        rate(F.col("complete_coordinate_count"), rows).alias("complete_coordinate_rate"),
        "washington_vehicle_count",
        rate(F.col("washington_vehicle_count"), rows).alias("washington_share"),
        *(
            rate(F.col(f"`missing.{name}`"), rows).alias(f"missing_rate.{name}")
            for name in missing_rates
        ),
    )


def dictionary_conformance(df: DataFrame, contract, profile: DataFrame | None = None) -> DataFrame:
    """Compare the data dictionary with the schema and the nulls found.

    One row per column known to either side: ``column, source, expected_type, nullable,
    description, actual_type, missing_count, status``.
    """
    spark = df.sparkSession
    nulls = profile if profile is not None else _null_counts(df)
    fields = F.array(
        *(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.source).alias("source"),
                F.lit(f.type).alias("expected_type"),
                F.lit(f.nullable).alias("nullable"),
                F.lit(f.description).alias("description"),
            )
            for f in contract.dictionary
        )
    )
    types = F.array(
        *(
            F.struct(
                F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("actual_type")
            )
            for f in df.schema
        )
    )
    documented = spark.range(1).select(F.inline(fields))
    actual = spark.range(1).select(F.inline(types))
    joined = documented.join(actual, "column", "full").join(
        nulls.select("column", "missing_count"), "column", "left"
    )
    status = (
        F.when(F.col("actual_type").isNull(), "missing")
        .when(F.col("expected_type").isNull(), "undocumented")
        .when(F.col("actual_type") != F.col("expected_type"), "wrong type")
        .when(~F.col("nullable") & (F.col("missing_count") > 0), "unexpected nulls")
        .otherwise("ok")
    )
    return joined.withColumn("status", status)


def _null_counts(df: DataFrame) -> DataFrame:
    counts = df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns))
    return counts.unpivot([], [f"`{c}`" for c in df.columns], "column", "missing_count")
