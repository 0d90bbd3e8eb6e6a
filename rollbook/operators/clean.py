"""Raw text rows to typed rows: one projection, no row added, dropped or merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.contract import Contract, source
from rollbook.functions.numbers import integer
from rollbook.functions.points import latitude, longitude
from rollbook.functions.text import matches, tidy
from rollbook.operators.validate import gate


def rename(df: DataFrame, contract: Contract, keep: tuple[str, ...] = ()) -> DataFrame:
    """Give every source column its clean name, in published order; ``keep`` follows as it is."""
    return df.select(*(source(old).alias(new) for old, new in contract.renames.items()), *keep)


def _labels(c: Column, labels: dict[str, str]) -> Column:
    """Label to code, null where unmapped."""
    result = F.lit(None).cast("string")
    for label, code in labels.items():
        result = F.when(c == label, F.lit(code)).otherwise(result)
    return result


def _base(name: str, contract: Contract) -> Column:
    raw = F.col(name)
    if name in contract.integers:
        return integer(raw)
    text = tidy(raw)
    if name in contract.upper:
        text = F.upper(text)
    if name in contract.padded:
        digits = rf"\d{{{contract.padded[name]}}}"
        text = F.when(matches(text, digits), F.concat(F.lit("0"), text)).otherwise(text)
    return text


def clean(
    df: DataFrame, contract: Contract, validate: bool = True, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The clean table: source columns under new names and types, then the derived columns.

    Pass ``validate=False`` for a source that has just gone through the gate. Columns to
    ``keep`` stay as they are, between the two.
    """
    if validate:
        gate(df, contract)
    typed = rename(df, contract, keep).select(
        *(_base(name, contract).alias(name) for name in contract.renames.values()), *keep
    )
    derived = {
        name: F.nullif(F.col(column), F.lit(missing))
        for name, (column, missing) in contract.sentinels.items()
    }
    for name, (column, labels) in contract.mappings.items():
        derived[name] = _labels(F.col(column), labels)
    for name, (column, value) in contract.flags.items():
        derived[name] = F.col(column) == value
    for column, (lon, lat) in contract.points.items():
        derived[lon] = longitude(F.col(column))
        derived[lat] = latitude(F.col(column))
    return typed.withColumns(derived)


def look_up(df: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    """Label to code through a table ``(label, code)``, for mappings too long for the contract.

    Unmapped labels give null. The join is a plain left join: Spark broadcasts the table if it
    measures small and otherwise shuffles, splitting skewed labels.
    """
    known = labels.toDF(column, name)
    return df.join(known, column, "left")
