"""Checks of what an analysis is given, and their outcomes as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession


class MissingColumns(ValueError):
    """Required columns are absent."""


class EmptyInput(ValueError):
    """An analysis got no rows, or no values in a column it cannot do without."""


def need_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise MissingColumns(f"Missing columns: {', '.join(missing)}")


def need_positive(value: int | None, what: str) -> None:
    if value is not None and (not isinstance(value, int) or value <= 0):
        raise ValueError(f"{what} must be a positive integer.")


def need_some(count: int | None, what: str) -> None:
    """Refuse a zero taken from an aggregate that was computed anyway."""
    if not count:
        raise EmptyInput(f"No {what} in the input.")


def outcomes(spark: SparkSession, cases: Mapping[str, Callable[[], object]]) -> DataFrame:
    """``case, passed, error, message``: what each guarded call does with its input.

    A refusal is a row with the error's name and message. Only refusals (:class:`ValueError` and
    what derives from it) become rows; other errors are raised.
    """
    rows = []
    for case, call in cases.items():
        try:
            call()
            rows.append((case, True, None, None))
        except ValueError as error:
            rows.append((case, False, type(error).__name__, str(error)))
    return spark.createDataFrame(rows, "case string, passed boolean, error string, message string")
