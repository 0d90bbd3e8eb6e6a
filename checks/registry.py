"""Named queries, each with the SQL another engine answers it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.fixtures import BROKEN_CTE, CLEAN_CTES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice.")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def on_clean(select: str, *ctes: str) -> str:
    """SQL over ``registration`` and ``clean``."""
    return "WITH " + ",\n".join([CLEAN_CTES.strip(), *ctes]) + "\n" + select


def on_broken(select: str) -> str:
    return "WITH " + BROKEN_CTE.strip() + "\n" + select
