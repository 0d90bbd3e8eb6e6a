"""Count contract violations; rows are never dropped.

All row conditions are counted in one aggregate: one scan, partial sums on the map side and
one row out. Uniqueness is the only rule that shuffles values, and does so after partial
counting. The first unexpected values of a vocabulary are looked up in a third pass that the
gate runs only when there are any.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.contract import ERROR, WARNING, Check, Contract, OneOf, Unique, prepare, source
from rollbook.functions.numbers import number_key
from rollbook.functions.text import present, quoted
from rollbook.staging import together

# Messages of the two issues that end the checks, and the issue columns.
WRONG_COLUMNS = "Columns or column order do not match the documented source schema."
NO_ROWS = "The source file contains no data rows."
ISSUE = {
    "seq": "int",
    "severity": "string",
    "code": "string",
    "column": "string",
    "message": "string",
    "n_rows": "bigint",
}
PREVIEW = 5


def numbered(contract: Contract) -> list[tuple[int, Check | Unique]]:
    """Rules expanded to single checks, numbered in reporting order from 1."""
    flat: list[Check | Unique] = []
    for rule in contract.rules:
        flat.extend([rule] if isinstance(rule, Unique) else rule.checks())
    return list(enumerate(flat, start=1))


def _counts(df: DataFrame, contract: Contract) -> DataFrame:
    """One row: ``n`` rows and ``n<seq>`` bad rows per condition; one scan, no shuffle of rows."""
    return prepare(df, contract).agg(
        F.count(F.lit(1)).alias("n"),
        *(
            F.count_if(check.failing).alias(f"n{seq}")
            for seq, check in numbered(contract)
            if isinstance(check, Check)
        ),
    )


def duplicated_values(df: DataFrame, key: Sequence[Column]) -> DataFrame:
    """Number of rows that share their key with another row, all of them counted.

    A key that is null in every part is no key. Equal keys are counted before they move.
    """
    parts = [f"k{i}" for i in range(len(key))]
    keyed = df.select(*(c.alias(name) for c, name in zip(key, parts, strict=True)))
    counts = keyed.dropna("all").groupBy(*parts).count()
    return counts.agg(
        F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("n_rows")
    )


def vocabulary_previews(df: DataFrame, contract: Contract, limit: int = PREVIEW) -> DataFrame:
    """First values outside each vocabulary, in order: ``column, preview``."""
    rules = [rule for rule in contract.rules if isinstance(rule, OneOf)]
    stripped = df.select(*(present(source(rule.column)).alias(rule.column) for rule in rules))
    entries = [
        F.struct(
            F.lit(rule.column).alias("column"),
            F.when(rule.outside(), source(rule.column)).alias("value"),
        )
        for rule in rules
    ]
    values = stripped.select(F.inline(F.array(*entries)))
    values = values.filter(F.col("value").isNotNull()).distinct()
    # The rank filter keeps at most `limit` rows per column on the map side, whatever the number
    # of values, so the list below is bounded.
    order = Window.partitionBy("column").orderBy("value")
    first = values.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return first.groupBy("column").agg(
        F.array_join(F.sort_array(F.collect_list(quoted(F.col("value")))), ", ").alias("preview")
    )


def _wrong_columns(df: DataFrame, contract: Contract) -> list[tuple]:
    if tuple(df.columns) == contract.columns:
        return []
    return [(0, ERROR, "invalid_columns", None, WRONG_COLUMNS, None)]


def _literal(row: tuple) -> list[Column]:
    return [F.lit(x).cast(t).alias(n) for x, (n, t) in zip(row, ISSUE.items(), strict=True)]


def issue_counts(df: DataFrame, contract: Contract) -> DataFrame:
    """Issue rows ``seq, severity, code, column, message, n_rows`` without value previews."""
    wrong = _wrong_columns(df, contract)
    if wrong:
        return df.sparkSession.range(1).select(*_literal(wrong[0]))

    rules = numbered(contract)
    checks = [(seq, check) for seq, check in rules if isinstance(check, Check)]
    fixed = [(0, ERROR, "empty_dataset", None, NO_ROWS)]
    fixed += [(seq, c.severity, c.code, c.column, c.message) for seq, c in checks]
    # The fixed part of all rows is one literal, picked by position.
    described = F.from_json(
        F.lit(json.dumps([dict(zip(ISSUE, row, strict=False)) for row in fixed])),
        "array<struct<" + ", ".join(f"`{n}`: {t}" for n, t in ISSUE.items()) + ">>",
    )
    rows = F.array(F.when(F.col("n") == 0, 1), *(f"n{seq}" for seq, _ in checks))
    hit = F.transform(described, lambda d, i: d.withField("n_rows", F.get(rows, i)))
    issues = _counts(df, contract).select(F.inline(F.filter(hit, lambda d: d["n_rows"] > 0)))
    issues = issues.withColumn("n_rows", F.when(F.col("seq") > 0, F.col("n_rows")))

    for seq, rule in rules:
        if isinstance(rule, Unique):
            found = duplicated_values(df, number_key(source(rule.column))).filter("n_rows > 0")
            fixed = _literal((seq, ERROR, rule.code, rule.column, rule.message, None))
            issues = issues.unionByName(found.select(*fixed[:-1], "n_rows"))
    return issues


def issues(df: DataFrame, contract: Contract) -> DataFrame:
    """Issue rows in reporting order, with the first unexpected values in their messages."""
    counts = issue_counts(df, contract)
    if tuple(df.columns) == contract.columns and any(
        isinstance(rule, OneOf) for rule in contract.rules
    ):
        previews = vocabulary_previews(df, contract).withColumn(
            "code", F.lit("unexpected_category")
        )
        message = F.when(
            F.col("preview").isNotNull(), F.concat("message", F.lit(": "), "preview", F.lit("."))
        ).otherwise(F.col("message"))
        counts = (
            counts.join(previews, ["column", "code"], "left")
            .withColumn("message", message)
            .select(*ISSUE)
        )
    return counts.orderBy("seq")


def outside_vocabulary(df: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """Values that a vocabulary table lacks, with their row counts.

    Values are counted before the anti join, so a value that fills a third of the table is one
    row by then. Spark broadcasts the vocabulary only if it measures small.
    """
    counts = (
        df.select(present(source(column)).alias("value")).dropna().groupBy("value").count()
    )
    known = vocabulary.toDF("value").distinct()
    return counts.join(known, "value", "left_anti")


def report_text(issue_rows: DataFrame) -> DataFrame:
    """One line per issue: ``[code] message (n rows)``."""
    rows = F.concat(F.lit(" ("), F.format_number("n_rows", 0), F.lit(" rows)"))
    line = F.concat(
        F.lit("["), "code", F.lit("] "), "message", F.coalesce(rows, F.lit(""))
    )
    return issue_rows.select("seq", "severity", line.alias("line"))


def verdict(issue_rows: DataFrame) -> DataFrame:
    """One row: number of errors and warnings, and whether the source may be used."""
    errors = F.count_if(F.col("severity") == ERROR)
    return issue_rows.agg(
        errors.alias("n_errors"),
        F.count_if(F.col("severity") == WARNING).alias("n_warnings"),
        (errors == 0).alias("is_valid"),
    )


class Issue(NamedTuple):
    """One row of an issue table."""

    seq: int
    severity: str
    code: str
    column: str | None
    message: str
    n_rows: int | None


@dataclass(frozen=True)
class Report:
    """Collected issues, at most one per condition of the contract."""

    issues: tuple[Issue, ...]

    @property
    def errors(self) -> tuple[Issue, ...]:
        return tuple(row for row in self.issues if row.severity == ERROR)

    @property
    def warnings(self) -> tuple[Issue, ...]:
        return tuple(row for row in self.issues if row.severity == WARNING)

    @property
    def is_valid(self) -> bool:
        return not self.errors


def line_of(row: Issue) -> str:
    """The text form of a collected issue; a fixed form, as in :func:`report_text`."""
    suffix = "" if row.n_rows is None else f" ({row.n_rows:,} rows)"
    return f"[{row.code}] {row.message}{suffix}"


class ContractViolation(ValueError):
    """Blocking rules are broken: the message counts and names them, ``report`` has the rest."""

    def __init__(self, report: Report) -> None:
        broken = [f"{issue.column or 'table'}: {issue.code}" for issue in report.errors]
        super().__init__(f"{len(broken)} blocking rules are broken ({'; '.join(broken)})")
        self.report = report


def validate(df: DataFrame, contract: Contract) -> Report:
    """Run the checks now: one wide count, one count of repeated keys per unique column.

    The preview pass runs only if a vocabulary was left.
    """
    found = _wrong_columns(df, contract)
    if found:
        return Report(tuple(Issue(*row) for row in found))
    rules = numbered(contract)
    unique = {seq: rule.column for seq, rule in rules if isinstance(rule, Unique)}
    keys = [duplicated_values(df, number_key(source(name))) for name in unique.values()]
    counts, *repeats = together(_counts(df, contract).first, *(key.first for key in keys))
    found = {seq: counts[f"n{seq}"] for seq, rule in rules if isinstance(rule, Check)}
    repeated = {seq: row[0] for seq, row in zip(unique, repeats, strict=True)}
    report = report_of(contract, counts["n"], found, repeated)
    if any(issue.code == "unexpected_category" for issue in report.issues):
        shown = {row["column"]: row.preview for row in vocabulary_previews(df, contract).collect()}
        report = report_of(contract, counts["n"], found, repeated, shown)
    return report


def report_of(
    contract: Contract,
    rows: int,
    counts: dict[int, int],
    repeats: dict[int, int],
    previews: dict[str, str] | None = None,
) -> Report:
    """The report of bad rows for each check, and of repeated keys for each unique rule, by seq.

    ``previews`` has the first values outside each column's vocabulary.
    """
    if rows == 0:
        return Report((Issue(0, ERROR, "empty_dataset", None, NO_ROWS, None),))
    result = []
    for seq, rule in numbered(contract):
        unique = isinstance(rule, Unique)
        severity, n = (ERROR, repeats.get(seq, 0)) if unique else (rule.severity, counts[seq])
        message = rule.message
        if rule.code == "unexpected_category" and rule.column in (previews or {}):
            message = f"{message}: {previews[rule.column]}."
        if n:
            result.append(Issue(seq, severity, rule.code, rule.column, message, n))
    return Report(tuple(result))


def gate(df: DataFrame, contract: Contract) -> Report:
    """Validate and refuse a source with errors; warnings pass."""
    report = validate(df, contract)
    if not report.is_valid:
        raise ContractViolation(report)
    return report
