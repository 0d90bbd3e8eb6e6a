"""Versions of a clean table that reload only the source files that changed.

A store is a folder with ``rows/load=<name>/file=<key>``, the clean rows of each source file that
a load read, and ``manifests/version=<n>``, one file with a row for each source file of that
version: what it was when it was read, where its rows are, and how many of them break each rule.
A load parses the text of new and changed files once. The pass that writes their clean rows also
marks each row with the rules that it breaks and observes which rules any row breaks, so that the
gate knows when the rows are written; counts for each file are then read from the marks alone. Counts of all files are added up, and only uniqueness
looks at the keys of all rows. The manifest is written last, so a version is there as a whole or
not at all, and a refused source leaves the version before as it was.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rollbook.contract import Check, Contract, Unique, prepare, source
from rollbook.functions.numbers import number_key
from rollbook.operators.clean import clean
from rollbook.operators.validate import (
    ContractViolation,
    Report,
    duplicated_values,
    numbered,
    report_of,
    vocabulary_previews,
)
from rollbook.sources.delimited import read_raw
from rollbook.sources.files import Paths, changes, fingerprints, manifest, plain_path
from rollbook.staging import compiled_methods

#: Rules whose marks share one column of 64 bits.
MARKS = 62
_FILE = "_file"


@dataclass(frozen=True)
class Version:
    """A version of the clean table: its number, rows, gate report, and source files.

    ``read`` is the number of source files that this load parsed.
    """

    number: int
    full: DataFrame
    report: Report
    files: DataFrame
    read: int


def _checks(contract: Contract) -> list[tuple[int, Check]]:
    return [(seq, rule) for seq, rule in numbered(contract) if isinstance(rule, Check)]


def _unique(contract: Contract) -> list[Unique]:
    return [rule for _, rule in numbered(contract) if isinstance(rule, Unique)]


def _identity(contract: Contract) -> str:
    """Tells whether two contracts check and clean alike."""
    rules = [(seq, type(rule).__name__, rule.code, rule.column, rule.message) for seq, rule in numbered(contract)]
    shape = (contract.renames, contract.integers, contract.upper, contract.padded)
    shape += (contract.sentinels, contract.mappings, contract.flags, contract.points)
    return f"{rules!r} {shape!r}"


def _key(path: Column) -> Column:
    return F.lower(F.hex(F.xxhash64(path)))


def checked(raw: DataFrame, contract: Contract, keep: tuple[str, ...] = ()) -> DataFrame:
    """Clean rows with ``_broken<i>``, a bit for each check a row fails, and its unique keys."""
    ready = prepare(raw, contract, keep)
    extra = {}
    checks = _checks(contract)
    for i in range(0, len(checks), MARKS):
        bits = [
            F.when(check.failing, F.lit(1 << at).cast("long")).otherwise(F.lit(0).cast("long"))
            for at, (_, check) in enumerate(checks[i : i + MARKS])
        ]
        total = bits[0]
        for bit in bits[1:]:
            total = total.bitwiseOR(bit)
        extra[f"_broken{i // MARKS}"] = total
    for i, rule in enumerate(_unique(contract)):
        for j, part in enumerate(number_key(source(rule.column))):
            extra[f"_key{i}_{j}"] = part
    return clean(ready.withColumns(extra), contract, validate=False, keep=(*keep, *extra))


def _rule_counts(contract: Contract) -> list[Column]:
    """Rows that fail each check, from the marks."""
    return [
        F.count_if(F.col(f"_broken{i // MARKS}").bitwiseAND(F.lit(1 << i % MARKS)) != 0)
        for i in range(len(_checks(contract)))
    ]


def latest(spark: SparkSession, store: str) -> tuple[int, DataFrame] | None:
    """Number and manifest of the newest version of a store, if there is one."""
    try:
        manifests = spark.read.parquet(f"{store}/manifests")
    except AnalysisException:
        return None
    number = manifests.agg(F.max("version")).first()[0]
    return number, manifests.where(F.col("version") == number)


def _live(spark: SparkSession, store: str, files: DataFrame, schema: str, columns: list[str]) -> DataFrame:
    """The rows of the files in a manifest; loads of which no file is left are not read."""
    loads = [row[0] for row in files.select("load").distinct().collect()]
    rows = spark.read.schema(schema).parquet(f"{store}/rows").where(F.col("load").isin(loads))
    kept = files.select("load", F.col("key").alias(_FILE))
    return rows.join(kept, ["load", _FILE], "left_semi").select(*columns)


def load_version(
    spark: SparkSession, path: str, contract: Contract, store: str, multi_line: bool = False
) -> Version:
    """Bring a store up to date with its source files and return the version that holds them.

    Files that are as the newest version read them, by path, length and time, are not opened;
    if none changed and the contract is the same, that version is returned. Errors of any file,
    new or not, refuse the load (:class:`ContractViolation`); warnings are in the report. One
    load at a time may write to a store.
    """
    listed = manifest(spark, path, contract.provenance)
    before = latest(spark, store)
    schema, columns = _schema(spark, contract)
    number, kept, todo, read = 1, None, path, None
    if before is not None:
        number, saved = before[0] + 1, before[1]
        if saved.where(F.col("contract") != _identity(contract)).isEmpty():
            changed = changes(listed, saved.select("path", "length", "modified"))
            found = [(r["path"], r["change"]) for r in changed.collect()]
            if not found:
                report = _report(spark, store, contract, saved, schema)
                return Version(before[0], _live(spark, store, saved, schema, columns), report, saved, 0)
            gone = spark.createDataFrame([(p,) for p, _ in found], "path string")
            kept = saved.join(gone, "path", "left_anti").drop("version")
            todo = [p for p, change in found if change != "removed"]
            read = listed.join(gone, "path", "left_semi")
    load = uuid.uuid4().hex
    files, opened = kept, 0
    if todo:
        new = _written(spark, todo, contract, f"{store}/rows/load={load}", multi_line)
        read = listed if read is None else read
        new = read.withColumn("key", _key(F.col("path"))).join(new, "key", "left")
        zeros = F.array_repeat(F.lit(0).cast("long"), len(_checks(contract)))
        new = new.withColumns(
            {
                "load": F.lit(load),
                "rows": F.coalesce("rows", F.lit(0).cast("long")),
                "counts": F.coalesce("counts", zeros),
                "contract": F.lit(_identity(contract)),
            }
        )
        digests = fingerprints(spark, todo).select("path", "sha256")
        new = new.join(digests, "path", "left")
        files = new if kept is None else kept.unionByName(new)
        opened = len(todo) if isinstance(todo, list) else listed.count()
    # One file, so that a version appears at once; computed before the gate, kept after it.
    staged = f"{store}/pending/{load}"
    files.coalesce(1).write.parquet(staged)
    files = spark.read.parquet(staged)
    report = _report(spark, store, contract, files, schema, todo, multi_line)
    target = f"{store}/manifests/version={number}"
    files.coalesce(1).write.mode("overwrite").parquet(target)
    final = spark.read.schema(files.schema).parquet(target)
    return Version(number, _live(spark, store, final, schema, columns), report, final, opened)


def _schema(spark: SparkSession, contract: Contract) -> tuple[str, list[str]]:
    """Schema of stored rows, the folders' columns last, and the columns of the clean table."""
    names = ", ".join(f"`{name}` string" for name in contract.columns)
    empty = checked(spark.createDataFrame([], names), contract)
    columns = [name for name in empty.columns if not name.startswith(("_broken", "_key"))]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in empty.schema)
    return f"{fields}, load string, {_FILE} string", columns


def _written(spark: SparkSession, path: Paths, contract: Contract, target: str, multi_line: bool) -> DataFrame:
    """Write clean rows of the files; key, rows and counts of each file that has rows."""
    own = _key(plain_path(F.col("_metadata.file_path")))
    keyed = read_raw(spark, path, contract, multi_line).select("*", own.alias(_FILE))
    # Which rules any row breaks is seen in the write; how many rows do, is read from the marks.
    seen = Observation(f"load-{uuid.uuid4().hex}")
    checks = _checks(contract)
    masks = [f"_broken{i}" for i in range(-(-len(checks) // MARKS))]
    with compiled_methods(spark):
        rows = checked(keyed, contract, keep=(_FILE,)).observe(
            seen, F.count(F.lit(1)).alias("n"), *(F.bit_or(name).alias(name) for name in masks)
        )
        rows.write.partitionBy(_FILE).parquet(target)
    found = seen.get
    counts = _rule_counts(contract)
    stored = spark.read.schema(rows.schema).parquet(target)
    if any(
        check.severity == "error" and (found[masks[i // MARKS]] or 0) >> i % MARKS & 1
        for i, (_, check) in enumerate(checks)
    ):
        bad = stored.agg(*(c.alias(f"n{i}") for i, c in enumerate(counts))).first()
        fixed = {seq: bad[f"n{i}"] for i, (seq, _) in enumerate(checks)}
        raise ContractViolation(_explained(spark, path, contract, found["n"], fixed, {}, multi_line))
    return stored.groupBy(F.col(_FILE).alias("key")).agg(
        F.count(F.lit(1)).alias("rows"), F.array(*counts).alias("counts")
    )


def _explained(spark, path, contract, rows, counts, repeats, multi_line) -> Report:
    """The report of counts, with the first values outside the vocabularies if there are any."""
    report = report_of(contract, rows, counts, repeats)
    if any(issue.code == "unexpected_category" for issue in report.issues):
        raw = read_raw(spark, path, contract, multi_line, check=False)
        shown = {r["column"]: r["preview"] for r in vocabulary_previews(raw, contract).collect()}
        report = report_of(contract, rows, counts, repeats, shown)
    return report


def _report(
    spark: SparkSession,
    store: str,
    contract: Contract,
    files: DataFrame,
    schema: str,
    path: Paths | None = None,
    multi_line: bool = False,
) -> Report:
    """Merge the files' counts; look for repeated keys among all rows if some were read now."""
    checks = _checks(contract)
    sums = [F.coalesce(F.sum(F.col("counts")[i]), F.lit(0)).alias(f"n{i}") for i in range(len(checks))]
    row = files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), *sums).first()
    counts = {seq: row[f"n{i}"] for i, (seq, _) in enumerate(checks)}
    repeats = {}
    for i, (seq, rule) in enumerate((s, r) for s, r in numbered(contract) if isinstance(r, Unique)):
        if path is not None:
            parts = [f"_key{i}_0", f"_key{i}_1"]
            keys = _live(spark, store, files, schema, parts)
            repeats[seq] = duplicated_values(keys, [F.col(x) for x in parts]).first()[0]
    report = report_of(contract, row["n"], counts, repeats)
    if not report.is_valid:
        raise ContractViolation(report)
    return report
