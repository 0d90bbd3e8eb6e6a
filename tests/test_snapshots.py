"""Versions of a store: what is read again, what is refused, and digests of large files."""

import csv
import gzip
import hashlib
import os

import pytest
from conftest import ROWS
from pyspark.sql import functions as F

from checks import contract_queries, guard_queries
from rollbook.operators.validate import ContractViolation, gate
from rollbook.plans import snapshots
from rollbook.plans.snapshots import load_version
from rollbook.registration import RENAMES, registration_contract
from rollbook.sources import files
from rollbook.sources.delimited import read_raw
from rollbook.sources.files import SourceError

HEADER = list(RENAMES)


def write(path, *data, header=HEADER):
    with open(path, "w", encoding="utf-8", newline="") as target:
        csv.writer(target).writerows([header, *data])


def row(like=0, **cells):
    return tuple((dict(zip(RENAMES.values(), ROWS[like], strict=True)) | cells).values())


def ids(version):
    return sorted(r.dol_vehicle_id for r in version.full.collect())


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "in put+%"  # a path whose form Spark encodes
    folder.mkdir()
    write(folder / "a.csv", row(dol_vehicle_id="1"), row(1, dol_vehicle_id="2", county=""))
    write(folder / "b.csv", row(dol_vehicle_id="3"))
    return folder


def load(spark, contract, source, tmp_path):
    return load_version(spark, str(source), contract, str(tmp_path / "store"))


def test_unchanged_files_are_not_opened(spark, contract, source, tmp_path):
    first = load(spark, contract, source, tmp_path)
    assert (first.number, first.read, ids(first)) == (1, 2, ["1", "2", "3"])
    assert [(i.code, i.column, i.n_rows) for i in first.report.warnings] == [
        ("missing_optional_value", "County", 1)
    ]
    # Other bytes of the same length and time: reading them would fail the header check.
    path = source / "a.csv"
    times = path.stat()
    path.write_bytes(b"x" * times.st_size)
    os.utime(path, ns=(times.st_atime_ns, times.st_mtime_ns))
    again = load(spark, contract, source, tmp_path)
    assert (again.number, again.read, again.report) == (1, 0, first.report)
    assert ids(again) == ["1", "2", "3"]
    # Only the file that changes is parsed; counts of the other one are kept.
    write(source / "b.csv", row(dol_vehicle_id="4", county=""), row(dol_vehicle_id="5"))
    changed = load(spark, contract, source, tmp_path)
    assert (changed.number, changed.read, ids(changed)) == (2, 1, ["1", "2", "4", "5"])
    assert [i.n_rows for i in changed.report.warnings] == [2]
    path.unlink()
    removed = load(spark, contract, source, tmp_path)
    assert (removed.number, removed.read, ids(removed)) == (3, 0, ["4", "5"])
    assert {r.path.rsplit("/")[-1]: r.rows for r in removed.files.collect()} == {"b.csv": 2}


@pytest.mark.parametrize(
    "cells, code",
    [({"dol_vehicle_id": "01"}, "duplicate_vehicle_id"), ({"dol_vehicle_id": "7", RENAMES["Electric Vehicle Type"]: "Steam"}, "unexpected_category")],
)
def test_a_refused_file_leaves_the_version(spark, contract, source, tmp_path, cells, code):
    load(spark, contract, source, tmp_path)
    write(source / "c.csv", row(**cells))
    with pytest.raises(ContractViolation) as caught:
        load(spark, contract, source, tmp_path)
    (issue,) = caught.value.report.errors
    assert issue.code == code
    if code == "unexpected_category":
        assert issue.message.endswith("'Steam'.")
    (source / "c.csv").unlink()
    assert load(spark, contract, source, tmp_path).number == 1
    write(source / "c.csv", row(dol_vehicle_id="9"))
    assert ids(load(spark, contract, source, tmp_path)) == ["1", "2", "3", "9"]


def test_report_equals_the_gate_of_all_rows(spark, contract, source, tmp_path):
    write(source / "b.csv", row(dol_vehicle_id="3", state="wa", postal_code="12", vehicle_location="POINT (200 1)"))
    assert load(spark, contract, source, tmp_path).report == gate(read_raw(spark, str(source), contract), contract)


def test_another_contract_reads_all_again(spark, contract, source, tmp_path):
    load(spark, contract, source, tmp_path)
    later = load(spark, registration_contract(2031), source, tmp_path)
    assert (later.number, later.read) == (2, 2)


def test_empty_sources_are_refused(spark, contract, source, tmp_path):
    for name in ("a.csv", "b.csv"):
        write(source / name)
    with pytest.raises(ContractViolation, match="empty_dataset"):
        load(spark, contract, source, tmp_path)
    (source / "a.csv").write_bytes(b"")
    with pytest.raises(SourceError, match="without content"):
        load(spark, contract, source, tmp_path)


def tree(lines, fan_out):
    nodes = [hashlib.sha256(x).hexdigest() for x in lines]
    while len(nodes) > 1:
        nodes = [
            hashlib.sha256("".join(nodes[i : i + fan_out]).encode()).hexdigest()
            for i in range(0, len(nodes), fan_out)
        ]
    return nodes[0]


@pytest.mark.parametrize("split", ["1k", "128m"])
def test_tree_digest_at_any_split_size(spark, tmp_path, split):
    contents = {
        "one": b"x",
        "odd": bytes(range(256)) * 40,  # not text, with carriage returns
        "lines": b"".join(b"line %d\r\n" % (k * k) for k in range(900)),
        "blank": b"\n\n\n",
        "end": b"a\nb",
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = files.tree_fingerprints(spark, str(tmp_path), fan_out=7).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {}
    for name, content in contents.items():
        lines = content.split(b"\n")
        want[name] = lines[:-1] if content.endswith(b"\n") else lines
    assert {r.path.rsplit("/")[-1]: (r.lines, r.tree) for r in got} == {
        name: (len(lines), tree(lines, 7)) for name, lines in want.items()
    }


def test_large_files_have_no_plain_digest(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    (tmp_path / "b").write_bytes(b"abcdef")
    got = files.fingerprints(spark, str(tmp_path), whole_bytes=3).collect()
    assert {r.length: r.sha256 for r in got} == {3: hashlib.sha256(b"abc").hexdigest(), 6: None}


@pytest.mark.parametrize("split, batch", [("1k", 10_000), ("1k", 7), ("128m", 10_000), ("128m", 7)])
def test_plain_digest_of_lines_at_any_split_and_batch_size(spark, tmp_path, split, batch):
    contents = {
        "one": b"x",
        "odd é+%": bytes(range(256)) * 40,  # not text, with carriage returns
        "lines": b"".join(b"line %d\r\n" % (k * k) for k in range(900)),
        "long": b"".join(b"%d" % k * 4000 + b"\n" for k in range(90)),
        "blank": b"\n\n\n",
        "end": b"a\nb",
        "mark": b"\xef\xbb\xbfa\nb\n",
        "mark, end": b"\xef\xbb\xbfa\n\nb",
        "mark, blank": b"\xef\xbb\xbf\n",
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    sizes = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    before = {key: spark.conf.get(key) for key in sizes}
    try:
        for key, value in sizes.items():
            spark.conf.set(key, value)
        got = files.fingerprints(spark, str(tmp_path), whole_bytes=None).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sorted((r.length, r.sha256) for r in got) == sorted(
        (len(content), hashlib.sha256(content).hexdigest()) for content in contents.values()
    )
    listed = files.fingerprints(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, listed))


def test_digest_of_lines_refuses_compressed_files(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"a\nb\n"))
    with pytest.raises(Exception, match="bytes, but 4 in its lines"):
        files.fingerprints(spark, str(tmp_path), whole_bytes=None).collect()


@pytest.mark.parametrize("whole", [1, files.WHOLE_BYTES])
def test_plain_digest_of_documents_at_any_size(spark, monkeypatch, whole):
    docs = spark.range(0, 3000, 1, 3).selectExpr("2999 - id AS doc_id", "repeat('é', int(id % 9)) AS text", "nullif(id % 2, 0) || 'x' AS lang")
    monkeypatch.setattr(contract_queries, "table", lambda *_: docs)
    monkeypatch.setattr(files.fingerprints, "__defaults__", (whole,))
    (row,) = contract_queries.text_fingerprints(spark, "").collect()
    lines = [f"{i}:{'1x' if (2999 - i) % 2 else '-'}:{(2999 - i) % 9}" for i in range(3000)]
    content = "".join(f"{line}\n" for line in lines).encode()
    assert (row.length, row.sha256, row.lines) == (len(content), hashlib.sha256(content).hexdigest(), 3000)
    assert row.tree == tree([line.encode() for line in lines], 16)


@pytest.mark.parametrize(
    "line, names",
    [
        ("a,b", ["a", "b"]),
        (",b,", ["", "b", ""]),
        ('"a, ""x""",b', ['a, "x"', "b"]),
        ('"a",""', ["a", ""]),
        ("﻿a,b", ["a", "b"]),
        ('a,"b\nc",d', ["a", "b\n"]),
    ],
)
def test_first_line_is_split_in_the_jvm(spark, tmp_path, line, names):
    (tmp_path / "x.csv").write_text(f"{line}\n1,2\n", encoding="utf-8")
    found = files.headers(spark, str(tmp_path))
    assert found.first().names == names
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_a_load_runs_in_methods_that_the_jvm_compiles(spark, contract, source, tmp_path, monkeypatch):
    limit, seen = "spark.sql.codegen.hugeMethodLimit", []
    before, checked = spark.conf.get(limit), snapshots.checked

    def noted(raw, *given, **named):
        seen.append(int(spark.conf.get(limit)) if raw.columns[-1] == "_file" else None)
        return checked(raw, *given, **named)

    monkeypatch.setattr(snapshots, "checked", noted)
    assert ids(load(spark, contract, source, tmp_path)) == ["1", "2", "3"]
    assert [n for n in seen if n is not None] == [8000] and spark.conf.get(limit) == before


def test_lines_are_numbered_without_moving_them(spark, tmp_path):
    (tmp_path / "a").write_text("".join(f"{i}\n" for i in range(20_000)))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "20000")
    try:
        found = files.file_lines(spark, str(tmp_path))
        plan = found._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        got = dict(found.select("n", "digest").collect())
    finally:
        spark.conf.set(threshold, before)
    assert got == {i: hashlib.sha256(str(i).encode()).hexdigest() for i in range(20_000)}


def test_lines_of_one_file_are_made_by_all_tasks(spark, monkeypatch):
    docs = spark.range(0, 40, 1, 4).select(
        F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.spark_partition_id().cast("string").alias("lang")
    )
    monkeypatch.setattr(contract_queries, "table", lambda *_: docs)
    (row,) = contract_queries.text_fingerprints(spark, "").collect()
    content = "".join(f"{i}:{i // 10}:1\n" for i in range(40)).encode()
    assert (row.lines, row.length, row.sha256) == (40, len(content), hashlib.sha256(content).hexdigest())


def test_guards_read_kept_tables(spark, tmp_path, monkeypatch):
    orders = spark.range(1, 1100).selectExpr(
        "id AS o_orderkey", "id % 700 AS o_custkey", "date_add(DATE '1995-01-01', int(id)) AS o_orderdate"
    )
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    read, quality = [], guard_queries.quality
    monkeypatch.setattr(guard_queries, "quality", lambda df, *_: read.extend(df.inputFiles()) or quality(df, *_))
    found = {r.case: r.passed for r in guard_queries.guard_outcomes(spark, str(tmp_path)).collect()}
    assert read and all("/staged-" in path for path in read)
    assert {case for case, passed in found.items() if passed} == {"good source", "whole context", "quality of all"}
    assert len(found) == 15
