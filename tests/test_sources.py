import csv
import gzip
import hashlib
import json

import pytest
from conftest import ROWS, rows

from rollbook.operators import filters
from rollbook.operators.validate import ContractViolation
from rollbook.plans.load import load_clean, load_snapshot, load_validated, page_context
from rollbook.plans.quality import write_exploratory
from rollbook.registration import FILTERS, RENAMES
from rollbook.sources import delimited, files
from rollbook.sources.files import SourceError

HEADER = list(RENAMES)


def write(path, header=HEADER, data=ROWS, encoding="utf-8", opener=open):
    with opener(path, "wt", encoding=encoding, newline="") as target:
        writer = csv.writer(target)
        writer.writerow(header)
        writer.writerows(data)
    return str(path)


def changed(row, **cells):
    values = dict(zip(RENAMES.values(), row, strict=True)) | cells
    return tuple(values.values())


def test_values_stay_text(spark, contract, tmp_path):
    odd = changed(ROWS[0], city='a "quoted", city', model="NA", county="", make="  x ", dol_vehicle_id="007")
    path = write(tmp_path / "a.csv", data=[odd], encoding="utf-8-sig")
    row = delimited.read_raw(spark, path, contract).first()
    assert (row["City"], row["Model"], row["County"], row["Make"]) == ('a "quoted", city', "NA", None, "  x ")
    assert row["DOL Vehicle ID"] == "007" and row["VIN (1-10)"] == ROWS[0][0]


def test_line_breaks_need_multi_line(spark, contract, tmp_path):
    path = write(tmp_path / "a.csv", data=[changed(ROWS[0], city="a\nb")])
    read = delimited.read_raw(spark, path, contract, multi_line=True)
    assert [r["City"] for r in read.collect()] == ["a\nb"]


def test_compressed_folder(spark, contract, tmp_path):
    write(tmp_path / "a.csv.gz", opener=gzip.open)
    write(tmp_path / "b.csv")
    assert delimited.read_raw(spark, str(tmp_path), contract).count() == 4


@pytest.mark.parametrize(
    "header, problem, detail",
    [
        ([*HEADER[:-1], HEADER[0]], "duplicate column names", "VIN (1-10)"),
        ([h for h in HEADER if h != "County"], "columns differ", "County"),
        ([*HEADER, "Extra"], "columns differ", "Extra"),
        ([HEADER[1], HEADER[0], *HEADER[2:]], "column order differs", ""),
        ([h.lower() for h in HEADER], "columns differ", "county"),
        ([h + "\n" if h == "City" else h for h in HEADER], "columns differ", "City"),
    ],
)
def test_header_contract(spark, contract, tmp_path, header, problem, detail):
    write(tmp_path / "good.csv")
    write(tmp_path / "bad.csv", header=header, data=[])
    (issue,) = files.header_issues(spark, str(tmp_path), contract).collect()
    assert issue.path.endswith("bad.csv") and issue.problem == problem
    with pytest.raises(SourceError, match=problem) as caught:
        delimited.read_raw(spark, str(tmp_path), contract)
    assert detail in str(caught.value)


def test_empty_unreadable_and_missing_files(spark, contract, tmp_path):
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "latin.csv").write_bytes("é,a\n".encode("latin-1"))
    write(tmp_path / "good.csv")
    issues = files.header_issues(spark, str(tmp_path), contract).collect()
    found = {r.path.rsplit("/")[-1]: r.problem for r in issues}
    assert found["latin.csv"].startswith("unreadable")
    assert found[tmp_path.name] == "1 files without content" and len(found) == 2
    with pytest.raises(SourceError, match="without content"):
        delimited.read_raw(spark, str(tmp_path / "empty.csv"), contract)
    with pytest.raises(SourceError, match="not found"):
        delimited.read_raw(spark, str(tmp_path / "none.csv"), contract)


@pytest.mark.parametrize("row", [ROWS[1][:-1], (*ROWS[1], "more")])
def test_ragged_rows_fail(spark, contract, tmp_path, row):
    path = write(tmp_path / "a.csv", data=[ROWS[0], row])
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        delimited.read_raw(spark, path, contract).collect()


@pytest.mark.parametrize("kept", [False, True])
def test_gate(spark, contract, tmp_path, kept):
    keep_raw = str(tmp_path / "raw") if kept else None
    path = write(tmp_path / "a.csv")
    raw, report = load_validated(spark, path, contract, keep_raw=keep_raw)
    assert raw.columns == HEADER and raw.count() == 2 and report.is_valid
    cleaned, _ = load_clean(spark, path, contract, keep_raw=keep_raw)
    assert cleaned.count() == 2
    path = write(tmp_path / "b.csv", data=[ROWS[0], changed(ROWS[1], dol_vehicle_id="104020301")])
    with pytest.raises(ContractViolation, match="duplicate_vehicle_id") as caught:
        load_validated(spark, path, contract, keep_raw=keep_raw)
    assert not caught.value.report.is_valid


def test_warnings_pass_the_gate(spark, contract, tmp_path):
    path = write(tmp_path / "a.csv", data=[ROWS[0], changed(ROWS[1], county="")])
    cleaned, report = load_clean(spark, path, contract)
    assert [i.code for i in report.warnings] == ["missing_optional_value"]
    assert cleaned.count() == 2


def test_snapshot_and_page_context(spark, contract, tmp_path):
    path = write(tmp_path / "a.csv", data=[ROWS[0], changed(ROWS[1], state="OR")])
    snapshot = load_snapshot(spark, path, contract, str(tmp_path / "clean"))
    selection = filters.default_selection(snapshot.full, FILTERS)
    context = page_context(snapshot.full, FILTERS, selection)
    assert (context.full.count(), context.filtered.count()) == (2, 1)
    (file,) = snapshot.files.collect()
    content = (tmp_path / "a.csv").read_bytes()
    assert file.identifier == "f6w7-q2d2" and file.length == len(content)
    assert file.sha256 == hashlib.sha256(content).hexdigest()


def test_fingerprints(spark, tmp_path):
    for name, size in (("a", 1), ("b", 10), ("c", 3_000_000)):
        (tmp_path / name).write_bytes(bytes(i % 251 for i in range(size)))
    found = {r.path.rsplit("/")[-1]: (r.length, r.sha256) for r in files.fingerprints(spark, str(tmp_path)).collect()}
    for name, (length, digest) in found.items():
        content = (tmp_path / name).read_bytes()
        assert (length, digest) == (len(content), hashlib.sha256(content).hexdigest())
    assert len(found) == 3


def test_table_fingerprint(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 1), ('b', 2), (NULL, 3) AS t(x, y)")
    first = rows(files.table_fingerprint(df))
    assert rows(files.table_fingerprint(df.orderBy("x").repartition(3))) == first
    assert rows(files.table_fingerprint(df.union(df))) != first
    twice = df.unionAll(df.limit(1)).unionAll(df.limit(1))
    assert rows(files.table_fingerprint(twice))[0][1] != first[0][1]
    assert rows(files.table_fingerprint(df.filter("y < 3"))) != first


def test_changes(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_text(name)
    saved_path = str(tmp_path.parent / "saved_manifest")
    files.manifest(spark, str(tmp_path)).write.mode("overwrite").parquet(saved_path)
    saved = spark.read.parquet(saved_path)
    assert files.changes(files.manifest(spark, str(tmp_path)), saved).isEmpty()
    (tmp_path / "a").write_text("longer")
    (tmp_path / "b").unlink()
    (tmp_path / "d").write_text("d")
    found = {r.path.rsplit("/")[-1]: r.change for r in files.changes(files.manifest(spark, str(tmp_path)), saved).collect()}
    assert found == {"a": "changed", "b": "removed", "d": "new"}


def test_exploratory_report(spark, contract, raw, tmp_path):
    write_exploratory(raw.clean(spark, contract), str(tmp_path / "eda"))
    found = json.loads(spark.read.text(str(tmp_path / "eda")).first().value)
    assert found["vehicle_count"] == 2 and found["model_year_median"] == 2020.0
    assert [v["value"] for v in found["model_year"]] == ["2018", "2022"]
    assert [v["value"] for v in found["make"]] == ["ALDER", "VELOMAR"]
    assert [t["ev_type_code"] for t in found["range_by_vehicle_type"]] == ["BEV", "PHEV"]
    assert found["range_by_vehicle_type"][1]["median"] is None
