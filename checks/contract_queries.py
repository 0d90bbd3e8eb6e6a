"""Validation, cleaning, sources and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import (
    CONTRACT,
    clean_registration,
    registration,
    table,
)
from checks.registry import on_broken, on_clean, query
from rollbook.functions import labels, text
from rollbook.operators import clean, validate
from rollbook.plans.snapshots import load_version
from rollbook.sources import delimited, files
from rollbook.staging import shared_folder

PROVENANCE = CONTRACT.provenance

# The issue rules once more, in the other engine's SQL: severity, code, column, message, and
# the condition of a bad row. {c} stands for the quoted column.
_BLANK = "({c} IS NULL OR trim({c}) = '')"
_NUMBER = (
    "TRY_CAST(CASE WHEN regexp_full_match(trim({c}), "
    "'[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN trim({c}) END AS DOUBLE)"
)
_NOT_WHOLE = f"(NOT {_BLANK} AND coalesce({_NUMBER} % 1 <> 0, true))"
_CAFV = "Clean Alternative Fuel Vehicle (CAFV) Eligibility"
_REQUIRED = [
    "VIN (1-10)",
    "State",
    "Model Year",
    "Make",
    "Model",
    "Electric Vehicle Type",
    _CAFV,
    "DOL Vehicle ID",
]
_OPTIONAL = [
    "2020 Census Tract",
    "City",
    "County",
    "Electric Range",
    "Electric Utility",
    "Legislative District",
    "Postal Code",
    "Vehicle Location",
]
_POINT = "'POINT \\((-?[0-9]+(?:\\.[0-9]+)?) (-?[0-9]+(?:\\.[0-9]+)?)\\)'"
_LON = f"TRY_CAST(regexp_extract(trim({{c}}), {_POINT}, 1) AS DOUBLE)"
_LAT = f"TRY_CAST(regexp_extract(trim({{c}}), {_POINT}, 2) AS DOUBLE)"


def _format(column: str, code: str, message: str, pattern: str) -> tuple[str, ...]:
    bad = f"(NOT {_BLANK} AND NOT regexp_full_match(trim({{c}}), '{pattern}'))"
    return ("warning", code, column, message, bad)


def _outside(values: list[str]) -> str:
    listed = ", ".join(f"'{value}'" for value in values)
    return f"(NOT {_BLANK} AND trim({{c}}) NOT IN ({listed}))"


_TYPES = ["Battery Electric Vehicle (BEV)", "Plug-in Hybrid Electric Vehicle (PHEV)"]
_STATUSES = [
    "Clean Alternative Fuel Vehicle Eligible",
    "Not eligible due to low battery range",
    "Eligibility unknown as battery range has not been researched",
]


def _missing(column: str) -> tuple[str, ...]:
    return ("error", "missing_required_value", column, f"'{column}' cannot be blank.", _BLANK)


def _integer(column: str) -> tuple[str, ...]:
    message = f"'{column}' must contain integer values."
    return ("error", "invalid_integer", column, message, _NOT_WHOLE)


def _vocabulary(column: str, values: list[str]) -> tuple[str, ...]:
    message = f"'{column}' contains unreviewed values"
    return ("error", "unexpected_category", column, message, _outside(values))


_RULES: list[tuple[str, ...]] = [
    *(_missing(column) for column in _REQUIRED),
    (
        "error",
        "invalid_vin_prefix",
        "VIN (1-10)",
        "VIN (1-10) must contain exactly 10 uppercase VIN characters.",
        "coalesce(NOT regexp_full_match(trim({c}), '[A-HJ-NPR-Z0-9]{{10}}'), true)",
    ),
    _integer("Model Year"),
    _missing("Model Year"),
    (
        "error",
        "implausible_model_year",
        "Model Year",
        "Model Year must be between 1886 and 2028.",
        f"{_NUMBER} NOT BETWEEN 1886 AND 2028",
    ),
    _integer("Electric Range"),
    (
        "error",
        "negative_electric_range",
        "Electric Range",
        "Electric Range cannot be negative.",
        f"{_NUMBER} < 0",
    ),
    _integer("DOL Vehicle ID"),
    _missing("DOL Vehicle ID"),
    (
        "error",
        "non_positive_vehicle_id",
        "DOL Vehicle ID",
        "DOL Vehicle ID must be positive.",
        f"{_NUMBER} <= 0",
    ),
    (
        "error",
        "duplicate_vehicle_id",
        "DOL Vehicle ID",
        "DOL Vehicle ID must be unique within a snapshot.",
        "repeats > 1",
    ),
    _vocabulary("Electric Vehicle Type", _TYPES),
    _vocabulary(_CAFV, _STATUSES),
    *(
        ("warning", "missing_optional_value", c, f"'{c}' contains blank values.", _BLANK)
        for c in _OPTIONAL
    ),
    _format(
        "State",
        "invalid_state_format",
        "State should contain a two-character uppercase code.",
        "[A-Z]{{2}}",
    ),
    _format(
        "Postal Code",
        "invalid_postal_format",
        "Postal Code should contain four or five digits before cleaning.",
        "[0-9]{{4,5}}",
    ),
    _format(
        "2020 Census Tract",
        "invalid_census_tract",
        "2020 Census Tract should contain exactly 11 digits.",
        "[0-9]{{11}}",
    ),
    (
        "warning",
        "invalid_legislative_district",
        "Legislative District",
        "Legislative District should be an integer from 1 through 49.",
        f"(NOT {_BLANK} AND coalesce(NOT ({_NUMBER} % 1 = 0 AND {_NUMBER} BETWEEN 1 AND 49), true))",
    ),
    (
        "warning",
        "invalid_vehicle_location",
        "Vehicle Location",
        "Vehicle Location must be a bounded WKT POINT (longitude latitude).",
        f"(NOT {_BLANK} AND (NOT regexp_full_match(trim({{c}}), {_POINT}) OR "
        f"NOT ({_LON} BETWEEN -180 AND 180 AND {_LAT} BETWEEN -90 AND 90)))",
    ),
]


def _literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _issues_sql(source: str) -> str:
    """One row per rule that is broken, with its count."""
    identity = '"DOL Vehicle ID"'
    numeric = _NUMBER.format(c=identity)
    counts, rows = [], []
    for seq, (severity, code, column, message, bad) in enumerate(_RULES, start=1):
        condition = bad.format(c=f'"{column}"')
        counts.append(f"count(*) FILTER (WHERE {condition}) AS n{seq}")
        if code == "unexpected_category":
            value = f'trim("{column}")'
            first = (
                f"SELECT DISTINCT {value} AS v FROM {source} WHERE {condition} "
                "ORDER BY v LIMIT 5"
            )
            shown = f"(SELECT string_agg('''' || v || '''', ', ' ORDER BY v) FROM ({first}))"
            text_sql = f"{_literal(message)} || ': ' || {shown} || '.'"
        else:
            text_sql = _literal(message)
        rows.append(
            f"SELECT {seq} AS seq, {_literal(severity)} AS severity, {_literal(code)} AS code, "
            f'{_literal(column)} AS "column", {text_sql} AS message, '
            f"n{seq} AS n_rows FROM counted WHERE n{seq} > 0"
        )
    return (
        "numbered AS (SELECT *, CASE WHEN "
        + numeric
        + " IS NOT NULL THEN count(*) OVER (PARTITION BY "
        + numeric
        + f") END AS repeats FROM {source}),\n"
        + "counted AS (SELECT "
        + ",\n".join(counts)
        + " FROM numbered),\nissues AS (\n"
        + "\nUNION ALL\n".join(rows)
        + "\n)"
    )


_ISSUES = on_clean("SELECT * FROM issues", _issues_sql("registration"))
_BROKEN_ISSUES = on_broken("").rstrip() + ",\n" + _issues_sql("broken") + "\n"


@query("validation_issues", _ISSUES)
def validation_issues(spark: SparkSession, folder: str) -> DataFrame:
    return validate.issues(registration(spark, folder), CONTRACT)


@query("validation_issues_broken", _BROKEN_ISSUES + "SELECT * FROM issues")
def validation_issues_broken(spark: SparkSession, folder: str) -> DataFrame:
    return validate.issues(registration(spark, folder, broken=True), CONTRACT)


@query(
    "validation_report_text",
    _BROKEN_ISSUES
    + """SELECT seq, severity, '[' || code || '] ' || message || ' (' ||
    format('{:,}', n_rows) || ' rows)' AS line FROM issues""",
)
def validation_report_text(spark: SparkSession, folder: str) -> DataFrame:
    broken = registration(spark, folder, broken=True)
    return validate.report_text(validate.issues(broken, CONTRACT))


_VERDICT = """SELECT CAST(count(*) FILTER (WHERE severity = 'error') AS BIGINT) AS n_errors,
    CAST(count(*) FILTER (WHERE severity = 'warning') AS BIGINT) AS n_warnings,
    count(*) FILTER (WHERE severity = 'error') = 0 AS is_valid FROM issues"""


@query("validation_gate", on_clean(_VERDICT, _issues_sql("registration")))
def validation_gate(spark: SparkSession, folder: str) -> DataFrame:
    return validate.verdict(validate.issue_counts(registration(spark, folder), CONTRACT))


@query("validation_gate_broken", _BROKEN_ISSUES + _VERDICT)
def validation_gate_broken(spark: SparkSession, folder: str) -> DataFrame:
    broken = registration(spark, folder, broken=True)
    return validate.verdict(validate.issue_counts(broken, CONTRACT))


@query(
    "validation_duplicate_keys",
    """SELECT CAST(sum(n) AS BIGINT) AS n_rows FROM
    (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)""",
)
def validation_duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    return validate.duplicated_values(table(spark, folder, "lineitem"), [F.col("l_orderkey")])


@query(
    "validation_vocabulary",
    """SELECT event_type AS value, count(*) AS count FROM events
    WHERE event_type NOT IN (SELECT event_type FROM events WHERE value > 100)
    OR event_type = 'error' GROUP BY event_type""",
)
def validation_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    known = events.filter((F.col("value") > 100) & (F.col("event_type") != "error"))
    return validate.outside_vocabulary(events, "event_type", known.select("event_type"))


@query(
    "validation_previews",
    on_broken(
        """SELECT 'Electric Vehicle Type' AS "column", '''Hydrogen'', ''Steam''' AS preview
    FROM broken WHERE "Electric Vehicle Type" IN ('Hydrogen', 'Steam')
    HAVING count(DISTINCT "Electric Vehicle Type") = 2
    UNION ALL SELECT 'Clean Alternative Fuel Vehicle (CAFV) Eligibility', '''Maybe'''
    FROM broken WHERE "Clean Alternative Fuel Vehicle (CAFV) Eligibility" = 'Maybe'
    HAVING count(*) > 0"""
    ),
)
def validation_previews(spark: SparkSession, folder: str) -> DataFrame:
    return validate.vocabulary_previews(registration(spark, folder, broken=True), CONTRACT)


@query("clean_registration", on_clean("SELECT * FROM clean"))
def clean_registration_rows(spark: SparkSession, folder: str) -> DataFrame:
    return clean_registration(spark, folder)


@query(
    "rename_columns",
    on_clean(
        "SELECT "
        + ", ".join(f'"{old}" AS {new}' for old, new in CONTRACT.renames.items())
        + " FROM registration"
    ),
)
def rename_columns(spark: SparkSession, folder: str) -> DataFrame:
    return clean.rename(registration(spark, folder), CONTRACT)


@query(
    "label_lookup",
    """SELECT o_orderkey, o_orderpriority,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN substr(o_orderpriority, 3) END AS code
    FROM orders""",
)
def label_lookup(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    used = orders.filter(F.col("o_orderpriority") < "3").select("o_orderpriority").distinct()
    known = used.select("o_orderpriority", F.substring("o_orderpriority", 3, 99))
    return clean.look_up(
        orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", known, "code"
    )


# Sources


def _scratch(spark: SparkSession) -> str:
    """A new folder below the one the cluster shares."""
    return f"{shared_folder(spark)}/rollbook-{uuid.uuid4().hex}"


def _write_csv(df: DataFrame, path: str, mode: str = "error") -> str:
    writer = df.write.mode(mode).option("header", True).option("escape", "\"")
    writer = writer.option("ignoreLeadingWhiteSpace", False)
    writer.option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query(
    "csv_roundtrip",
    on_clean(
        "SELECT "
        + ", ".join(f"""nullif("{name}", '') AS "{name}\"""" for name in CONTRACT.columns)
        + " FROM registration"
    ),
)
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Written as text and read back under the contract, every value but the empty survives."""
    path = _write_csv(registration(spark, folder), _scratch(spark))
    return delimited.read_raw(spark, path, CONTRACT)


@query(
    "csv_documents",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(nullif(text, '')) AS text_md5,
    nullif(lang, '') AS lang, nullif(source, '') AS source, CAST(n_chars AS VARCHAR) AS n_chars
    FROM documents""",
)
def csv_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts with quotes, commas and line breaks through a multi-line file."""
    from rollbook.contract import Contract

    names = ("doc_id", "text", "lang", "source", "n_chars")
    contract = Contract(renames={name: name for name in names}, rules=())
    path = _write_csv(table(spark, folder, "documents").select(*names), _scratch(spark))
    read = delimited.read_raw(spark, path, contract, multi_line=True)
    return read.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@query("load_clean", on_clean("SELECT * FROM clean"))
def load_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Text files through header check, gate and cleaning."""
    from rollbook.plans.load import load_clean as load

    path = _write_csv(registration(spark, folder), _scratch(spark))
    cleaned, _ = load(spark, path, CONTRACT)
    return cleaned


@query("snapshot_reload", on_clean("SELECT * FROM clean"))
def snapshot_reload(spark: SparkSession, folder: str) -> DataFrame:
    """A store that first held other rows for half of the keys, after that source was replaced."""
    base, store = _scratch(spark), _scratch(spark)
    rows = registration(spark, folder)
    odd = F.pmod(F.xxhash64("`DOL Vehicle ID`"), F.lit(2)) == 1
    _write_csv(rows.where(~odd), f"{base}/even")
    other = rows.where(odd).withColumn("Make", F.lit("OTHER"))
    _write_csv(other, f"{base}/odd")
    load_version(spark, f"{base}/*", CONTRACT, store)
    _write_csv(rows.where(odd), f"{base}/odd", "overwrite")
    return load_version(spark, f"{base}/*", CONTRACT, store).full


@query(
    "snapshot_counts",
    on_clean(
        """SELECT seq, severity, code, "column", message, n_rows FROM issues""",
        _issues_sql("registration"),
    ),
)
def snapshot_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The gate's report, added up from the counts that a store keeps for each source file."""
    base, store = _scratch(spark), _scratch(spark)
    rows = registration(spark, folder)
    part = F.pmod(F.xxhash64("`DOL Vehicle ID`"), F.lit(3))
    for i in range(3):
        _write_csv(rows.where(part == i), f"{base}/{i}")
        report = load_version(spark, f"{base}/*", CONTRACT, store).report
    schema = ", ".join(f"`{name}` {kind}" for name, kind in validate.ISSUE.items())
    return spark.createDataFrame([tuple(issue) for issue in report.issues], schema)


@query(
    "header_contract",
    """SELECT 'column order differs' AS problem, '' AS missing, '' AS unexpected
    FROM orders HAVING count(*) > 0
    UNION ALL SELECT 'columns differ', 'County', 'Region' FROM orders HAVING count(*) > 0""",
)
def header_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Files written with the right, a reordered and a renamed header; the right ones pass."""
    rows = registration(spark, folder)
    base = _scratch(spark)
    reordered = rows.select(*(f"`{name}`" for name in reversed(rows.columns)))
    for i, df in enumerate((rows, reordered, rows.withColumnRenamed("County", "Region"))):
        _write_csv(df, f"{base}/{i}")
    issues = files.header_issues(spark, f"{base}/*", CONTRACT)
    return issues.select(
        "problem",
        F.array_join("missing", ", ").alias("missing"),
        F.array_join("unexpected", ", ").alias("unexpected"),
    ).distinct()


@query("source_manifest")
def source_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return files.manifest(spark, f"{folder}/*.parquet", PROVENANCE)


@query("source_fingerprints")
def source_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return files.fingerprints(spark, f"{folder}/*.parquet")


@query(
    "source_changes",
    """SELECT DISTINCT o_orderpriority AS part, CASE o_orderpriority WHEN '1-URGENT' THEN 'new'
    ELSE 'changed' END AS change FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
    UNION ALL SELECT DISTINCT o_orderpriority || '-OLD', 'removed' FROM orders""",
)
def source_changes(spark: SparkSession, folder: str) -> DataFrame:
    """One file for each priority, against a manifest with other sizes, files missing and more."""
    orders, path = table(spark, folder, "orders"), _scratch(spark)
    orders.repartition("o_orderpriority").write.partitionBy("o_orderpriority").csv(path)
    now = files.manifest(spark, f"{path}/*/*.csv")
    part = F.regexp_extract("path", "o_orderpriority=([^/]+)", 1)
    older = now.withColumn("path", F.concat(F.replace("path", part, F.concat(part, F.lit("-OLD")))))
    saved = now.where(part != "1-URGENT").withColumn(
        "length", F.col("length") + (part == "5-LOW").cast("bigint")
    )
    found = files.changes(now, saved.unionByName(older))
    return found.select(part.alias("part"), "change")


_LINES = "doc_id || ':' || coalesce(lang, '-') || ':' || length(text)"
_TREE_LEVELS = 8


def _tree_sql(level: int) -> str:
    """A level of the hash tree with 16 nodes below each; a single node stays as it is."""
    return f"""tree{level} AS (SELECT n // 16 AS n, CASE WHEN (SELECT count(*) FROM tree{level - 1}) > 1
    THEN sha256(string_agg(d, '' ORDER BY n)) ELSE min(d) END AS d FROM tree{level - 1} GROUP BY n // 16)"""


@query(
    "text_fingerprints",
    f"""WITH lines AS (SELECT {_LINES} AS line, row_number() OVER (ORDER BY doc_id) - 1 AS n
    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    tree0 AS (SELECT n, sha256(line) AS d FROM lines),
    {", ".join(_tree_sql(level) for level in range(1, _TREE_LEVELS))}
    SELECT (SELECT CAST(sum(octet_length(CAST(line AS BLOB)) + 1) AS BIGINT) FROM lines) AS length,
    (SELECT sha256(string_agg(line || chr(10), '' ORDER BY n)) FROM lines) AS sha256,
    (SELECT count(*) FROM lines) AS lines, d AS tree FROM tree{_TREE_LEVELS - 1}""",
)
def text_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Plain digest and ordered hash tree of a file with a line for each document."""
    docs = table(spark, folder, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    parts = ("doc_id", F.lit(":"), F.coalesce("lang", F.lit("-")), F.lit(":"), F.length("text"))
    path = files.one_file(docs.select("doc_id", F.concat(*parts).alias("line")), "doc_id", _scratch(spark))
    trees = files.tree_fingerprints(spark, path, fan_out=16)
    # The plain digest too is that of a file of any size.
    plain = files.fingerprints(spark, path, whole_bytes=None)
    return plain.join(trees, "path").drop("path")


_SIZED = (
    "CASE WHEN \"{0}\" IS NULL THEN '-' ELSE CAST(length(\"{0}\") AS VARCHAR) || ':' || \"{0}\" END"
)


@query(
    "table_fingerprint",
    on_clean(
        "SELECT count(*) AS n_rows, concat_ws(' ', "
        + ", ".join(
            f"CAST(sum(CAST(('0x' || substr(digest, {at}, 16)) AS HUGEINT)) AS VARCHAR)"
            for at in (1, 17, 33, 49)
        )
        + ") AS digest_sum FROM (SELECT sha256("
        + " || ".join(_SIZED.format(name) for name in CONTRACT.columns)
        + ") AS digest FROM registration)"
    ),
)
def table_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return files.table_fingerprint(registration(spark, folder))


# Scalar functions


@query(
    "text_functions",
    r"""SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS tidy_chars,
    md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS tidy_md5,
    length(trim(text, E' \t\n\r')) AS stripped_chars FROM documents""",
)
def text_functions(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id",
        F.length(text.tidy(c)).cast("bigint").alias("tidy_chars"),
        F.md5(text.tidy(c)).alias("tidy_md5"),
        F.length(text.strip(c)).cast("bigint").alias("stripped_chars"),
    )


@query(
    "title_case",
    """SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name || '-' ||
    p_type, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS title
    FROM part""",
)
def title_case(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return part.select(
        "p_partkey", text.title_case(F.concat("p_name", F.lit("-"), "p_type")).alias("title")
    )


@query(
    "display_labels",
    on_clean(
        """SELECT dol_vehicle_id,
    format('{:,}', CAST(dol_vehicle_id AS BIGINT)) AS thousands,
    CASE WHEN electric_range_miles IS NULL THEN '—'
        ELSE format('{:,}', electric_range_miles * 11) || ' mi' END AS miles,
    CASE WHEN electric_range_raw IS NULL THEN '—'
        ELSE format('{:,.1f}', electric_range_raw / 3.2 * 100) || '%' END AS percent,
    CASE WHEN CAST(dol_vehicle_id AS BIGINT) % 2 = 0
        THEN CAST(CAST(dol_vehicle_id AS BIGINT) // 2 AS VARCHAR)
        ELSE format('{:.1f}', CAST(dol_vehicle_id AS BIGINT) / 2) END AS half
    FROM clean"""
    ),
)
def display_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = clean_registration(spark, folder)
    key = F.col("dol_vehicle_id").cast("bigint")
    return rows.select(
        "dol_vehicle_id",
        labels.thousands(key).alias("thousands"),
        labels.miles(F.col("electric_range_miles") * 11).alias("miles"),
        labels.percent(F.col("electric_range_raw") / 3.2).alias("percent"),
        labels.year(key / 2).alias("half"),
    )
