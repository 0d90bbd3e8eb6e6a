"""Registration rows that both engines derive from ``orders``, as SQL text.

``registration`` passes the gate with warnings; ``broken`` violates every blocking rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollbook.operators.clean import clean
from rollbook.registration import registration_contract

ASOF_YEAR = 2026
CONTRACT = registration_contract(ASOF_YEAR)

# One entry per published column, in order.
_EXPRESSIONS = {
    "VIN (1-10)": "concat('5YJ3E', lpad(cast(o_orderkey % 100000 AS string), 5, '0'))",
    "County": """CASE WHEN o_orderkey % 211 = 0 THEN NULL
        WHEN o_orderkey % 13 = 0 THEN concat('  County   ', cast(o_custkey % 12 AS string), ' ')
        ELSE concat('County ', cast(o_custkey % 12 AS string)) END""",
    "City": """CASE WHEN o_orderkey % 211 = 0 THEN NULL
        ELSE concat('City ', cast(o_custkey % 40 AS string)) END""",
    "State": "CASE WHEN o_orderkey % 50 = 0 THEN 'OR' ELSE 'WA' END",
    "Postal Code": """CASE WHEN o_orderkey % 301 = 0 THEN '1234'
        ELSE cast(98000 + o_custkey % 500 AS string) END""",
    "Model Year": "cast(year(o_orderdate) AS string)",
    "Make": """CASE WHEN o_orderkey % 17 = 0
        THEN concat(' make ', cast(o_custkey % 23 AS string), ' ')
        ELSE concat('MAKE ', cast(o_custkey % 23 AS string)) END""",
    "Model": "concat('MODEL ', cast(o_custkey % 9 AS string))",
    "Electric Vehicle Type": """CASE WHEN o_orderkey % 5 = 0
        THEN 'Plug-in Hybrid Electric Vehicle (PHEV)'
        ELSE 'Battery Electric Vehicle (BEV)' END""",
    "Clean Alternative Fuel Vehicle (CAFV) Eligibility": """CASE WHEN o_orderkey % 3 <> 0
        THEN 'Eligibility unknown as battery range has not been researched'
        WHEN o_custkey % 300 < 10 THEN 'Not eligible due to low battery range'
        ELSE 'Clean Alternative Fuel Vehicle Eligible' END""",
    "Electric Range": """CASE WHEN o_orderkey % 401 = 0 THEN ''
        WHEN o_orderkey % 3 <> 0 THEN '0'
        ELSE cast(20 + o_custkey % 300 AS string) END""",
    "Legislative District": """CASE WHEN o_orderkey % 199 = 0 THEN NULL
        WHEN o_orderkey % 997 = 0 THEN '50'
        ELSE cast(1 + o_custkey % 49 AS string) END""",
    "DOL Vehicle ID": "cast(o_orderkey + 1 AS string)",
    "Vehicle Location": """CASE WHEN o_orderkey % 257 = 0 THEN NULL
        WHEN o_orderkey % 251 = 0 THEN 'POINT (500 200)'
        ELSE concat('POINT (-', cast(117 + o_custkey % 8 AS string), '.',
            lpad(cast(o_custkey % 25 AS string), 2, '0'), ' ',
            cast(45 + o_custkey % 4 AS string), '.5)') END""",
    "Electric Utility": "concat('UTILITY ', cast(o_custkey % 6 AS string))",
    "2020 Census Tract": """CASE WHEN o_orderkey % 499 = 0 THEN '123'
        ELSE lpad(cast(53000000000 + o_custkey AS string), 11, '0') END""",
}

# Remainder of the order key by 1009 -> column and the value that breaks its rule.
_FAULTS = {
    0: ("VIN (1-10)", "'BAD'"),
    1: ("Model Year", "'20x0'"),
    2: ("Model Year", "'1700'"),
    3: ("Electric Range", "'-1'"),
    4: ("DOL Vehicle ID", "'-5'"),
    5: ("DOL Vehicle ID", "'7'"),
    6: ("Electric Vehicle Type", "'Hydrogen'"),
    7: ("Make", "'   '"),
    8: ("DOL Vehicle ID", "NULL"),
    9: ("State", "'Wash'"),
    10: ("Postal Code", "'ABC'"),
    11: ("Model Year", "'2020.5'"),
    12: ("Model Year", "''"),
    13: ("VIN (1-10)", "NULL"),
    14: ("Clean Alternative Fuel Vehicle (CAFV) Eligibility", "'Maybe'"),
    15: ("Electric Vehicle Type", "'Steam'"),
}


def _faulty(name: str, expression: str) -> str:
    cases = " ".join(
        f"WHEN o_orderkey % 1009 = {remainder} THEN {value}"
        for remainder, (column, value) in _FAULTS.items()
        if column == name
    )
    return f"CASE {cases} ELSE {expression} END" if cases else expression


def registration_sql(table: str, quote: str, broken: bool = False) -> str:
    columns = ",\n    ".join(
        f"{_faulty(name, text) if broken else text} AS {quote}{name}{quote}"
        for name, text in _EXPRESSIONS.items()
    )
    return f"SELECT\n    {columns}\nFROM {table}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def registration(spark: SparkSession, folder: str, broken: bool = False) -> DataFrame:
    orders = table(spark, folder, "orders")
    return spark.sql(registration_sql("{orders}", "`", broken), orders=orders)


def clean_registration(spark: SparkSession, folder: str) -> DataFrame:
    return clean(registration(spark, folder), CONTRACT, validate=False)


# The clean table in the other engine's SQL, written apart from the library.
_TIDY = r"""nullif(trim(regexp_replace("{0}", '\s+', ' ', 'g')), '')"""
_POINT = r"'^POINT \((-?\d+(?:\.\d+)?) (-?\d+(?:\.\d+)?)\)$'"


def _text(name: str) -> str:
    return _TIDY.format(name)


CLEAN_CTES = f"""
registration AS (
{registration_sql("orders", '"')}
),
typed AS (
SELECT
    upper({_text("VIN (1-10)")}) AS vin_prefix,
    {_text("County")} AS county,
    {_text("City")} AS city,
    upper({_text("State")}) AS state,
    CASE WHEN regexp_full_match({_text("Postal Code")}, '[0-9]{{4}}')
        THEN '0' || {_text("Postal Code")} ELSE {_text("Postal Code")} END AS postal_code,
    TRY_CAST(trim("Model Year") AS BIGINT) AS model_year,
    upper({_text("Make")}) AS make,
    {_text("Model")} AS model,
    {_text("Electric Vehicle Type")} AS ev_type,
    {_text("Clean Alternative Fuel Vehicle (CAFV) Eligibility")} AS cafv_eligibility,
    TRY_CAST(trim("Electric Range") AS BIGINT) AS electric_range_raw,
    TRY_CAST(trim("Legislative District") AS BIGINT) AS legislative_district,
    {_text("DOL Vehicle ID")} AS dol_vehicle_id,
    {_text("Vehicle Location")} AS vehicle_location,
    {_text("Electric Utility")} AS electric_utility,
    {_text("2020 Census Tract")} AS census_tract_2020
FROM registration
),
clean AS (
SELECT *,
    nullif(electric_range_raw, 0) AS electric_range_miles,
    CASE ev_type WHEN 'Battery Electric Vehicle (BEV)' THEN 'BEV'
        WHEN 'Plug-in Hybrid Electric Vehicle (PHEV)' THEN 'PHEV' END AS ev_type_code,
    CASE cafv_eligibility
        WHEN 'Clean Alternative Fuel Vehicle Eligible' THEN 'Eligible'
        WHEN 'Not eligible due to low battery range' THEN 'Not eligible'
        WHEN 'Eligibility unknown as battery range has not been researched' THEN 'Unknown'
    END AS cafv_status,
    state = 'WA' AS is_washington,
    TRY_CAST(nullif(regexp_extract(vehicle_location, {_POINT}, 1), '') AS DOUBLE) AS longitude,
    TRY_CAST(nullif(regexp_extract(vehicle_location, {_POINT}, 2), '') AS DOUBLE) AS latitude
FROM typed
)
"""
BROKEN_CTE = f"""
broken AS (
{registration_sql("orders", '"', broken=True)}
)
"""
