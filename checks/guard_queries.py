"""Guards and gates as rows: what each refuses, with which error and message."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.contract_queries import _issues_sql
from checks.fixtures import BROKEN_CTE, CLEAN_CTES, CONTRACT, registration
from checks.quality_queries import _thresholds
from checks.registry import query
from rollbook.operators import filters
from rollbook.operators.clean import clean
from rollbook.operators.guards import outcomes
from rollbook.operators.validate import gate
from rollbook.plans import pages
from rollbook.plans.load import page_context
from rollbook.plans.quality import quality
from rollbook.registration import FILTERS, registration_contract
from rollbook.staging import compiled_methods, written

_REFUSED = """SELECT '{case}' AS "case", false AS passed, '{error}' AS error, '{message}' AS message
    FROM registration HAVING count(*) > 0"""
_CASES = [
    ("missing columns", "MissingColumns", "Missing columns: make, model"),
    ("no rows", "EmptyInput", "The input has no rows."),
    ("no pairs", "EmptyInput", "No rows with make and model in the input."),
    ("no years", "EmptyInput", "No values of model_year in the input."),
    ("limit of zero", "ValueError", "grid_makes must be a positive integer."),
    ("width of a half", "ValueError", "width must be a positive integer."),
    ("inverted years", "ValueError", "The first year cannot exceed the last year."),
    ("wrong columns", "ContractViolation", "1 blocking rules are broken (table: invalid_columns)"),
    ("no source rows", "ContractViolation", "1 blocking rules are broken (table: empty_dataset)"),
    (
        "years to come",
        "ContractViolation",
        "1 blocking rules are broken (Model Year: implausible_model_year)",
    ),
    ("quality of nothing", "EmptyInput", "Quality reporting requires at least one data row."),
]
_PASSED = ("good source", "whole context", "quality of all")
_BROKEN = """SELECT 'broken source', false, 'ContractViolation',
    count(*) || ' blocking rules are broken (' || string_agg("column" || ': ' || code, '; '
        ORDER BY seq) || ')' FROM issues WHERE severity = 'error'"""


@query(
    "guard_outcomes",
    "WITH "
    + CLEAN_CTES.strip()
    + ",\n"
    + BROKEN_CTE.strip()
    + ",\n"
    + _issues_sql("broken")
    + "\n"
    + "\nUNION ALL\n".join(
        [
            *(_REFUSED.format(case=c, error=e, message=m) for c, e, m in _CASES),
            *(
                f"SELECT '{case}', true, NULL, NULL FROM registration HAVING count(*) > 0"
                for case in _PASSED
            ),
            _BROKEN,
        ]
    ),
)
def guard_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Every guard on the whole tables: inputs that it refuses, and inputs that pass."""
    # Kept once, as a snapshot is: each case then reads its columns instead of making all again.
    stored = written(registration(spark, folder).toDF(*CONTRACT.renames.values()))
    raw = stored.toDF(*CONTRACT.columns)
    with compiled_methods(spark):
        full = written(clean(raw, CONTRACT, validate=False))
    broken = registration(spark, folder, broken=True)
    bounds = _thresholds(spark)
    none = full.where("false")

    def context() -> None:
        selection = filters.default_selection(full, FILTERS)
        found = page_context(full, FILTERS, selection)
        if found.full.count() != full.count() or found.filtered.count() > found.full.count():
            raise ValueError("The context lost rows.")

    nulls = {"no pairs": ["model"], "no years": ["model_year"]}
    without = {
        case: full.withColumns({c: F.lit(None).cast(full.schema[c].dataType) for c in names})
        for case, names in nulls.items()
    }
    cases = {
        "missing columns": lambda: pages.market(full.drop("make", "model")),
        "no rows": lambda: pages.overview(none),
        "no pairs": lambda: pages.market(without["no pairs"]),
        "no years": lambda: pages.market(without["no years"]),
        "limit of zero": lambda: pages.market(full, grid_makes=0),
        "width of a half": lambda: pages.ranges(full, width=0.5),
        "inverted years": lambda: filters.Selection(2001, 2000),
        "wrong columns": lambda: gate(raw.drop("County"), CONTRACT),
        "no source rows": lambda: gate(raw.where("false"), CONTRACT),
        "years to come": lambda: gate(raw, registration_contract(1980)),
        "quality of nothing": lambda: quality(none, bounds),
        "good source": lambda: gate(raw, CONTRACT),
        "whole context": context,
        "quality of all": lambda: quality(full, bounds),
        "broken source": lambda: gate(broken, CONTRACT),
    }
    with compiled_methods(spark):
        return outcomes(spark, cases)
