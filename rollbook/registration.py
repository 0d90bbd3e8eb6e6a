"""The vehicle-registration contract, one instance of :class:`rollbook.contract.Contract`."""

from __future__ import annotations

from datetime import date

from rollbook.contract import (
    ERROR,
    WARNING,
    Contract,
    FieldDefinition,
    Matches,
    NumberWithin,
    OneOf,
    Optional,
    PointWithin,
    Provenance,
    Required,
    Unique,
    WholeNumber,
)
from rollbook.operators.filters import FilterColumns

HOME_STATE = "WA"

# Published column names and their clean names, in published order.
RENAMES = {
    "VIN (1-10)": "vin_prefix",
    "County": "county",
    "City": "city",
    "State": "state",
    "Postal Code": "postal_code",
    "Model Year": "model_year",
    "Make": "make",
    "Model": "model",
    "Electric Vehicle Type": "ev_type",
    "Clean Alternative Fuel Vehicle (CAFV) Eligibility": "cafv_eligibility",
    "Electric Range": "electric_range_raw",
    "Legislative District": "legislative_district",
    "DOL Vehicle ID": "dol_vehicle_id",
    "Vehicle Location": "vehicle_location",
    "Electric Utility": "electric_utility",
    "2020 Census Tract": "census_tract_2020",
}

# Columns that must be filled, in reporting order.
REQUIRED = (
    "VIN (1-10)",
    "State",
    "Model Year",
    "Make",
    "Model",
    "Electric Vehicle Type",
    "Clean Alternative Fuel Vehicle (CAFV) Eligibility",
    "DOL Vehicle ID",
)

# Published labels and their short forms.
TYPE_CODES = {
    "Battery Electric Vehicle (BEV)": "BEV",
    "Plug-in Hybrid Electric Vehicle (PHEV)": "PHEV",
}
STATUS_LABELS = {
    "Clean Alternative Fuel Vehicle Eligible": "Eligible",
    "Not eligible due to low battery range": "Not eligible",
    "Eligibility unknown as battery range has not been researched": "Unknown",
}

# Where the published table comes from.
PROVENANCE = Provenance(
    name="Electric Vehicle Population Data",
    publisher="Washington State Department of Licensing (DOL)",
    identifier="f6w7-q2d2",
    url="https://data.wa.gov/Transportation/Electric-Vehicle-Population-Data/f6w7-q2d2/data",
    licence="Open Data Commons Open Database License 1.0",
    licence_url="https://opendatacommons.org/licenses/odbl/1-0/",
)

# Clean column, source column, Spark type, nullable, meaning.
DICTIONARY = tuple(
    FieldDefinition(*entry)
    for entry in (
        ("vin_prefix", "VIN (1-10)", "string", False, "Start of the VIN; not a key"),
        ("county", "County", "string", True, "County of the owner"),
        ("city", "City", "string", True, "City of the owner"),
        ("state", "State", "string", False, "Two-letter state of the owner"),
        ("postal_code", "Postal Code", "string", True, "Postal code as text, padded to five"),
        ("model_year", "Model Year", "bigint", False, "Model year; not an event date"),
        ("make", "Make", "string", False, "Manufacturer"),
        ("model", "Model", "string", False, "Model label"),
        ("ev_type", "Electric Vehicle Type", "string", False, "Published type label"),
        ("cafv_eligibility", "CAFV Eligibility", "string", False, "Published eligibility label"),
        ("electric_range_raw", "Electric Range", "bigint", True, "Published range; 0 is unknown"),
        ("legislative_district", "Legislative District", "bigint", True, "District 1 to 49"),
        ("dol_vehicle_id", "DOL Vehicle ID", "string", False, "Row key of the snapshot"),
        ("vehicle_location", "Vehicle Location", "string", True, "Published point text"),
        ("electric_utility", "Electric Utility", "string", True, "Serving utilities"),
        ("census_tract_2020", "2020 Census Tract", "string", True, "Eleven-digit tract as text"),
        ("electric_range_miles", "Derived", "bigint", True, "Range in miles, null when unknown"),
        ("ev_type_code", "Derived", "string", False, "BEV or PHEV"),
        ("cafv_status", "Derived", "string", False, "Eligible, Not eligible or Unknown"),
        ("is_washington", "Derived", "boolean", False, "Whether the state is the home state"),
        ("longitude", "Derived from Vehicle Location", "double", True, "Longitude of the point"),
        ("latitude", "Derived from Vehicle Location", "double", True, "Latitude of the point"),
    )
)

# The filters every analysis of the clean table shares, from outer to inner level, each with
# the noun its description uses.
FILTERS = FilterColumns(
    state="state",
    home=HOME_STATE,
    home_label="Washington only",
    year="model_year",
    levels=(
        ("ev_type_code", "EV types"),
        ("make", "makes"),
        ("county", "counties"),
        ("cafv_status", "CAFV statuses"),
    ),
)

FIRST_YEAR = 1886
YEARS_AHEAD = 2


def registration_contract(asof_year: int | None = None) -> Contract:
    """The contract as of a year, which bounds plausible model years; default this year."""
    last_year = (date.today().year if asof_year is None else asof_year) + YEARS_AHEAD
    optional = sorted(set(RENAMES) - set(REQUIRED))
    # Fixed values in the rules: patterns, codes, bounds and messages of the published report.
    rules = (
        *(Required(column) for column in REQUIRED),
        Matches(
            "VIN (1-10)",
            "[A-HJ-NPR-Z0-9]{10}",
            "invalid_vin_prefix",
            "VIN (1-10) must contain exactly 10 uppercase VIN characters.",
            severity=ERROR,
            null_fails=True,
        ),
        WholeNumber("Model Year", required=True),
        NumberWithin(
            "Model Year",
            FIRST_YEAR,
            last_year,
            "implausible_model_year",
            f"Model Year must be between {FIRST_YEAR} and {last_year}.",
        ),
        WholeNumber("Electric Range"),
        NumberWithin(
            "Electric Range",
            0,
            None,
            "negative_electric_range",
            "Electric Range cannot be negative.",
        ),
        WholeNumber("DOL Vehicle ID", required=True),
        NumberWithin(
            "DOL Vehicle ID",
            0,
            None,
            "non_positive_vehicle_id",
            "DOL Vehicle ID must be positive.",
            lower_open=True,
        ),
        Unique(
            "DOL Vehicle ID",
            "duplicate_vehicle_id",
            "DOL Vehicle ID must be unique within a snapshot.",
        ),
        OneOf("Electric Vehicle Type", tuple(TYPE_CODES)),
        OneOf("Clean Alternative Fuel Vehicle (CAFV) Eligibility", tuple(STATUS_LABELS)),
        *(Optional(column) for column in optional),
        Matches(
            "State",
            "[A-Z]{2}",
            "invalid_state_format",
            "State should contain a two-character uppercase code.",
        ),
        Matches(
            "Postal Code",
            r"\d{4,5}",
            "invalid_postal_format",
            "Postal Code should contain four or five digits before cleaning.",
        ),
        Matches(
            "2020 Census Tract",
            r"\d{11}",
            "invalid_census_tract",
            "2020 Census Tract should contain exactly 11 digits.",
        ),
        NumberWithin(
            "Legislative District",
            1,
            49,
            "invalid_legislative_district",
            "Legislative District should be an integer from 1 through 49.",
            severity=WARNING,
            whole=True,
        ),
        PointWithin(
            "Vehicle Location",
            "invalid_vehicle_location",
            "Vehicle Location must be a bounded WKT POINT (longitude latitude).",
        ),
    )
    return Contract(
        renames=RENAMES,
        rules=rules,
        integers=("model_year", "legislative_district", "electric_range_raw"),
        upper=("vin_prefix", "state", "make"),
        padded={"postal_code": 4},
        sentinels={"electric_range_miles": ("electric_range_raw", 0)},
        mappings={
            "ev_type_code": ("ev_type", TYPE_CODES),
            "cafv_status": ("cafv_eligibility", STATUS_LABELS),
        },
        flags={"is_washington": ("state", HOME_STATE)},
        points={"vehicle_location": ("longitude", "latitude")},
        dictionary=DICTIONARY,
        provenance=PROVENANCE,
    )
