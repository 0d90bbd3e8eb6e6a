from conftest import only

from rollbook.operators.clean import clean, look_up

CLEAN_TYPES = {
    "vin_prefix": "string",
    "county": "string",
    "city": "string",
    "state": "string",
    "postal_code": "string",
    "model_year": "bigint",
    "make": "string",
    "model": "string",
    "ev_type": "string",
    "cafv_eligibility": "string",
    "electric_range_raw": "bigint",
    "legislative_district": "bigint",
    "dol_vehicle_id": "string",
    "vehicle_location": "string",
    "electric_utility": "string",
    "census_tract_2020": "string",
    "electric_range_miles": "bigint",
    "ev_type_code": "string",
    "cafv_status": "string",
    "is_washington": "boolean",
    "longitude": "double",
    "latitude": "double",
}


def first(raw, spark, contract, **cells):
    raw.with_(0, **cells)
    raw.rows = raw.rows[:1]
    return only(raw.clean(spark, contract))


def test_schema(spark, contract, raw):
    cleaned = clean(raw.frame(spark), contract)
    assert {f.name: f.dataType.simpleString() for f in cleaned.schema} == CLEAN_TYPES
    assert list(cleaned.columns) == list(CLEAN_TYPES)
    assert cleaned.count() == 2


def test_values(spark, contract, raw):
    row = first(raw, spark, contract)
    assert (row["ev_type_code"], row["cafv_status"], row["is_washington"]) == ("BEV", "Eligible", True)
    assert (row["longitude"], row["latitude"]) == (-118.25, 46.125)
    assert row["dol_vehicle_id"] == "104020301" and row["model_year"] == 2018


def test_zero_range_is_missing_only_in_the_derived_column(spark, contract, raw):
    row = first(raw, spark, contract, electric_range_raw="0")
    assert (row["electric_range_raw"], row["electric_range_miles"]) == (0, None)


def test_text(spark, contract, raw):
    row = first(
        raw, spark, contract, make="  velomar  ", county="Larch   County", city=" ", state=" wa",
        vin_prefix="7tsta0ev1a",
    )
    assert (row["make"], row["county"], row["city"]) == ("VELOMAR", "Larch County", None)
    assert (row["state"], row["is_washington"], row["vin_prefix"]) == ("WA", True, "7TSTA0EV1A")


def test_postal_codes(spark, contract, raw):
    assert first(raw, spark, contract, postal_code="1234")["postal_code"] == "01234"
    assert first(raw, spark, contract, postal_code="123")["postal_code"] == "123"
    assert first(raw, spark, contract, postal_code=None)["postal_code"] is None


def test_leading_zeros_of_identifiers_survive(spark, contract, raw):
    row = first(raw, spark, contract, dol_vehicle_id="007", census_tract_2020="01001020100")
    assert (row["dol_vehicle_id"], row["census_tract_2020"]) == ("007", "01001020100")


def test_nulls_stay_null(spark, contract, raw):
    row = first(raw, spark, contract, electric_range_raw=None, vehicle_location=None, state=None)
    names = ("electric_range_raw", "electric_range_miles", "longitude", "latitude", "is_washington")
    assert [row[name] for name in names] == [None] * 5


def test_points_out_of_bounds_keep_their_coordinates(spark, contract, raw):
    row = first(raw, spark, contract, vehicle_location="POINT (500 200)")
    assert (row["longitude"], row["latitude"]) == (500.0, 200.0)
    row = first(raw, spark, contract, vehicle_location="POINT  (1  2)")
    assert (row["longitude"], row["vehicle_location"]) == (1.0, "POINT (1 2)")


def test_unmapped_labels_and_fractions(spark, contract, raw):
    row = first(raw, spark, contract, ev_type="Steam", legislative_district="27.5", model_year="x")
    assert (row["ev_type_code"], row["legislative_district"], row["model_year"]) == (None, 27, None)


def test_no_row_is_dropped_or_merged(spark, contract, raw):
    raw.more(0).more(0, county=None, state="OR")
    assert raw.clean(spark, contract).count() == 4


def test_input_is_untouched(spark, contract, raw):
    df = raw.frame(spark)
    before = df.collect()
    clean(df, contract).collect()
    assert df.collect() == before


def test_look_up(spark):
    df = spark.sql("SELECT * FROM VALUES ('a'), ('b'), (NULL) AS t(label)")
    codes = spark.sql("SELECT * FROM VALUES ('a', 1) AS t(l, c)")
    found = look_up(df, "label", codes, "code").collect()
    assert {(r.label, r.code) for r in found} == {("a", 1), ("b", None), (None, None)}
