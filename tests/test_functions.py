"""Scalar expressions."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingmart.functions import coercion
from listingmart.functions.bins import add_bins
from listingmart.functions.fingerprint import (
    FingerprintConfig,
    add_property_fingerprint,
    quantize,
    round_half_even,
)
from listingmart.functions.labels import display_names, label_for_value
from listingmart.schema import column_label

TEXT = T.StringType()


def one(spark, values, schema, expression):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"c {schema}").select(expression).collect()]


def test_numbers(spark):
    texts = [" 12 ", "1e5", "1.0d", "0x10", "1_0", ".5", "n/a", "NaN", "", None, "-inf", "+3."]
    found = one(spark, texts, "string", coercion.to_number("c", TEXT))
    assert found == [12.0, 1e5, None, None, None, 0.5, None, None, None, None, float("-inf"), 3.0]
    assert one(spark, [float("nan"), 2.0], "double", coercion.to_number("c", T.DoubleType())) == [None, 2.0]
    assert one(spark, [True], "boolean", coercion.to_number("c", T.BooleanType())) == [1.0]


def test_sentinel_and_integer_rounding(spark):
    assert one(spark, ["-999999", "4", "x"], "string", coercion.to_whole_number("c", TEXT)) == [None, 4.0, None]
    found = one(spark, [2.5, 3.5, 2.7, -999999.0, 1e12, None], "double", coercion.to_int("c"))
    assert found == [2, 4, 3, None, None, None]


def test_booleans(spark):
    texts = ["yes", " TRUE ", "\tt", "1.0", "N", "false", "0", "maybe", None]
    found = one(spark, texts, "string", coercion.to_boolean("c", TEXT))
    assert found == [True, True, True, True, False, False, False, None, None]
    assert one(spark, [1, 0, 2], "int", coercion.to_boolean("c", T.IntegerType())) == [True, False, None]
    assert one(spark, [True, None], "boolean", coercion.to_boolean("c", T.BooleanType())) == [True, None]


def test_city_and_slug(spark):
    texts = ["  WARSZAWA ", "Nowy  \t Dwór", None]
    assert one(spark, texts, "string", coercion.normalize_city("c")) == ["warszawa", "nowy dwór", None]
    assert one(spark, [" Praga  Północ "], "string", coercion.slug("c")) == ["praga_północ"]


def test_month(spark):
    found = one(spark, ["2024-06-01", "soon", None], "string", coercion.to_month("c", TEXT))
    assert [str(v) for v in found] == ["2024-06-01", "None", "None"]


def test_rounding_is_half_even(spark):
    values = [0.00005, 0.00015, 52.12345, 52.12355, 20.99999, -0.00025]
    found = one(spark, values, "double", round_half_even(F.col("c"), 4))
    assert found == list(np.round(values, 4))
    assert one(spark, [49.9, 50.1, 2.5, 3.5], "double", quantize(F.col("c"), 1.0)) == [50.0, 50.0, 2.0, 4.0]
    with pytest.raises(ValueError):
        quantize(F.col("c"), 0)


def test_fingerprint_text_and_typed_columns(spark):
    df = spark.createDataFrame(
        [(52.12345, 21.0, 49.6, "sale", None, 3.0, None, True), (52.12345, 21.0, 49.6, "sale", "tenement", None, False, None)],
        "lat double, lon double, area_m2 double, market string, listing_type string, floor double, "
        "has_elevator boolean, has_balcony boolean",
    )
    rows = add_property_fingerprint(df).collect()
    assert rows[0]["property_fingerprint"] == "52.1234|21.0|50.0|sale|<NA>|3.0|0|1"
    assert rows[1]["property_fingerprint"] == "52.1234|21.0|50.0|sale|tenement|-999999.0|0|0"
    assert rows[0]["has_elevator"] is None and rows[0]["floor"] == 3.0
    whole = df.withColumn("floor", F.col("floor").cast("int"))
    assert [r["property_fingerprint"] for r in add_property_fingerprint(whole).collect()] == [
        r["property_fingerprint"] for r in rows
    ]
    coarse = FingerprintConfig(lat_round=0, lon_round=0, area_step=20.0, fingerprint_cols=("market", "absent"))
    assert add_property_fingerprint(df, coarse).first()["property_fingerprint"] == "52.0|21.0|40.0|sale"
    with pytest.raises(ValueError, match="lat"):
        add_property_fingerprint(df.drop("lat"))


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame(
        [(5, 6, 1900), (-1, 20, 1901), (21, None, 2021), (None, 15, 2020)],
        "floor int, floors_total int, build_year int",
    )
    rows = add_bins(df).collect()
    assert [r["floor_bin"] for r in rows] == ["0-5", "0-5", "20+", None]
    assert [r["floors_total_bin"] for r in rows] == ["5-10", "15-20", None, "10-15"]
    assert [r["build_year_bin"] for r in rows] == ["Before 1900", "1900-1950", "2020+", "2010-2020"]
    assert [r["build_year_bin_ord"] for r in rows] == [0, 1, 7, 6]
    assert add_bins(df.drop("floor")).columns[-1] == "build_year_bin_ord"


def test_labels(spark):
    assert one(spark, ["low", "other", None], "string", label_for_value("condition", F.col("c"))) == [
        "Standard", "other", None,
    ]
    assert column_label("price") == "Price (PLN)" and column_label("some_thing") == "Some Thing"
    values = spark.createDataFrame(
        [("condition", "low"), ("condition", "Standard"), ("city", "x")], "column string, raw string"
    )
    found = {(r["raw"], r["display"]) for r in display_names(values).collect()}
    assert found == {("Standard", "Standard"), ("low", "Standard [low]"), ("x", "x")}
