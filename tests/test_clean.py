"""Cleaning chain, deduplication and the district join."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingmart.operators import clean
from listingmart.operators.dedup import (
    deduplicate_within_month,
    one_row_per_property,
    within_month_removed,
)
from listingmart.operators.districts import assign_district, build_layer
from listingmart.sources.geojson import read_districts

SCHEMA = (
    "listing_id long, city string, listing_type string, area_m2 int, price int, month string, "
    "market string, rooms string, has_balcony string, lat double, lon double"
)


def sample(spark):
    return spark.createDataFrame(
        [
            (1, "Warszawa", "apartment", 50, 500000, "2024-06-01", "sale", "2", "true", 52.2, 21.0),
            (2, "Warszawa", "apartment", 0, 600000, "2024-06-01", "sale", "3", "false", 52.2, 21.0),
            (3, "Kraków", "apartment", 40, -10, "2024-06-01", "sale", "2", "yes", 52.2, 21.0),
        ],
        SCHEMA,
    )


def test_clean_base_on_the_sample(spark):
    out = clean.clean_base(sample(spark))
    rows = out.collect()
    assert [r["listing_id"] for r in rows] == [1]
    assert rows[0]["price_per_m2"] == 10000.0 and rows[0]["rooms"] == 2 and rows[0]["has_balcony"] is True
    types = {f.name: f.dataType for f in out.schema.fields}
    assert types["month"] == T.DateType() and types["rooms"] == T.IntegerType()
    assert types["has_balcony"] == T.BooleanType() and types["price_per_m2"] == T.DoubleType()


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="city"):
        clean.clean_base(spark.createDataFrame([(1, 1)], "price int, area_m2 int"))
    with pytest.raises(ValueError):
        clean.filter_city(spark.range(1))
    with pytest.raises(ValueError):
        deduplicate_within_month(spark.range(1))


def test_rows_without_coordinates_drop_out(spark):
    df = sample(spark).withColumn("lat", F.when(F.col("listing_id") > 1, F.col("lat")))
    assert clean.clean_base(df).count() == 0


LONG = "property_fingerprint string, month date, price double, listing_id string, note string"


def long_rows(spark, rows):
    return spark.createDataFrame(rows, "property_fingerprint string, month string, price double, listing_id string, note string").withColumn(
        "month", F.to_date("month")
    )


def test_deduplication_keeps_the_highest_price_of_a_month(spark):
    df = long_rows(
        spark,
        [("a", "2024-01-01", 1.0, "x", "n")] * 500
        + [("a", "2024-01-01", 5.0, "z", "n"), ("a", "2024-01-01", 5.0, "y", "n")]
        + [("a", "2024-02-01", 2.0, "x", "n"), ("b", "2024-01-01", None, "q", "n"), ("b", "2024-01-01", 0.5, "r", "n")],
    )
    kept = {(r["property_fingerprint"], str(r["month"]), r["listing_id"]) for r in deduplicate_within_month(df).collect()}
    assert kept == {("a", "2024-01-01", "y"), ("a", "2024-02-01", "x"), ("b", "2024-01-01", "r")}
    assert tuple(within_month_removed(df).first()) == (505, 3, 502)
    static = {(r["property_fingerprint"], str(r["month"])) for r in one_row_per_property(df).collect()}
    assert static == {("a", "2024-02-01"), ("b", "2024-01-01")}
    assert tuple(within_month_removed(df.limit(0)).first()) == (0, 0, 0)


def test_deduplication_limits_groups_before_the_shuffle(spark):
    df = long_rows(spark, [("a", "2024-01-01", 1.0, "x", "n")])
    plan = deduplicate_within_month(df)._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[exchange:], plan


HOUSE = [[0, 0], [4, 0], [4, 4], [2, 6], [0, 4], [0, 0]]
NOTCH = [[10, 0], [14, 0], [14, 4], [12, 1], [10, 4], [10, 0]]
HOLE = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]
ISLAND = [[20, 0], [21, 0], [21, 1], [20, 1], [20, 0]]
OVER = [[3, 0], [5, 0], [5, 4], [3, 4], [3, 0]]


def geojson(folder, features, crs=None):
    path = f"{folder}/districts.geojson"
    document = {"type": "FeatureCollection", "features": features}
    if crs:
        document["crs"] = {"type": "name", "properties": {"name": crs}}
    with open(path, "w") as f:
        json.dump(document, f)
    return path


def feature(name, kind, coordinates):
    return {"type": "Feature", "properties": {"name": name, "id": 7}, "geometry": {"type": kind, "coordinates": coordinates}}


def layer_of(spark, folder):
    path = geojson(
        folder,
        [
            feature("House", "Polygon", [HOUSE, HOLE]),
            feature(" Deep  Notch ", "MultiPolygon", [[NOTCH], [ISLAND]]),
            feature("Alpha", "Polygon", [OVER]),
            feature("Warszawa", "Polygon", [[[-99, -99], [99, -99], [99, 99], [-99, 99], [-99, -99]]]),
            feature(None, "Polygon", [ISLAND]),
        ],
        "urn:ogc:def:crs:OGC:1.3:CRS84",
    )
    return build_layer(read_districts(spark, path))


POINTS = {
    (0.5, 0.5): "house",
    (2.0, 5.5): "house",
    (0.5, 5.5): None,
    (1.5, 1.5): None,
    (3.5, 2.0): "alpha",
    (4.5, 2.0): "alpha",
    (12.0, 0.5): "deep_notch",
    (12.0, 3.0): None,
    (20.5, 0.5): "deep_notch",
    (0.0, 2.0): None,
    (2.0, 0.0): None,
    (50.0, 50.0): None,
}


@pytest.mark.parametrize("broadcast_edges", [10_000, 0])
def test_points_in_polygons(spark, folder, broadcast_edges):
    layer = layer_of(spark, folder)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in POINTS] + [(None, 1.0), (1.0, None)], "lon double, lat double")
    out = assign_district(df, layer, broadcast_edges=broadcast_edges)
    found = {(r["lon"], r["lat"]): r["district"] for r in out.collect()}
    assert found == POINTS and out.count() == len(POINTS) and out.columns == ["lon", "lat", "district"]
    inside = assign_district(df, layer, keep_outside=False, broadcast_edges=broadcast_edges)
    assert inside.count() == sum(d is not None for d in POINTS.values())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError, match="lat"):
        assign_district(df.drop("lat"), layer)


def test_district_file_errors(spark, folder):
    with pytest.raises(ValueError, match="4326"):
        read_districts(spark, geojson(folder, [feature("A", "Polygon", [HOUSE])], "urn:ogc:def:crs:EPSG::2180"))
    path = geojson(folder, [feature("A", "Polygon", [HOUSE])])
    with pytest.raises(ValueError, match="label"):
        read_districts(spark, path, name_col="label")
    with pytest.raises(ValueError):
        build_layer(read_districts(spark, geojson(folder, [feature("Warszawa", "Polygon", [HOUSE])])))
