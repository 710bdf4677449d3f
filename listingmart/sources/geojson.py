"""District polygons from GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingmart.sources.json_objects import RANGE_BYTES, read_objects
from listingmart.sources.monthly_headers import can_open
from listingmart.sources.tables import qualified

RING = "array<array<double>>"

CRS = "struct<properties: struct<name: string>>"
FEATURE = "struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>"
# Names under which files state longitude/latitude on WGS 84; without a statement it is the default.
LON_LAT = r"(?i)(EPSG:+4326|CRS84)$"


def read_districts(spark: SparkSession, path: str, *, name_col: str = "name", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``name, rings`` of every Polygon and MultiPolygon feature. A ring is a list of [lon, lat].

    A large document is read by many tasks (`json_objects`), a single feature by one. A document on a file system that
    Python tasks cannot open is read by one task as a whole.
    """
    uri = qualified(spark, path)
    if can_open(uri):
        objects = read_objects(spark, uri, range_bytes=range_bytes)
        parts = objects.select(
            F.when(F.col("level") == 1, F.from_json("text", CRS)).getField("properties")["name"].alias("crs"),
            F.when(F.col("level") == 2, F.from_json("text", FEATURE)).alias("f"),
        )
        found = parts.filter("crs IS NOT NULL OR f.type = 'Feature'")
    else:
        document = spark.read.option("multiLine", True).schema(f"crs {CRS}, features array<{FEATURE}>").json(path)
        found = document.select(F.col("crs.properties.name").alias("crs"), F.explode_outer("features").alias("f"))
    named = F.map_contains_key("f.properties", F.lit(name_col))
    foreign, usable = found.agg(F.count_if(~F.col("crs").rlike(LON_LAT)), F.count_if(named)).first()
    if foreign:
        raise ValueError("Districts file is not in EPSG:4326.")
    if not usable:
        raise ValueError(f"No feature of the districts file has a property '{name_col}'.")
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    rings = F.when(kind == "Polygon", F.from_json(text, f"array<{RING}>")).when(
        kind == "MultiPolygon", F.flatten(F.from_json(text, f"array<array<{RING}>>"))
    )
    shapes = found.select(F.try_element_at("f.properties", F.lit(name_col)).alias("name"), rings.alias("rings"))
    return shapes.filter(F.col("rings").isNotNull())
