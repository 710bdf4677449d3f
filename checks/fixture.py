"""Listing-shaped inputs made from the driver's tables.

The SQL text is valid in Spark and in DuckDB, so that both sides of a check read the same rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingmart.schema import RAW_TO_STANDARD

RAW_SQL = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS listing_id,
  CASE WHEN l_suppkey % 3 = 0 THEN 'rent' ELSE 'sale' END AS market,
  CASE l_suppkey % 5 WHEN 0 THEN 'Kraków' WHEN 1 THEN '  WARSZAWA ' ELSE 'Warszawa' END AS city,
  CASE p_size % 3 WHEN 0 THEN 'tenement' WHEN 1 THEN 'blockOfFlats' ELSE 'apartmentBuilding' END AS listing_type,
  CASE WHEN l_orderkey % 97 = 0 THEN '0' WHEN l_orderkey % 101 = 0 THEN 'n/a'
       ELSE CAST(20 + p_size + (l_linenumber % 2) * 0.3e0 AS STRING) END AS area_m2,
  CASE WHEN l_orderkey % 89 = 0 THEN '-10'
       ELSE CAST(CASE WHEN l_suppkey % 3 = 0 THEN l_extendedprice / 200e0 ELSE l_extendedprice END AS STRING) END AS price,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
  CAST(1 + p_size % 6 AS STRING) AS rooms,
  CASE WHEN p_partkey % 11 = 0 THEN '-999999' WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size % 25 AS STRING) END AS floor,
  CAST(p_partkey % 30 AS STRING) AS floors_total,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(1890 + p_partkey % 140 AS STRING) END AS build_year,
  CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE CAST(521000 + (p_partkey * 37) % 2600 AS DOUBLE) / 10000 END AS lat,
  CAST(208500 + (p_partkey * 53) % 4200 AS DOUBLE) / 10000 AS lon,
  CAST((p_partkey * 7) % 150 AS DOUBLE) / 10 AS centre_distance,
  CAST(p_partkey % 60 AS STRING) AS poi_count,
  CAST((p_partkey * 11) % 90 AS DOUBLE) / 10 AS school_distance,
  CAST((p_partkey * 13) % 80 AS DOUBLE) / 10 AS clinic_distance,
  CAST((p_partkey * 17) % 70 AS DOUBLE) / 10 AS post_office_distance,
  CAST((p_partkey * 19) % 60 AS DOUBLE) / 10 AS kindergarten_distance,
  CAST((p_partkey * 23) % 50 AS DOUBLE) / 10 AS restaurant_distance,
  CAST((p_partkey * 29) % 120 AS DOUBLE) / 10 AS college_distance,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST((p_partkey * 31) % 40 AS DOUBLE) / 10 END AS pharmacy_distance,
  CASE p_partkey % 3 WHEN 0 THEN 'condominium' WHEN 1 THEN 'cooperative' ELSE NULL END AS ownership,
  CASE p_partkey % 5 WHEN 0 THEN 'brick' WHEN 1 THEN 'concreteSlab' WHEN 2 THEN NULL ELSE 'brick' END AS building_material,
  CASE WHEN p_partkey % 2 = 0 THEN 'low' ELSE 'premium' END AS condition,
  CASE p_partkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'N' WHEN 2 THEN 'maybe' ELSE 'y' END AS has_parking_space,
  CASE p_partkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN NULL ELSE 'T' END AS has_balcony,
  CASE p_partkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' WHEN 2 THEN NULL ELSE ' TRUE ' END AS has_elevator,
  CASE p_partkey % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'False' ELSE 'true' END AS has_security,
  CASE WHEN p_partkey % 8 = 0 THEN NULL WHEN p_partkey % 8 < 4 THEN 'YES' ELSE 'no' END AS has_storage_room
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

# District grid: three rows of six rectangles, laid from south to north and west to east.
GRID_LAT, GRID_LON = 52.10005, 20.85005
ROW_HEIGHT, COLUMN_WIDTH = 0.09, 0.07
GRID_COLUMNS = 6
GRID_NAMES = (
    "Bemowo", "Białołęka", "Bielany", "Mokotów", "Ochota", "Praga Południe",
    " Praga  Północ", "Rembertów", "Śródmieście", "Targówek", "Ursus", "Ursynów",
    "Wawer", "Wesoła", "Wilanów", "Włochy", "Wola", "Żoliborz",
)


def rectangles() -> list[tuple[str, float, float, float, float]]:
    """``name, lon0, lat0, lon1, lat1`` of every grid district."""
    out = []
    for i, name in enumerate(GRID_NAMES):
        lat0 = GRID_LAT + (i // GRID_COLUMNS) * ROW_HEIGHT
        lon0 = GRID_LON + (i % GRID_COLUMNS) * COLUMN_WIDTH
        out.append((name, lon0, lat0, lon0 + COLUMN_WIDTH, lat0 + ROW_HEIGHT))
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores when the files have fewer readable pieces than the cluster has cores, as the
    one-row-group test files do. Files of real size are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = RAW_SQL.replace("FROM lineitem JOIN part", "FROM {lineitem} JOIN {part}")
    return spark.sql(text, lineitem=spread(lines, "l_orderkey", "l_linenumber"), part=parts)


def district_polygons(spark: SparkSession) -> DataFrame:
    """The grid as polygons, together with the whole-city polygon that the layer has to drop."""
    boxes = rectangles()
    boxes.append(("Warszawa", GRID_LON, GRID_LAT, boxes[-1][3], boxes[-1][4]))
    rows = ", ".join(
        f"('{name}', array(array({', '.join(f'array({x!r}D, {y!r}D)' for x, y in ring)})))"
        for name, x0, y0, x1, y1 in boxes
        for ring in [((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(name, rings)")


# File names carry months of this century; the test tables end in the last one.
LATER_MONTHS = 120
# Months whose files have another column order and a column of their own, and months whose files lack a column that no key needs.
REORDERED, LACKING, LACKED = 1, 2, "condition"


def write_monthly_files(raw: DataFrame, folder: str) -> None:
    """Raw listings as ``<folder>/<market>/<market>_<year>_<month>-<n>.csv.gz`` with raw headers, of which there are three."""
    headers = {standard: header for header, standard in RAW_TO_STANDARD.items()}
    name = F.concat_ws("_", "market", F.date_format(F.add_months("month", LATER_MONTHS), "yyyy_MM")).alias("name")
    staging = f"{folder}/staging"
    for kind in range(3):
        names = [c for c in headers if c != LACKED or kind != LACKING]
        fields = [F.col(c).cast("string").alias(headers[c]) for c in (reversed(names) if kind == REORDERED else names)]
        note = [F.lit('seen, "twice"\nor more').alias("note")] if kind == REORDERED else []
        rows = raw.filter(F.month("month") % 3 == kind).select("market", name, *fields, *note)
        writer = rows.hint("rebalance", "market", "name").write.mode("append").partitionBy("market", "name")
        writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, compression="gzip").csv(staging)
    spark = raw.sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(staging).getFileSystem(spark._jsc.hadoopConfiguration())
    written = spark.read.format("binaryFile").options(pathGlobFilter="*.csv.gz", recursiveFileLookup=True).load(staging).select("path")
    for n, row in enumerate(sorted(written.collect())):
        market, month = (part.split("=")[1] for part in row.path.split("/")[-3:-1])
        files.mkdirs(path_of(f"{folder}/{market}"))
        files.rename(path_of(row.path), path_of(f"{folder}/{market}/{month}-{n}.csv.gz"))


def write_districts(spark: SparkSession, path: str) -> None:
    """The polygons of the fixture as one GeoJSON document: the first as a MultiPolygon, with a point that is no district."""
    features = [{"type": "Feature", "properties": {"name": None, "kind": "station"}, "geometry": {"type": "Point", "coordinates": [21.0, 52.2]}}]
    for n, row in enumerate(district_polygons(spark).collect()):
        shape = {"type": "Polygon", "coordinates": row.rings} if n else {"type": "MultiPolygon", "coordinates": [row.rings]}
        features.append({"type": "Feature", "properties": {"name": row.name}, "geometry": shape})
    document = json.dumps({"type": "FeatureCollection", "features": features}, indent=1)
    spark.createDataFrame([(document,)], "value string").write.text(path)
