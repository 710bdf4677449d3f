"""Monthly snapshot CSVs -> long raw table.

Columns are matched by name, per header: files with the same header share one scan, so the plan
grows with the number of different headers and not with the number of files. The headers are read by
one job (`monthly_headers`); only on a file system that Python tasks cannot open Spark's own reader
is asked for each.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Collection, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingmart.functions.coercion import missing_to_null
from listingmart.schema import RAW_TO_STANDARD
from listingmart.sources import monthly_headers
from listingmart.sources.monthly_headers import MONTH_IN_NAME, NO_MONTH, check_file_name
from listingmart.sources.tables import qualified

SURPLUS = "_surplus"

# How many headers the driver has Spark read at the same time, where tasks cannot open the files themselves.
HEADER_THREADS = 16


def month_of_name(name: Column) -> Column:
    """First day of the month a file name carries; fails the query when there is none."""
    year = F.regexp_extract(name, MONTH_IN_NAME, 1)
    month = F.regexp_extract(name, MONTH_IN_NAME, 2)
    absent = F.raise_error(F.concat(F.lit(NO_MONTH), name))
    return F.when(year == "", absent.cast("date")).otherwise(
        F.make_date(F.nullif(year, F.lit("")).cast("int"), F.nullif(month, F.lit("")).cast("int"), F.lit(1))
    )


def standardize_columns(df: DataFrame, mapping: dict[str, str] = RAW_TO_STANDARD) -> DataFrame:
    """Rename raw columns; unknown ones keep their names."""
    return df.withColumnsRenamed(mapping)


def list_csv_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the folder's CSV files (names only, no content is read)."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,csv.gz}").load(folder)
    return sorted(row.path for row in listing.select("path").collect())


# About how many bytes a row takes in a file; decides the number of tasks only.
ROW_BYTES, PACKED_ROW_BYTES = 160, 32


def rows_about(spark: SparkSession, folder: str) -> int:
    """About how many rows a folder's CSV files hold, by the files' sizes (no content is read)."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,csv.gz}").load(folder)
    each = F.ceil(F.col("length") / F.when(F.col("path").endswith(".gz"), PACKED_ROW_BYTES).otherwise(ROW_BYTES))
    return listing.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]


def _options(reader, multi_line: bool):
    return reader.options(header=True, quote='"', escape='"', multiLine=multi_line)


def headers_of(
    spark: SparkSession, folder: str, months: Collection[date] | None = None
) -> dict[tuple[str, ...], list[str]]:
    """Paths of a folder's CSV files by their header, of the given months or of all. The driver gets one row per file,
    as it does when Spark plans a scan of them."""
    uri = qualified(spark, folder)
    by_header: dict[tuple[str, ...], list[str]] = defaultdict(list)
    if monthly_headers.can_open(uri):
        monthly_headers.register(spark)
        try:
            found = spark.read.format(monthly_headers.FORMAT).load(uri)
            if months is not None:
                found = found.filter(F.col("month").isin(list(months)))
            rows = sorted(found.select("path", "header").collect())
        except AnalysisException as error:  # raised while the source plans, around the error of its own
            named = re.search(f"{NO_MONTH}.*", str(error))
            raise ValueError(named[0]) if named else error from None
        for row in rows:
            by_header[tuple(row.header)].append(row.path)
        return by_header
    files = [f for f in list_csv_files(spark, uri) if months is None or check_file_name(f.rsplit("/", 1)[-1]) in months]
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        for path, header in zip(files, pool.map(lambda f: tuple(_options(spark.read, True).csv(f).columns), files)):
            by_header[header].append(path)
    return by_header


def read_csv_files(
    spark: SparkSession, by_header: Mapping[tuple[str, ...], Sequence[str]], market: str, *, multi_line: bool = True
) -> DataFrame:
    """Long raw table of the given files: all fields as text, plus ``month`` and ``market``.

    Quoted fields may hold line breaks; a file is then read by one task. Where none does,
    ``multi_line=False`` lets Spark split files. A row with fewer fields than the header is filled up
    with nulls, one with more fails the query.
    """
    frames = []
    for header, paths in by_header.items():
        # One column more than the header has: it is null unless a row has too many fields.
        text = T.StructType([T.StructField(c, T.StringType()) for c in (*header, SURPLUS)])
        too_long = F.raise_error(F.concat(F.lit("Row with more fields than the header in "), F.col("_metadata.file_name")))
        raw = _options(spark.read, multi_line).schema(text).csv(list(paths))
        raw = raw.filter(F.when(F.col(SURPLUS).isNull(), True).otherwise(too_long.cast("boolean")))
        fields = [missing_to_null(F.col(f"`{c}`")).alias(c) for c in header]
        month = month_of_name(F.col("_metadata.file_name")).alias("month")
        frames.append(standardize_columns(raw.select(*fields, month, F.lit(market).alias("market"))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def load_monthly(
    spark: SparkSession, folder: str, market: str, *, months: Collection[date] | None = None
) -> DataFrame:
    """The monthly files of one market folder, all or those of some months."""
    by_header = headers_of(spark, folder, months)
    if not by_header:
        raise ValueError(f"{folder} has no CSV file of the {market} market.")
    return read_csv_files(spark, by_header, market)


def load_sale_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return load_monthly(spark, folder, "sale")


def load_rent_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return load_monthly(spark, folder, "rent")
