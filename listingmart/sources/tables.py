"""Stored tables: where they go, how they are written and read, and their SQL names."""

from __future__ import annotations

import tempfile
from collections.abc import Collection, Mapping, Sequence
from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LONG_PARTITIONS = ("market", "month")


def work_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's ``spark.checkpoint.dir``. Only a local
    session without that setting gets a temporary folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors can reach.")
    return tempfile.mkdtemp(prefix="listingmart-")


def save_processed(
    df: DataFrame, folder: str, name: str, *, partition_by: Sequence[str] = LONG_PARTITIONS, regroup: bool = True
) -> str:
    """Write one Parquet dataset and return its path.

    Rows are regrouped by partition value before the write, which keeps the number of files low; an
    adaptive session splits the values that hold most of the rows over several writers. ``regroup=False`` is for
    rows that were grouped so before.
    """
    path = f"{folder}/{name}.parquet"
    columns = [c for c in partition_by if c in df.columns]
    grouped = df.hint("rebalance", *columns) if columns and regroup else df
    grouped.write.mode("overwrite").partitionBy(*columns).parquet(path)
    release_shuffles(df.sparkSession)
    return path


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished writes. It does so when the driver happens to collect its garbage, which may be
    after the next table was shuffled too; until then every table's rows lie on disk once more."""
    spark._jvm.System.gc()


def load_processed(
    spark: SparkSession, folder: str, name: str, schema: StructType | str | None = None
) -> DataFrame:
    """A stored dataset; with its schema it can be read even when no partition of it has rows."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}.parquet")


# Columns without which a stored listing cannot be keyed.
LOCATED = ("lat", "lon", "area_m2", "price", "month")


def valid_located(df: DataFrame) -> DataFrame:
    """Listings with a place, a month and positive price and area."""
    absent = [c for c in LOCATED if c not in df.columns]
    if absent:
        raise ValueError(f"Required column missing from parquet: {', '.join(absent)}")
    return df.dropna(subset=list(LOCATED)).filter((F.col("area_m2") > 0) & (F.col("price") > 0))


def load_parquet_filtered(spark: SparkSession, path: str) -> DataFrame:
    return valid_located(spark.read.parquet(path))


def export_csv(df: DataFrame, path: str) -> str:
    """Write a table as CSV with a header line in every file."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def union_markets(sale: DataFrame, rent: DataFrame) -> DataFrame:
    """Both markets in one table, columns matched by name."""
    return sale.unionByName(rent, allowMissingColumns=True)


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Make tables available to SQL under their names (SHOW TABLES, DESCRIBE, SELECT)."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def replace_months(df: DataFrame, path: str, months: Collection[date]) -> None:
    """Write rows of the given months over the stored ones. A month without rows loses its partition, which a dynamic
    overwrite alone would keep. Which months have rows is learned from the write itself."""
    seen = Observation()
    observed = df.observe(seen, F.collect_set("month").alias("filled"))
    (
        observed.hint("rebalance", "month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .parquet(path)
    )
    try:
        filled = set(seen.get["filled"])
    except Py4JJavaError:  # an input that is known to be empty is not run, so nothing was observed
        filled = {row.month for row in df.select("month").distinct().collect()}
    for month in set(months) - filled:
        remove_folder(df.sparkSession, f"{path}/month={month}")
    df.sparkSession.catalog.refreshByPath(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark understands it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system its path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
