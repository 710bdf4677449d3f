"""Spark sessions."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# The cleaning chain projects some thirty columns at once. Beyond 8000 bytes the JVM does not compile
# a method, so such a stage runs faster when it is generated in several smaller ones.
HUGE_METHOD_LIMIT = "8000"

# Test data is small: without this, adaptive execution folds it into one or two tasks.
MIN_PARTITION_SIZE = "64k"


def local_session(name: str = "listingmart", cpus: str | None = None) -> SparkSession:
    """Session for tests and local runs. On a cluster use the one the cluster provides; only the
    adaptive execution that every plan here counts on has to be on (it is by default)."""
    cores = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.hugeMethodLimit", HUGE_METHOD_LIMIT)
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", MIN_PARTITION_SIZE)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
