"""Derived tables that follow the months of the long table.

`mart_state` holds a value histogram per (month, city) and metric. Histograms merge by adding counts, so the monthly
marts, and quantiles over any span of months, are read from it without the listings. The static table is kept by key. When
months arrive, are delivered again or are withdrawn, only their state and mart partitions are written anew, and of the
static table only the months that gain or lose a row.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingmart.operators.dedup import FINGERPRINT, one_row_per_property
from listingmart.operators.quantiles import histogram_quantiles, value_histogram
from listingmart.plans.marts import MART_PROBS, mart_yield_proxy, named_mart
from listingmart.schema import MARKETS
from listingmart.sources.tables import replace_months, work_folder

METRICS = ("price_per_m2", "price", "area_m2")
MART_METRIC = "price_per_m2"

# Stored tables that may have no rows, and so no file to tell their columns.
STATE_SCHEMA = "month date, city string, metric string, v double, n bigint"
MART_SCHEMA = "month date, city string, n_listings bigint, median_ppm2 double, p25_ppm2 double, p75_ppm2 double, avg_ppm2 double"


def state_of(long: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """``month, city, metric, v, n``: how often each value occurs. Null months and cities are groups of their own."""
    return value_histogram(long, {m: m for m in metrics}, ("month", "city"), null_keys=True)


def mart_of_state(state: DataFrame) -> DataFrame:
    """The monthly mart of a state; equal to the mart of its listings."""
    hist = state.filter(F.col("metric") == MART_METRIC).select("month", "city", "v", "n")
    return named_mart(histogram_quantiles(hist, MART_PROBS, ["month", "city"]))


def quantiles_of_state(
    state: DataFrame, probs: Mapping[str, float], keys: Sequence[str] = (), months: Collection[date] | None = None
) -> DataFrame:
    """Quantiles per ``keys`` (of month and city) and metric, over all months or the given ones: counts of equal values add up."""
    chosen = state if months is None else state.filter(F.col("month").isin(list(months)))
    merged = chosen.groupBy(*keys, "metric", "v").agg(F.sum("n").alias("n"))
    return histogram_quantiles(merged, probs, [*keys, "metric"])


def refresh_mart(spark: SparkSession, long_path: str, state_path: str, mart_path: str, months: Collection[date]) -> None:
    """Bring state and mart up to date after the given months of the long table changed. Other months are not read."""
    changed = F.col("month").isin(list(months))
    replace_months(state_of(spark.read.parquet(long_path).filter(changed)), state_path, months)
    replace_months(mart_of_state(spark.read.schema(STATE_SCHEMA).parquet(state_path).filter(changed)), mart_path, months)


def refresh_static(
    spark: SparkSession, long_path: str, static_path: str, months: Collection[date], *, keys: Sequence[str] = (FINGERPRINT,)
) -> set[date]:
    """Bring the static table up to date after the given months of the long table changed; returns the months written.

    A key's row can change only if it is listed in such a month, or if its row came from one. In the first case the choice is
    between its new rows and the one it has. In the second that row may be gone, and the earlier months are searched for
    these keys alone. So a month that is withdrawn brings the earlier rows back, and a new month reads no other.
    """
    long, static = spark.read.parquet(long_path), spark.read.parquet(static_path)
    columns, changed = static.columns, F.col("month").isin(list(months))
    folder = f"{work_folder(spark)}/static-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    fresh = one_row_per_property(long.filter(changed), keys=keys, by_month=True).select(*columns)
    lost = kept(static.filter(changed).select(*keys), "lost")
    candidates = kept(fresh, "fresh")
    touched = candidates.select(*keys).unionByName(lost).distinct()
    if not lost.isEmpty():
        earlier = long.filter(~changed).join(lost, list(keys), "left_semi")
        candidates = candidates.unionByName(one_row_per_property(earlier, keys=keys, by_month=True).select(*columns))
    present = static.filter(~changed).join(touched, list(keys), "left_semi")
    best = one_row_per_property(candidates.unionByName(present.select(*columns)), keys=keys)

    # Rows that stay as they are need no writing.
    was = static.join(touched, list(keys), "left_semi").select(*keys, F.col("month").alias("was_month"), F.xxhash64(*columns).alias("was"))
    compared = best.select(*columns, F.xxhash64(*columns).alias("is")).join(was, list(keys), "full_outer")
    moved = kept(compared.filter("is IS NULL OR was IS NULL OR is != was"), "moved")
    found = moved.agg(F.collect_set("month").alias("new"), F.collect_set("was_month").alias("old")).first()
    written = {*found.new, *found.old}
    if not written:
        return written
    rest = static.filter(F.col("month").isin(list(written))).join(moved.select(*keys), list(keys), "left_anti")
    rows = kept(rest.select(*columns).unionByName(moved.filter("is IS NOT NULL").select(*columns)), "rows")
    replace_months(rows, static_path, written)
    return written


def refresh_derived(spark: SparkSession, folder: str, market: str, months: Collection[date]) -> None:
    """Renew what `build_database` stored for a market after the given months of its long table changed: mart state, mart,
    static table, and the yield mart of those months."""
    long = f"{folder}/{market}_long.parquet"
    refresh_mart(spark, long, f"{folder}/mart_state_{market}.parquet", f"{folder}/mart_city_month_{market}.parquet", months)
    refresh_static(spark, long, f"{folder}/listings_{market}_static.parquet", months)
    both = [spark.read.schema(MART_SCHEMA).parquet(f"{folder}/mart_city_month_{m}.parquet").filter(F.col("month").isin(list(months))) for m in MARKETS]
    replace_months(mart_yield_proxy(*both), f"{folder}/mart_city_month_yield_proxy.parquet", months)
