"""Build jobs: raw monthly files to stored long tables, and stored tables to SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingmart.functions.fingerprint import FingerprintConfig
from listingmart.operators.clean import clean_base
from listingmart.operators.districts import DistrictLayer, build_layer
from listingmart.plans.incremental import MART_SCHEMA, STATE_SCHEMA, mart_of_state, state_of
from listingmart.plans.marts import MART_COLUMNS, listing_tables, mart_yield_proxy
from listingmart.schema import MARKETS
from listingmart.sources.geojson import read_districts
from listingmart.sources.monthly_csv import load_monthly, rows_about
from listingmart.sources.tables import load_processed, register_views, save_processed

LONG_NAME = "{market}_long"


def build_dataset(
    spark: SparkSession,
    raw_folder: str,
    out_folder: str,
    districts_path: str | None = None,
    *,
    cfg: FingerprintConfig | None = None,
) -> dict[str, str]:
    """Clean ``<raw_folder>/sale`` and ``<raw_folder>/rent`` and store them as ``sale_long`` and
    ``rent_long``, partitioned by month. Returns the paths."""
    layer = build_layer(read_districts(spark, districts_path)) if districts_path else None
    paths = {}
    for market in MARKETS:
        raw = load_monthly(spark, f"{raw_folder}/{market}", market)
        rows = rows_about(spark, f"{raw_folder}/{market}")
        long = clean_base(raw, layer, cfg=cfg, by_month=True, rows=rows)
        paths[market] = save_processed(
            long, out_folder, LONG_NAME.format(market=market), partition_by=("month",), regroup=False
        )
    return paths


def store_long_table(
    raw: DataFrame, layer: DistrictLayer | None, folder: str, name: str = "listings_long"
) -> str:
    """Clean raw listings of any markets into one table partitioned by market and month."""
    return save_processed(clean_base(raw, layer, by_month=True, rows=raw.count()), folder, name, regroup=False)


def build_database(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Open the stored long tables, derive every analysis table and register them for SQL. Static
    tables, marts and the state they are read from are stored by month, so that reports on the latest
    months prune and a refresh writes single months, and opened again, because every later report reads
    them."""
    long = {m: load_processed(spark, folder, LONG_NAME.format(market=m)) for m in MARKETS}
    tables = listing_tables(long["sale"], long["rent"])
    static = {}
    for market in MARKETS:
        name = f"listings_{market}_static"
        save_processed(tables[name], folder, name, partition_by=("month",))
        static[market] = load_processed(spark, folder, name)
        tables[name] = static[market]
    tables["listings_static_all"] = static["sale"].unionByName(static["rent"], allowMissingColumns=True)
    marts = [f"mart_city_month_{market}" for market in MARKETS]
    for market, name in zip(MARKETS, marts, strict=True):
        state = f"mart_state_{market}"
        save_processed(state_of(long[market]), folder, state, partition_by=("month",))
        save_processed(mart_of_state(load_processed(spark, folder, state, STATE_SCHEMA)), folder, name, partition_by=("month",))
        tables[name] = load_processed(spark, folder, name, MART_SCHEMA).select(*MART_COLUMNS)
    proxy = "mart_city_month_yield_proxy"
    both = mart_yield_proxy(*(tables[name] for name in marts))
    save_processed(both, folder, proxy, partition_by=("month",))
    tables[proxy] = load_processed(spark, folder, proxy, both.schema)
    register_views(tables)
    return tables


def load_static(spark: SparkSession, market: str) -> DataFrame:
    """Static table of a market by its SQL name."""
    return spark.table(f"listings_{market}_static")


def load_mart(spark: SparkSession, name: str) -> DataFrame:
    """A monthly mart (``sale``, ``rent`` or ``yield_proxy``) in month order."""
    return spark.table(f"mart_city_month_{name}").orderBy(F.col("month"), F.col("city"))
