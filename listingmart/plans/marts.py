"""Derived tables of a long listing table: static tables, unions and monthly marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmart.operators.dedup import one_row_per_property
from listingmart.operators.quantiles import quantiles_of
from listingmart.operators.yields import MONTHS_PER_YEAR
from listingmart.sources.tables import union_markets

MART_COLUMNS = ("month", "city", "n_listings", "median_ppm2", "p25_ppm2", "p75_ppm2", "avg_ppm2")

MART_PROBS = {"median_ppm2": 0.5, "p25_ppm2": 0.25, "p75_ppm2": 0.75}


def of_market(long: DataFrame, market: str) -> DataFrame:
    """Listings of one market; on the stored table this prunes to its folders."""
    return long.filter(F.col("market") == market)


def mart_city_month(listings: DataFrame) -> DataFrame:
    """Listings and price-per-m² quantiles by month and city, over all monthly records.
    Listings without a month or city form groups of their own."""
    return named_mart(quantiles_of(listings, "price_per_m2", MART_PROBS, ["month", "city"], null_keys=True))


def named_mart(found: DataFrame) -> DataFrame:
    """Group statistics under the mart's column names."""
    return found.select(
        "month",
        "city",
        F.col("n_rows").alias("n_listings"),
        "median_ppm2",
        "p25_ppm2",
        "p75_ppm2",
        F.col("mean").alias("avg_ppm2"),
    )


def mart_yield_proxy(sale_mart: DataFrame, rent_mart: DataFrame) -> DataFrame:
    """Yearly rent per m² as a fraction of the sale price per m², for months and cities that both
    marts have."""
    sale = sale_mart.select(
        "month", "city", F.col("n_listings").alias("n_sale"), F.col("median_ppm2").alias("sale_median_ppm2")
    )
    rent = rent_mart.select(
        "month", "city", F.col("n_listings").alias("n_rent"), F.col("median_ppm2").alias("rent_median_ppm2")
    )
    yearly = F.col("rent_median_ppm2") * F.lit(MONTHS_PER_YEAR)
    return sale.join(rent, ["month", "city"]).select(
        "month",
        "city",
        "n_sale",
        "n_rent",
        "sale_median_ppm2",
        "rent_median_ppm2",
        F.try_divide(yearly, F.col("sale_median_ppm2")).alias("gross_yield_proxy"),
    )


def listing_tables(sale: DataFrame, rent: DataFrame) -> dict[str, DataFrame]:
    """Every named table of the analysis database, lazily, from the two long tables."""
    static_sale, static_rent = one_row_per_property(sale, by_month=True), one_row_per_property(rent, by_month=True)
    mart_sale, mart_rent = mart_city_month(sale), mart_city_month(rent)
    return {
        "listings_sale": sale,
        "listings_rent": rent,
        "listings_all": union_markets(sale, rent),
        "listings_sale_static": static_sale,
        "listings_rent_static": static_rent,
        "listings_static_all": union_markets(static_sale, static_rent),
        "mart_city_month_sale": mart_sale,
        "mart_city_month_rent": mart_rent,
        "mart_city_month_yield_proxy": mart_yield_proxy(mart_sale, mart_rent),
    }
