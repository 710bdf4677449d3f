"""Rental yield estimates: rent per m² against the median sale price per m² of a segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmart.functions.bins import natural_order
from listingmart.functions.labels import label_for_value
from listingmart.operators.joins import counted, join_groups
from listingmart.operators.quantiles import quantiles_of

PPM2 = "price_per_m2"
YIELD = "gross_yield_pct"
BENCHMARK = "sale_ppm2_benchmark"
MONTHS_PER_YEAR = 12.0

# The segments a yield report offers and its smallest group.
YIELD_CATEGORIES = (
    "district", "condition", "rooms", "listing_type", "floor_bin", "floors_total_bin", "build_year_bin",
)
MIN_GROUP = 10


def _group_bound(category: str) -> int | None:
    labels = natural_order(category)
    return len(labels) if labels is not None else None


def sale_benchmark(
    sale: DataFrame, category: str, *, ppm2_col: str = PPM2, benchmark_col: str = BENCHMARK
) -> DataFrame:
    """Median sale price per m² by category; listings without a category are left out."""
    found = quantiles_of(
        sale, ppm2_col, {"median": 0.5}, [category], max_groups=_group_bound(category)
    )
    return found.select(category, F.col("median").alias(benchmark_col))


def make_yield_df(
    sale: DataFrame,
    rent: DataFrame,
    category: str,
    *,
    rent_ppm2_col: str = PPM2,
    sale_ppm2_col: str = PPM2,
    annualization: float = MONTHS_PER_YEAR,
    yield_col: str = YIELD,
    benchmark_col: str = BENCHMARK,
) -> DataFrame:
    """Rent listings with the benchmark of their category and the yield in percent. The benchmark is
    computed once and counted, which decides how it is joined."""
    bench, rows = counted(
        sale_benchmark(sale, category, ppm2_col=sale_ppm2_col, benchmark_col=benchmark_col)
    )
    joined = join_groups(rent, bench, [category], rent_ppm2_col, small_rows=rows)
    yearly = F.col(rent_ppm2_col) * F.lit(float(annualization))
    return joined.withColumn(yield_col, F.try_divide(yearly, F.col(benchmark_col)) * 100)


def yield_summary(df: DataFrame, group_col: str, *, yield_col: str = YIELD) -> DataFrame:
    """Yield statistics per group, highest median first."""
    found = quantiles_of(
        df,
        yield_col,
        {"median": 0.5, "p25": 0.25, "p75": 0.75},
        [group_col],
        max_groups=_group_bound(group_col),
    )
    return found.select(group_col, "n", "median", "p25", "p75", "mean").orderBy(
        F.desc_nulls_last("median"), group_col
    )


def yield_by_category(
    sale: DataFrame, rent: DataFrame, category: str, *, min_n: int = MIN_GROUP
) -> DataFrame:
    """Summary of the groups with at least ``min_n`` rent listings, with display labels."""
    summary = yield_summary(make_yield_df(sale, rent, category), category)
    return summary.filter(F.col("n") >= min_n).withColumn(
        "label", label_for_value(category, F.col(category))
    )


def median_of_groups(summary: DataFrame) -> DataFrame:
    """One row: number of groups and the median over their medians."""
    return quantiles_of(summary, "median", {"median": 0.5}).select(
        F.col("n_rows").alias("n_groups"), F.col("median").alias("yield_median")
    )
