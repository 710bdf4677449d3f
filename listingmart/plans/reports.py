"""The four reports of the application, each as a set of small result tables."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmart.functions.bins import add_bins
from listingmart.operators.filters import build_view, default_filter_spec
from listingmart.operators.stats import (
    box_by_category,
    clipped_median,
    histogram,
    listing_kpis,
    ols_trendline,
    preview,
    scatter_points,
)
from listingmart.operators.trends import as_percent, latest_change, month_trends
from listingmart.operators.yields import YIELD_CATEGORIES, median_of_groups, yield_by_category
from listingmart.schema import AMENITY_COLUMNS, VALUE_LABELS

# The settings of the report charts.
CLIPPED = ("price_per_m2", "price", "area_m2")
HISTOGRAM_BINS = 60
DISTRICT_MIN_N = 10
CATEGORY_MIN_N = 30
SCATTER_X = "centre_distance"
BOX_CATEGORY = "build_year_bin"
BOX_CATEGORIES = (
    *VALUE_LABELS, "floor_bin", "floors_total_bin", "build_year_bin", *AMENITY_COLUMNS,
)


def market_report(
    static: DataFrame,
    filters: Mapping[str, Any] | None = None,
    *,
    scatter_x: str = SCATTER_X,
    box_category: str = BOX_CATEGORY,
) -> dict[str, DataFrame]:
    """Sale or rent report over the static table of the market. Without filters the untouched
    controls apply; their ``_clip`` entry switches clipping."""
    spec = dict(default_filter_spec(static) if filters is None else filters)
    clip = bool(spec.pop("_clip", True))
    view, bounds = build_view(static, filter_spec=spec, clip_cols=CLIPPED, clip=clip)
    view = add_bins(view)
    return {
        "kpis": listing_kpis(view),
        "trends": month_trends(view),
        "histogram": histogram(view, "price_per_m2", bounds=bounds, bins=HISTOGRAM_BINS),
        "histogram_median": clipped_median(view, "price_per_m2", bounds=bounds),
        "district_boxes": box_by_category(
            view, "price_per_m2", "district", bounds=bounds, min_n=DISTRICT_MIN_N
        ),
        "category_boxes": box_by_category(
            view, "price_per_m2", box_category, bounds=bounds, min_n=CATEGORY_MIN_N
        ),
        "scatter": scatter_points(view, scatter_x, "price_per_m2", bounds=bounds),
        "trendline": ols_trendline(view, scatter_x, "price_per_m2", bounds=bounds),
        "preview": preview(view),
    }


def yield_report(
    sale_static: DataFrame,
    rent_static: DataFrame,
    category: str = YIELD_CATEGORIES[0],
    filters: Mapping[str, Any] | None = None,
) -> dict[str, DataFrame]:
    """Yield by category. Filters apply to rent only; the benchmark is taken over all sales."""
    spec = dict(default_filter_spec(rent_static) if filters is None else filters)
    spec.pop("_clip", None)
    rent, _ = build_view(rent_static, filter_spec=spec)
    summary = yield_by_category(add_bins(sale_static), add_bins(rent), category)
    return {
        "listings": rent.agg(F.count(F.lit(1)).alias("n_listings")),
        "summary": summary,
        "groups": median_of_groups(summary),
    }


def time_series_report(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Monthly series and their latest changes, from the marts."""
    sale = tables["mart_city_month_sale"]
    rent = tables["mart_city_month_rent"]
    proxy = tables["mart_city_month_yield_proxy"].withColumn(
        "gross_yield_pct", as_percent(F.col("gross_yield_proxy"))
    )
    return {
        "sale": sale.orderBy("month", "city"),
        "rent": rent.orderBy("month", "city"),
        "yield": proxy.orderBy("month", "city"),
        "sale_latest": latest_change(sale, "median_ppm2"),
        "rent_latest": latest_change(rent, "median_ppm2"),
        "yield_latest": latest_change(proxy, "gross_yield_pct"),
    }
