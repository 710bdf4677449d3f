"""Numbers behind the distribution charts: KPIs, histograms, boxes and the fitted line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingmart.functions.bins import natural_order
from listingmart.functions.labels import label_for_value
from listingmart.operators.filters import Bounds, clip_value, column_values, number_column
from listingmart.operators.joins import join_groups
from listingmart.operators.quantiles import (
    histogram_quantiles,
    quantiles,
    quantiles_of,
    value_histogram,
)

MEDIAN = {"median": 0.5}
QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}
WHISKER = 1.5


def listing_kpis(df: DataFrame) -> DataFrame:
    """One row: number of listings, median price per m², median price, mean area."""
    columns = ("price_per_m2", "price", "area_m2")
    found = quantiles(df, {c: c for c in columns}, MEDIAN)

    def of(column: str, statistic: str, name: str) -> Column:
        return F.expr(f"max(if(metric = '{column}', {statistic}, NULL)) AS {name}")

    return found.agg(
        F.expr("coalesce(max(n_rows), 0) AS n_listings"),
        of("price_per_m2", "median", "median_price_per_m2"),
        of("price", "median", "median_price"),
        of("area_m2", "mean", "avg_area_m2"),
    )


def histogram(
    df: DataFrame, column: str, *, bounds: Bounds | None = None, clip: bool = True, bins: int = 30
) -> DataFrame:
    """Counts in equal-width bins between the smallest and the largest (clipped) value."""
    values = column_values(df, column, bounds=bounds, clip=clip)
    span = values.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi"))).scalar()
    lo, hi = span["lo"], span["hi"]
    width = (hi - lo) / F.lit(float(bins))
    place = F.floor(F.try_divide(F.col("value") - lo, width)).cast("int")
    number = F.least(F.lit(bins - 1), F.coalesce(place, F.lit(0)))
    counted = values.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "bin",
        (lo + F.col("bin") * width).alias("bin_lo"),
        (lo + (F.col("bin") + 1) * width).alias("bin_hi"),
        "n",
    ).orderBy("bin")


def clipped_median(
    df: DataFrame, column: str, *, bounds: Bounds | None = None, clip: bool = True
) -> DataFrame:
    """One row: count and median of the (clipped) column."""
    values = column_values(df, column, bounds=bounds, clip=clip)
    return quantiles_of(values, "value", MEDIAN).select("n", "median")


REACH = f"(p75 - p25) * {WHISKER}D"
LOW_FENCE, HIGH_FENCE = f"p25 - {REACH}", f"p75 + {REACH}"


def _boxes(hist: DataFrame, keys: Sequence[str], max_groups: int | None, min_n: int) -> DataFrame:
    """Five-number summary, whiskers and outlier count per group of a value histogram."""
    stats = histogram_quantiles(hist, QUARTILES, keys, max_groups=max_groups)
    kept = ("n", "mean", "min", "p25", "median", "p75", "max")
    joined = join_groups(
        hist.withColumnRenamed("n", "copies"),
        stats.filter(f"n >= {min_n}").select(*keys, *kept),
        keys,
        "v",
        small_rows=max_groups,
    )
    within = f"v >= {LOW_FENCE} AND v <= {HIGH_FENCE}"
    return joined.groupBy(*keys).agg(
        *(F.expr(f"max({c}) AS {c}") for c in kept),
        F.expr(f"min(if({within}, v, NULL)) AS whisker_low"),
        F.expr(f"max(if({within}, v, NULL)) AS whisker_high"),
        F.expr(f"sum(if({within}, 0, copies)) AS n_outliers"),
    )


def box(
    df: DataFrame, column: str, *, bounds: Bounds | None = None, clip: bool = True
) -> DataFrame:
    """One row of box statistics of a (clipped) column."""
    values = column_values(df, column, bounds=bounds, clip=clip)
    hist = value_histogram(values, {column: "value"})
    return _boxes(hist, ["metric"], 1, 0).withColumnRenamed("metric", "column")


def box_outliers(
    df: DataFrame, column: str, *, bounds: Bounds | None = None, clip: bool = True
) -> DataFrame:
    """The values beyond the whiskers, one row per value."""
    values = column_values(df, column, bounds=bounds, clip=clip)
    fences = quantiles_of(values, "value", QUARTILES).selectExpr(
        f"struct({LOW_FENCE} AS low, {HIGH_FENCE} AS high)"
    )
    limits = fences.scalar()
    return values.filter((F.col("value") < limits["low"]) | (F.col("value") > limits["high"]))


def box_by_category(
    df: DataFrame,
    y: str,
    category: str,
    *,
    bounds: Bounds | None = None,
    clip: bool = True,
    min_n: int = 50,
    sort_by: str = "median",
    order: Sequence[str] | None = None,
    max_groups: int | None = None,
    require_groups: bool = False,
) -> DataFrame:
    """Box statistics of ``y`` per category that has at least ``min_n`` values, with the category's
    label, in chart order: the natural order of bins, or ascending median or count. An explicit
    ``order`` names the categories to show, whatever their size. ``require_groups`` runs the query
    and raises when no category is large enough."""
    if sort_by not in ("median", "count"):
        raise ValueError("sort_by must be 'median' or 'count'")
    natural = natural_order(category)
    if max_groups is None and natural is not None:
        max_groups = len(natural)
    limits = bounds.get(y) if clip and bounds else None
    rows = df.select(F.col(category), number_column(df, y).alias("value")).dropna()
    hist = value_histogram(rows, {y: clip_value(F.col("value"), limits)}, [category]).drop("metric")
    boxes = _boxes(hist, [category], max_groups, min_n if order is None else 0).withColumn(
        "label", label_for_value(category, F.col(category))
    )
    if require_groups and boxes.filter(F.col("n") >= min_n).isEmpty():
        raise ValueError(f"No categories meet min_n={min_n} for '{category}'.")
    if order is not None:
        boxes = boxes.filter(F.col(category).isin(list(order)))
    explicit = order if order is not None else natural
    if explicit is not None:
        place = F.array_position(F.array(*(F.lit(o) for o in explicit)), F.col(category))
        return boxes.orderBy(place, category)
    return boxes.orderBy("median" if sort_by == "median" else "n", category)


def scatter_points(
    df: DataFrame, x: str, y: str, *, bounds: Bounds | None = None, clip: bool = True
) -> DataFrame:
    """``x, y`` pairs without nulls, both axes clipped."""
    limits = bounds if clip and bounds else {}
    return (
        df.select(number_column(df, x).alias("x"), number_column(df, y).alias("y"))
        .dropna()
        .select(
            clip_value(F.col("x"), limits.get(x)).alias("x"),
            clip_value(F.col("y"), limits.get(y)).alias("y"),
        )
    )


def ols_trendline(
    df: DataFrame, x: str, y: str, *, bounds: Bounds | None = None, clip: bool = True
) -> DataFrame:
    """One row: least-squares line through the points of the scatter chart."""
    return scatter_points(df, x, y, bounds=bounds, clip=clip).agg(
        F.regr_count("y", "x").alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"),
    )


def value_counts(df: DataFrame, column: str, *, top: int | None = None) -> DataFrame:
    """How often each value occurs: all values in value order, or the ``top`` most frequent."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if top is None:
        return counts.orderBy(column)
    return counts.filter(F.col(column).isNotNull()).orderBy(F.desc("n"), column).limit(top)


def load_profile(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """One row per market with its month range and row count, and the expected columns it lacks."""
    missing = sorted(set(expected) - set(df.columns))
    return (
        df.groupBy("market")
        .agg(
            F.min("month").alias("min_month"),
            F.max("month").alias("max_month"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        .withColumn("missing_columns", F.lit(",".join(missing)))
        .orderBy("market")
    )


def quality_check(df: DataFrame) -> DataFrame:
    """Rows, non-positive prices and areas and unknown prices per m², by market."""
    return (
        df.groupBy("market")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("price") <= 0).alias("bad_price"),
            F.count_if(F.col("area_m2") <= 0).alias("bad_area"),
            F.count_if(F.col("price_per_m2").isNull()).alias("null_ppm2"),
        )
        .orderBy("market")
    )


def newest(df: DataFrame, columns: Sequence[str], n: int = 10) -> DataFrame:
    """The newest ``n`` listings."""
    return df.orderBy(F.desc("month"), "listing_id").select(*columns).limit(n)


def preview(df: DataFrame, n: int = 200) -> DataFrame:
    """The first ``n`` rows, newest first."""
    return df.orderBy(F.desc("month"), "listing_id").limit(n)
