"""Month-over-month changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingmart.operators.quantiles import quantiles


@dataclass(frozen=True)
class Metric:
    """A number per month: ``count`` of rows, or ``mean`` or ``median`` of a column."""

    kind: str
    column: str = "price"

    def __post_init__(self) -> None:
        if self.kind not in ("count", "mean", "median"):
            raise ValueError(f"Unknown metric kind: {self.kind}")


# The four headline numbers of a market.
HEADLINE: dict[str, Metric] = {
    "listings": Metric("count"),
    "median_price_per_m2": Metric("median", "price_per_m2"),
    "median_price": Metric("median", "price"),
    "avg_area_m2": Metric("mean", "area_m2"),
}


def percent_change(now: Column, before: Column) -> Column:
    """Change in percent; null when a side is null or the earlier one is 0."""
    return F.try_divide(now - before, F.nullif(before, F.lit(0.0))) * 100


def direction(change: Column) -> Column:
    return F.when(change > 0, "up").when(change < 0, "down").when(change == 0, "flat")


def two_latest_months(df: DataFrame, month_col: str = "month") -> tuple[Column, Column]:
    """The latest month and the month present before it (null when there is none), as fields of one
    scalar subquery. The distinct months are few; the filter built on them prunes a table that is
    partitioned by month."""
    months = df.select(F.col(month_col).alias("m")).distinct().orderBy(F.desc("m")).limit(2)
    two = months.agg(F.expr("struct(max(m) AS latest, nullif(min(m), max(m)) AS previous)")).scalar()
    return two["latest"], two["previous"]


def month_trends(
    df: DataFrame, metrics: Mapping[str, Metric] = HEADLINE, *, month_col: str = "month"
) -> DataFrame:
    """One row per metric: its value in the two latest months present, the change in percent and its
    direction. With fewer than two months the change is null."""
    latest, previous = two_latest_months(df, month_col)
    two = df.filter(F.col(month_col) >= F.coalesce(previous, latest))
    columns = sorted({m.column for m in metrics.values()})
    found = quantiles(
        two, {c: c for c in columns}, {"median": 0.5}, [month_col], max_groups=2
    )
    statistic = {"count": "n_rows", "mean": "mean", "median": "median"}
    wanted = ", ".join(
        f"struct('{name}' AS name, '{m.column}' AS source, cast({statistic[m.kind]} AS double) AS value)"
        for name, m in metrics.items()
    )
    values = (
        found.selectExpr(f"`{month_col}`", "metric AS source", f"inline(array({wanted})) AS (metric, wants, value)")
        .filter("source = wants")
        .select(month_col, "metric", "value")
    )
    is_latest = F.col(month_col) == latest
    paired = values.groupBy("metric").agg(
        F.max(F.when(is_latest, F.col("value"))).alias("latest"),
        F.max(F.when(~is_latest, F.col("value"))).alias("previous"),
    )
    change = percent_change(F.col("latest"), F.col("previous"))
    return paired.select("metric", "latest", "previous", change.alias("change_pct")).withColumn(
        "direction", direction(F.col("change_pct"))
    )


def calculate_trend(
    df: DataFrame, metric: Metric | Column, *, month_col: str = "month"
) -> float | None:
    """Change of one metric as a number. Any aggregate Column may serve as the metric."""
    if month_col not in df.columns:
        return None
    if isinstance(metric, Metric):
        row = month_trends(df, {"value": metric}, month_col=month_col).first()
        return row["change_pct"] if row else None
    latest, previous = two_latest_months(df, month_col)
    months = df.filter(F.col(month_col) >= previous).groupBy(month_col).agg(metric.alias("value"))
    is_latest = F.col(month_col) == latest
    row = months.agg(
        percent_change(
            F.max(F.when(is_latest, F.col("value"))), F.max(F.when(~is_latest, F.col("value")))
        ).alias("change_pct")
    ).first()
    return row["change_pct"]


def pct_change(
    mart: DataFrame,
    column: str,
    *,
    out_col: str | None = None,
    keys: Sequence[str] = ("city",),
    month_col: str = "month",
) -> DataFrame:
    """Append the change in percent against the previous row of the same series. Gaps are filled with
    the last known value before comparing. A series has one row per month."""
    series = Window.partitionBy(*keys).orderBy(month_col)
    known = F.last(F.col(column), ignorenulls=True).over(
        series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = F.lag("_known").over(series)
    return (
        mart.withColumn("_known", known)
        .withColumn("_before", before)
        .withColumn(out_col or f"{column}_mom", (F.try_divide("_known", "_before") - 1) * 100)
        .drop("_known", "_before")
    )


def latest_change(
    mart: DataFrame, column: str, *, keys: Sequence[str] = ("city",), month_col: str = "month"
) -> DataFrame:
    """One row per series: number of months, last value, the one before, the change and its
    direction. A series has one row per month."""
    newest_first = Window.partitionBy(*keys).orderBy(F.desc(month_col))
    rows = mart.select(
        *keys,
        month_col,
        F.col(column).cast("double").alias("value"),
        F.row_number().over(newest_first).alias("_nth"),
    )
    last = rows.groupBy(*keys).agg(
        F.max(month_col).alias("latest_month"),
        F.countDistinct(month_col).alias("n_months"),
        F.max(F.when(F.col("_nth") == 1, F.col("value"))).alias("latest"),
        F.max(F.when(F.col("_nth") == 2, F.col("value"))).alias("previous"),
    )
    change = percent_change(F.col("latest"), F.col("previous"))
    return last.withColumn("change_pct", change).withColumn("direction", direction(F.col("change_pct")))


def as_percent(c: Column) -> Column:
    return c * 100
