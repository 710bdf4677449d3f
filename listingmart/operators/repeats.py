"""How often the same property is listed again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listingmart.functions.fingerprint import FingerprintConfig, add_property_fingerprint
from listingmart.operators.dedup import FINGERPRINT
from listingmart.sources.tables import load_parquet_filtered


@dataclass(frozen=True)
class DuplicateStats:
    """Prevalence of repeated properties in a long table."""

    total_records: int
    total_fingerprints: int
    repeating_fingerprints: int
    repeating_records: int
    repeating_records_share: float
    multi_month_fingerprints: int
    multi_month_records: int
    multi_month_records_share: float


def repeat_groups(
    df: DataFrame, *, fingerprint_col: str = FINGERPRINT, month_col: str = "month"
) -> DataFrame:
    """Per property: records, distinct months, first and last month. Records are counted per month
    first, so a property with most of the rows is folded before it meets in one task."""
    missing = [c for c in (fingerprint_col, month_col) if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns for repeat stats: {missing}")
    months = (
        df.filter(F.col(fingerprint_col).isNotNull())
        .groupBy(fingerprint_col, month_col)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return months.groupBy(fingerprint_col).agg(
        F.sum("n").alias("n_records"),
        F.count(month_col).alias("n_months"),
        F.min(month_col).alias("min_month"),
        F.max(month_col).alias("max_month"),
    )


def repeat_stats(groups: DataFrame) -> DataFrame:
    """One row of prevalence numbers over the repeat groups."""

    def records(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n_records"))), F.lit(0))

    repeating, multi = F.col("n_records") > 1, F.col("n_months") > 1
    counts = groups.agg(
        F.coalesce(F.sum("n_records"), F.lit(0)).alias("total_records"),
        F.count(F.lit(1)).alias("total_fingerprints"),
        F.count_if(repeating).alias("repeating_fingerprints"),
        records(repeating).alias("repeating_records"),
        F.count_if(multi).alias("multi_month_fingerprints"),
        records(multi).alias("multi_month_records"),
    )

    def share(column: str) -> Column:
        return F.coalesce(F.try_divide(column, "total_records"), F.lit(0.0))

    return counts.withColumns(
        {
            "repeating_records_share": share("repeating_records"),
            "multi_month_records_share": share("multi_month_records"),
        }
    ).select(*DuplicateStats.__dataclass_fields__)


def top_repeats(groups: DataFrame, n: int = 20, *, fingerprint_col: str = FINGERPRINT) -> DataFrame:
    """The ``n`` properties seen in most months, then with most records."""
    return groups.orderBy(F.desc("n_months"), F.desc("n_records"), fingerprint_col).limit(n)


def compute_repeat_stats(
    df: DataFrame,
    *,
    fingerprint_col: str = FINGERPRINT,
    month_col: str = "month",
    top_n: int = 20,
) -> tuple[DuplicateStats, DataFrame]:
    """The prevalence numbers (one row) and the top repeating properties."""
    groups = repeat_groups(df, fingerprint_col=fingerprint_col, month_col=month_col)
    stats = DuplicateStats(**repeat_stats(groups).first().asDict())
    return stats, top_repeats(groups, top_n, fingerprint_col=fingerprint_col)


def run_repeat_prevalence(
    spark: SparkSession, path: str, cfg: FingerprintConfig | None = None, *, top_n: int = 20
) -> tuple[DuplicateStats, DataFrame]:
    """Repeat statistics of a stored dataset, keyed with the given configuration."""
    keyed = add_property_fingerprint(load_parquet_filtered(spark, path), cfg)
    return compute_repeat_stats(keyed, top_n=top_n)
