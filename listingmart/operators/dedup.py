"""Keep-one-row operators: repeats inside a month and one row per property."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINGERPRINT = "property_fingerprint"
# A month's properties are spread over so many parts before they are stored.
PARTS = 16
# Rows that one task sorts, on average, where their number is known, and rows for each of a month's parts beyond the first `PARTS`.
TASK_ROWS, PART_ROWS = 100_000, 4_000_000


def keep_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], *, within: Sequence[str] = (), few_copies: bool = False
) -> DataFrame:
    """First row of every key group, inside groups of ``within``, by which the rows may be partitioned already.

    The rank-one filter is applied in every map task before the shuffle, so a group of copies sends
    at most one row per task however large it is. Sorting starts with a hash of the keys, which
    compares faster than long texts; the keys themselves decide between equal hashes. Rows that
    still tie are ordered by a hash of all their values, so that a re-run picks the same row.

    Where the caller knows that no key has more than a ``few_copies``, a filter in the map tasks would sort all rows to drop
    hardly any: the rows are shuffled first and sorted once.
    """
    rest = F.xxhash64(*df.columns)
    window = Window.partitionBy(*within, "_key_hash", *keys).orderBy(*order, rest)
    return (
        (df.repartition(*keys) if few_copies else df)
        .withColumn("_key_hash", F.xxhash64(*keys))
        .withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") == 1)
        .drop("_key_hash", "_rank")
    )


def deal_by_month(df: DataFrame, fingerprint: Column, *, month_col: str = "month", rows: int | None = None) -> DataFrame:
    """Rows shuffled by month and ``_part`` of their properties, whose key need not be among their columns.

    ``rows`` is about how many rows there are: with it the number of tasks follows the rows, so what a task sorts does not
    grow with them. Without it the session's number of shuffle partitions holds.
    """
    spread = max(PARTS, (rows or 0) // PART_ROWS)
    tasks = [] if rows is None else [max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))]
    return df.withColumn("_part", F.pmod(F.xxhash64(fingerprint), F.lit(spread)).cast("int")).repartition(*tasks, month_col, "_part")


def deduplicate_within_month(
    df: DataFrame,
    *,
    fingerprint_col: str = FINGERPRINT,
    month_col: str = "month",
    sort_cols: Sequence[str] = ("price",),
    by_month: bool = False,
    rows: int | None = None,
    dealt: bool = False,
) -> DataFrame:
    """One row per (property, month), the one with the highest sort values. Repeats of a property
    in other months stay.

    ``by_month`` is for whole rows that are stored by month next: they are shuffled once, by month and part of its
    properties, and sorted after that only. So a month's rows end in few tasks and need no second shuffle before the
    write, and no map task sorts what it reads. Copies of one property in one month then meet in one task, whose sort spills.
    ``rows`` as in `deal_by_month`, which ``dealt`` rows went through already.
    """
    missing = sorted({fingerprint_col, month_col} - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns for within-month deduplication: {missing}")
    order = [F.desc_nulls_last(c) for c in sort_cols]
    if "listing_id" in df.columns:
        order.append(F.asc("listing_id"))
    if not by_month:
        return keep_first(df, [fingerprint_col, month_col], order)
    parts = df if dealt else deal_by_month(df, F.col(fingerprint_col), month_col=month_col, rows=rows)
    return keep_first(parts, [fingerprint_col], order, within=(month_col, "_part")).drop("_part")


def within_month_removed(
    df: DataFrame, *, fingerprint_col: str = FINGERPRINT, month_col: str = "month"
) -> DataFrame:
    """One row: rows before and after within-month deduplication, and the difference."""
    return (
        df.groupBy(fingerprint_col, month_col)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
            F.count(F.lit(1)).alias("rows_after"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows_removed"),
        )
    )


def one_row_per_property(
    df: DataFrame, *, keys: Sequence[str] = (FINGERPRINT,), month_col: str = "month", by_month: bool = False
) -> DataFrame:
    """Static table: the latest month of every property, highest price first on ties. ``by_month`` tells that the listings
    are a long table, which has a property once in a month."""
    known = df.dropna(subset=list(keys))
    order = [F.desc_nulls_last(month_col), F.desc_nulls_last("price"), F.asc("listing_id")]
    return keep_first(known, keys, order, few_copies=by_month)
