"""Right-closed bins of floors and build years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Inner edges and labels; a value equal to an edge belongs to the bin below it.
FLOOR_EDGES = (5, 10, 15, 20)
FLOOR_LABELS = ("0-5", "5-10", "10-15", "15-20", "20+")
YEAR_EDGES = (1900, 1950, 1980, 1990, 2000, 2010, 2020)
YEAR_LABELS = (
    "Before 1900", "1900-1950", "1950-1980", "1980-1990", "1990-2000", "2000-2010", "2010-2020", "2020+",
)

BINS: dict[str, tuple[Sequence[int], Sequence[str]]] = {
    "floor": (FLOOR_EDGES, FLOOR_LABELS),
    "floors_total": (FLOOR_EDGES, FLOOR_LABELS),
    "build_year": (YEAR_EDGES, YEAR_LABELS),
}


def bin_ordinal(column: str) -> Column:
    """Zero-based bin number of a binned column, null for null."""
    edges, _ = BINS[column]
    whens = " ".join(f"WHEN `{column}` <= {edge} THEN {i}" for i, edge in enumerate(edges))
    return F.expr(f"CASE {whens} WHEN `{column}` > {edges[-1]} THEN {len(edges)} END")


def bin_label(column: str) -> Column:
    edges, labels = BINS[column]
    whens = " ".join(f"WHEN `{column}` <= {edge} THEN '{label}'" for edge, label in zip(edges, labels))
    return F.expr(f"CASE {whens} WHEN `{column}` > {edges[-1]} THEN '{labels[-1]}' END")


def add_bin(df: DataFrame, column: str) -> DataFrame:
    """Append ``<column>_bin`` and its sort key ``<column>_bin_ord``; no-op without the column."""
    if column not in df.columns:
        return df
    return df.withColumns(
        {f"{column}_bin": bin_label(column), f"{column}_bin_ord": bin_ordinal(column)}
    )


def add_bins(df: DataFrame) -> DataFrame:
    """All bins of the columns that exist."""
    present = [c for c in BINS if c in df.columns]
    return df.withColumns(
        {f"{c}_bin": bin_label(c) for c in present} | {f"{c}_bin_ord": bin_ordinal(c) for c in present}
    )


def natural_order(category: str) -> Sequence[str] | None:
    """Labels of a binned column in bin order, None for other columns."""
    base = category.removesuffix("_bin")
    return BINS[base][1] if category.endswith("_bin") and base in BINS else None
