"""Display labels of raw values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingmart.schema import VALUE_LABELS


def label_for_value(column: str, raw: Column) -> Column:
    """Label of a raw value of ``column``; values without one are shown as they are. The dictionary
    is a literal of the plan, so the lookup needs no join."""
    text = raw.cast("string")
    labels = VALUE_LABELS.get(column)
    if not labels:
        return text
    table = F.create_map(*(F.lit(part) for pair in labels.items() for part in pair))
    return F.coalesce(F.try_element_at(table, text), text)


def with_label(df: DataFrame, column: str, out_col: str | None = None) -> DataFrame:
    return df.withColumn(out_col or f"{column}_label", label_for_value(column, F.col(column)))


def display_names(values: DataFrame) -> DataFrame:
    """``column, raw`` of distinct values -> the same with a ``display`` text unique per column.

    When two raw values share a label, the first in raw order keeps it and the others get the raw
    value in brackets behind it.
    """
    label = F.col("raw")
    for column in VALUE_LABELS:
        label = F.when(F.col("column") == column, label_for_value(column, F.col("raw"))).otherwise(label)
    same = Window.partitionBy("column", "label").orderBy("raw")
    return (
        values.withColumn("label", label)
        .withColumn("_nth", F.row_number().over(same))
        .withColumn(
            "display",
            F.when(F.col("_nth") == 1, F.col("label")).otherwise(
                F.concat("label", F.lit(" ["), "raw", F.lit("]"))
            ),
        )
        .drop("_nth", "label")
    )
