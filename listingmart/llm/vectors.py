"""Rows of vectors that take part in a search, and the merge of partial rankings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def finite(vector: Column) -> Column:
    """True unless the vector is null or has a null or non-finite component."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & ok


def taking_part(df: DataFrame, vec_id: str, vector: str, *, zero: bool) -> DataFrame:
    """(vec_id, vector, dim) of the rows with an id and a finite vector; ``zero``: also vectors of length 0."""
    kept = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector")).filter(F.col("vec_id").isNotNull() & finite(F.col("vector")))
    if not zero:
        kept = kept.filter(F.exists("vector", lambda x: x != 0))
    return kept.withColumn("dim", F.size("vector"))


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    """Rows of a vector column in double precision."""
    if not len(column) or not dim:
        return np.zeros((len(column), dim))
    return np.stack(column.to_list()).astype(np.float64)


def best(found: DataFrame, k: int, *, largest: bool) -> DataFrame:
    """The k best rows (query_id, vec_id, score) of each query, ranked from 1, ties to the smaller vec_id."""
    order = [F.col("score").desc() if largest else F.col("score").asc(), F.col("vec_id").asc()]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def result_schema(score: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", score)])
