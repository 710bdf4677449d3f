"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are dealt by a hash of their id to blocks of bounded size, queries likewise, and every pair of a query block and
a vector block is one task's work. A block keeps, for each dimension, its vectors sorted by that component. A query
reads the lists from the end that its own component favours, all to the same depth, and scores the vectors it
meets there. No vector that it has not met can score more than the sum of the components at that depth times its own. It
stops when this bound is below the kth score (at equality an unmet vector might win the tie). The depth doubles, so reading and
scoring go in few steps of array work. Partial rankings are merged per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingmart.llm import vectors
from listingmart.llm.common import need

SCALE = 256
BLOCK, QUERIES = 8192, 2048
FIRST_DEPTH = 8
INT64 = 2**63 - 1


def quantized(column: pd.Series, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x), as doubles."""
    return np.floor(scale * vectors.matrix(column, dim))


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """A type in which the inner products are exact."""
    most = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def as_type(a: np.ndarray, kind: type) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) if kind is object else a.astype(kind)


def threshold(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the indices and scores of its k best rows of ``data`` but those with its own id."""
    kind = exact_type(queries, data)
    queries, data = as_type(queries, kind), as_type(data, kind)
    n, dim = data.shape
    down = np.argsort(data if kind is not object else data.astype(np.float64), axis=0, kind="stable")[::-1].astype(np.int32)
    lists = np.ascontiguousarray(np.stack((down, down[::-1])).transpose(0, 2, 1))  # by direction, dimension, depth
    values = np.stack((np.take_along_axis(data, down, 0), np.take_along_axis(data, down[::-1], 0)))
    found = []
    for q, me in zip(queries, own.tolist(), strict=True):
        used = np.flatnonzero(q)
        side = (q[used] < 0).astype(np.int64)
        seen = ids == me
        top, scores = np.zeros(0, np.int64), np.zeros(0, kind)
        depth, reach = 0, FIRST_DEPTH
        while depth < n:
            reach = min(reach, n)
            met = np.zeros(n, bool)
            if len(used):
                met[lists[side, used, depth:reach].ravel()] = True
            else:
                met[:] = True
                reach = n
            new = np.flatnonzero(met & ~seen)
            seen |= met
            if len(new):
                fresh = data[new] @ q
                if len(scores) == k:
                    better = fresh >= scores[-1]
                    new, fresh = new[better], fresh[better]
                top, scores = np.concatenate((top, new)), np.concatenate((scores, fresh))
                order = np.lexsort((ids[top], -scores))[:k]
                top, scores = top[order], scores[order]
            depth, reach = reach, 2 * reach
            if len(scores) == k and depth < n and values[side, depth - 1, used] @ q[used] < scores[-1]:
                break
        found.append((top, scores))
    return found


def search(data: DataFrame, vec_id: str, vector: str, is_query: Column, k: int, scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query with rows of ``data``.

    Components count as floor(scale * x). Rows with a null id, or a vector that is null or has a null or non-finite
    component, take no part. Only vectors of equal length are compared. Rows that repeat an id count once, and are no
    candidates of that id. Scores beyond 64 bits are given as the bound. With fewer candidates than k all are returned.
    """
    need(data, vec_id, vector)
    flagged = data.select(F.col(vec_id), F.col(vector), is_query.alias("asks"))
    rows = vectors.taking_part(flagged, vec_id, vector, zero=True)
    asks = vectors.taking_part(flagged.filter("asks"), vec_id, vector, zero=True)
    n_blocks = max(1, -(-rows.count() // BLOCK))
    n_groups = max(1, -(-asks.count() // QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("block", deal(n_blocks)).withColumn("part", each(n_groups))
    right = asks.withColumn("part", deal(n_groups)).withColumn("block", each(n_blocks))

    def tile(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found, wanted = (x.drop_duplicates("vec_id").sort_values("vec_id") for x in (found, wanted))
        if not len(found) or not len(wanted):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        dim = int(found["dim"].iloc[0])
        ids, own = found["vec_id"].to_numpy(), wanted["vec_id"].to_numpy()
        top = threshold(quantized(wanted["vector"], dim, scale), own, ids, quantized(found["vector"], dim, scale), k)
        scores = [max(-INT64, min(INT64, int(s))) for _, x in top for s in x]
        return pd.DataFrame({"query_id": np.repeat(own, [len(t) for t, _ in top]), "vec_id": ids[np.concatenate([t for t, _ in top]).astype(np.int64)], "score": np.array(scores, np.int64)})

    keys = ("dim", "block", "part")
    tiles = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(tile, vectors.result_schema(T.LongType()))
    return vectors.best(tiles, k, largest=True)
