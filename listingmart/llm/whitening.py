"""Whitening of embeddings by shifted CholeskyQR.

The rows, in whole numbers x and centred on the exact mean, are a tall matrix Y that is never gathered. A pass over the rows
adds up the Gram matrix of Q = Y R^-1, where R is the product of the triangular factors found so far and each factor is
applied by a triangular solve; the Cholesky factor of that Gram matrix is the next one. The first Gram matrix has the
squared condition of Y, so a small multiple of the identity is added to it before it is factored, and again later wherever
a matrix is not positive definite (columns that depend on each other). Two or three passes make Q orthonormal to double
precision; then Y = Q R, and the singular values and right vectors of the small R are those of Y: the whitening components.

Gram matrices are summed in Spark, a row per entry; only dimension^2 numbers and the sums reach the driver, whatever the
number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingmart.llm.common import need
from listingmart.llm.vectors import finite

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
# Rows that a task holds in double precision at a time.
ROWS = 4096
# Orthonormal to so much; no more passes than MOST_PASSES, of which full rank needs three.
ORTHONORMAL = 1e-13
MOST_PASSES = 8
# Eigenvalues below this share of the largest count as zero: their components cannot be scaled to variance one.
NO_VARIANCE = 1e-20

UNIT = np.finfo(np.float64).eps / 2
INT64 = 2**63 - 1
# Largest whole number that n * x may reach in plain 64-bit arithmetic.
PLAIN = 2**62


@dataclass(frozen=True)
class Centre:
    """Number of rows and the exact sums of their x, by dimension."""

    n: int
    sums: tuple[int, ...]


@dataclass(frozen=True)
class Whitening:
    """Centre, unit components (rows, by falling eigenvalue), their eigenvalues, and the trace of the covariance."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int


def whole(component: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * c) + shift as a long; beyond 64 bits the bound."""
    x = F.floor(component.cast("double") * scale)
    return F.when(x > INT64 - shift, F.lit(INT64)).otherwise(x + F.lit(shift).cast("bigint"))


def rows(data: DataFrame, vec_id: str, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x) of the rows that take part: finite vectors of the most frequent length, the larger of two as frequent."""
    need(data, vec_id, vector)
    kept = data.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")).filter(finite(F.col("vector")) & (F.size("vector") > 0))
    length = kept.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = length[0].d if length else 0
    return kept.filter(F.size("vector") == d).select("vec_id", F.transform("vector", lambda c: whole(c, scale, shift)).alias("x"))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches with their x as a matrix of whole numbers."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            values = part.column(column).flatten().to_numpy(zero_copy_only=False)
            yield part, values.reshape(part.num_rows, -1)


def centre(table: DataFrame) -> Centre:
    """Sums per dimension: partial ones in each task, whole numbers of any size, added up by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for _, x in blocks(batches):
            n += len(x)
            high = high + (x >> 32).sum(0)
            low = low + (x & 0xFFFFFFFF).sum(0)
        if n:
            d = len(high)
            columns = [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "n", "high", "low"])

    parts = table.select("x").mapInArrow(run, "dim int, n bigint, high bigint, low bigint")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), wide("high"), wide("low")).orderBy("dim").collect()
    return Centre(found[0].n if found else 0, tuple(int(r.high) * 2**32 + int(r.low) for r in found))


def deviations(x: np.ndarray, middle: Centre) -> np.ndarray:
    """n * x - S, exact: 64-bit numbers, or Python's where these would not do."""
    bound = max(int(x.max()), -int(x.min()), 1) if len(x) else 1
    if bound * middle.n < PLAIN and max(map(abs, middle.sums), default=0) < PLAIN:
        return middle.n * x - np.array(middle.sums, np.int64)
    return middle.n * x.astype(object) - np.array(middle.sums, object)


def squared(away: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None beyond 64 bits."""
    if away.dtype != object:
        high = float(np.abs(away).max(initial=0))
        if high * high * away.shape[1] < PLAIN:
            return (away * away).sum(1).tolist()
        away = away.astype(object)
    return [s if s <= INT64 else None for s in (away * away).sum(1).tolist()]


def centred(x: np.ndarray, middle: Centre) -> np.ndarray:
    """x - S/n, each rounded once. The exact difference is formed before the division."""
    away = deviations(x, middle)
    if away.dtype == object:
        return np.array([[a / middle.n for a in row] for row in away.tolist()], np.float64).reshape(x.shape)
    whole_part = away // middle.n
    return whole_part + (away - whole_part * middle.n) / middle.n


def solve(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with Q r = y for an upper triangular r, column by column."""
    q = np.empty((y.shape[1], len(y)))
    for j in range(y.shape[1]):
        q[j] = (y[:, j] - r[:j, j] @ q[:j]) / r[j, j]
    return q.T


def gram(table: DataFrame, d: int, each: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of q q^T, where ``each`` gives the rows q of a block of x. One row per entry and task is shuffled."""
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((d, d)), 0
        for _, x in blocks(batches):
            q = each(x)
            total += q.T @ q
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0] * d + upper[1], pa.int32()), pa.array(total[upper])], ["at", "value"])

    found = table.select("x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(d * d)
    out[found.column("at").to_numpy()] = found.column("value").to_numpy()
    out = out.reshape(d, d)
    return out + np.triu(out, 1).T


def factor(g: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Upper triangular Cholesky factor of g; shifted in the first pass and wherever g is not positive definite."""
    d = len(g)
    size = max(float(np.linalg.norm(g, 2)), np.finfo(np.float64).tiny)
    shift = 11 * (n * d + d * (d + 1)) * UNIT * size
    if first:
        # The published shift grows with the number of rows; beyond a thousandth it would only cost passes.
        g = g + min(shift, 1e-3 * size) * np.eye(d)
    extra = 0.0
    while True:
        try:
            return np.linalg.cholesky(g + extra * np.eye(d)).T
        except np.linalg.LinAlgError:
            extra = max(4 * extra, d * d * UNIT * size)


def fit(table: DataFrame, most: int = COMPONENTS) -> Whitening:
    """Components of the table's x. No rows, or rows that are all alike, have none."""
    middle = centre(table)
    n, d = middle.n, len(middle.sums)
    factors: list[np.ndarray] = []
    whole_r, g = np.eye(d), np.zeros((d, d))
    for _ in range(MOST_PASSES if n else 0):
        done = list(factors)

        def each(x: np.ndarray) -> np.ndarray:
            q = centred(x, middle)
            for r in done:
                q = solve(q, r)
            return q

        g = gram(table, d, each)
        if not g.any():
            break
        values = np.linalg.eigvalsh(g)
        # Directions without variance stay at zero, all others have come to one.
        if factors and np.all((np.abs(values - 1) < ORTHONORMAL * d) | (np.abs(values) < ORTHONORMAL * d)):
            break
        factors.append(factor(g, n, not factors))
        whole_r = factors[-1] @ whole_r
    if not n or not g.any():
        return Whitening(middle, np.zeros((0, d)), np.zeros(0), 0.0, len(factors))
    # The last Gram matrix is the identity up to rounding, or a projection where columns depend on each other.
    values, sides = np.linalg.eigh(g)
    root = (sides * np.sqrt(np.maximum(values, 0))) @ sides.T
    _, s, v = np.linalg.svd(root @ whole_r)
    eigenvalues = s * s / n
    used = int(min(most, (eigenvalues > NO_VARIANCE * eigenvalues[0]).sum()))
    return Whitening(middle, v[:used], eigenvalues[:used], math.fsum(eigenvalues), len(factors))


def whiten(x: np.ndarray, fitted: Whitening) -> np.ndarray:
    return (centred(x, fitted.centre) @ fitted.components.T) / np.sqrt(fitted.eigenvalues)


def identity_error(table: DataFrame, fitted: Whitening) -> float | None:
    """Largest entry of |covariance of the whitened rows - identity|, by a pass over the rows. None without components.

    The whitened rows are centred: they are projections of rows less their exact mean.
    """
    k = len(fitted.eigenvalues)
    if not k:
        return None
    covariance = gram(table, k, lambda x: whiten(x, fitted)) / fitted.centre.n
    return float(np.abs(covariance - np.eye(k)).max())


def transformed(table: DataFrame, fitted: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened array) of every row; ``deviation`` is the sum of (n * x - S)^2, null beyond 64 bits."""
    ids = table.select("vec_id").schema.simpleString()[7:-1]
    k = len(fitted.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches):
            w = whiten(x, fitted)
            lists = pa.ListArray.from_arrays(np.arange(0, len(w) * k + 1, max(k, 1), dtype=np.int32) if k else np.zeros(len(w) + 1, np.int32), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(squared(deviations(x, fitted.centre)), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    return table.mapInArrow(run, f"{ids}, deviation bigint, whitened array<double>")


def whitened(data: DataFrame, vec_id: str, vector: str, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per row of ``data`` and component.

    Rows whose vector is null, empty, or holds a null or non-finite entry take no part; nor do vectors of a rarer length.
    Null ids and repeated rows stay. Components without variance are left out, so rows that are all alike, and an empty
    table, give no row. Components of equal eigenvalues are any orthonormal basis of their space.
    """
    table = rows(data, vec_id, vector)
    fitted = fit(table, most)
    error = identity_error(table, fitted)
    shares: Sequence[float] = (fitted.eigenvalues / fitted.trace).tolist() if len(fitted.eigenvalues) else []
    explained = F.array(*map(F.lit, shares)).cast("array<double>")
    wide = transformed(table, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return wide.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.centre.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
