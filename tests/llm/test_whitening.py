"""Whitening against a plain eigendecomposition, in exact whole numbers where the result is one."""

from __future__ import annotations

import numpy as np
import pytest

from listingmart.llm import queries, whitening


def frame(spark, rows):
    return spark.createDataFrame([(i, None if r is None else [None if x is None else float(x) for x in r], 5) for i, r in enumerate(rows)], "vec_id bigint, v array<double>, n int")


def fitted(spark, rows):
    return whitening.fit(whitening.rows(frame(spark, rows), "vec_id", "v"))


def plain(rows):
    """Eigenvalues (falling) and eigenvectors (rows) of the covariance of floor(64 * c)."""
    x = np.floor(64 * np.asarray(rows, float))
    y = x - x.mean(0)
    values, sides = np.linalg.eigh(y.T @ y / len(y))
    return values[::-1], sides[:, ::-1].T


def test_query_equals_eigendecomposition(spark):
    sf = "/root/testdata/sf0.01"
    table = queries.table(spark, sf, "embeddings").toPandas()
    x = np.floor(64 * np.stack(table.embedding).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    y = (n * x - sums) / n
    values, sides = plain(np.stack(table.embedding))
    found = queries.op13_whitening(spark, sf).toPandas().sort_values(["vec_id", "component"])
    k = min(32, x.shape[1])
    assert len(found) == n * k and (found.n == n).all()
    order = np.argsort(table.vec_id.to_numpy())
    assert (found.deviation.to_numpy().reshape(n, k)[:, 0] == ((n * x - sums) ** 2).sum(1)[order]).all()
    got, wanted = found.whitened.to_numpy().reshape(n, k), (y @ sides[:k].T / np.sqrt(values[:k]))[order]
    assert np.allclose(got, wanted * np.sign((got * wanted).sum(0)), atol=1e-9)
    assert np.allclose(found.explained.to_numpy().reshape(n, k)[0], values[:k] / values.sum(), rtol=1e-10)
    error = np.abs(got.T @ got / n - np.eye(k)).max()
    assert found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-10 and error < 1e-10


@pytest.mark.parametrize("shape", ["dependent", "constant column", "scales", "fewer rows", "two rows"])
def test_badly_conditioned_rows(spark, shape):
    rng = np.random.default_rng(1)
    base = rng.integers(-500, 500, (60, 3)) / 64
    rows = {
        "dependent": base @ rng.integers(-3, 4, (3, 7)), "constant column": np.c_[base, np.ones(60)], "scales": base * [1e6, 1, 1 / 8],
        "fewer rows": rng.normal(size=(5, 9)), "two rows": base[:2],
    }[shape]
    got = fitted(spark, rows)
    values, sides = plain(rows)
    rank = len(got.eigenvalues)
    assert rank == np.linalg.matrix_rank(np.floor(64 * rows) - np.floor(64 * rows).mean(0)) and got.passes <= whitening.MOST_PASSES
    assert np.allclose(got.eigenvalues, values[:rank], rtol=1e-9) and np.allclose(np.abs((got.components * sides[:rank]).sum(1)), 1, atol=1e-8)
    assert whitening.identity_error(whitening.rows(frame(spark, rows), "vec_id", "v"), got) < 1e-8


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [None, [], [1, nan], [1, None], [inf, 2], [1, 2, 3], [1, 2], [3, -1], [3, -1], [0, 0], [-1, 5]]
    found = whitening.whitened(frame(spark, rows), "vec_id", "v").collect()
    assert sorted((r.vec_id, r.component) for r in found) == [(i, c) for i in (6, 7, 8, 9, 10) for c in (1, 2)] and {r.n for r in found} == {5}
    x = 64 * np.array([[1, 2], [3, -1], [3, -1], [0, 0], [-1, 5]]) + 1_000_000
    away = ((5 * x - x.sum(0)) ** 2).sum(1).tolist()
    assert {r.vec_id: r.deviation for r in found} == dict(zip((6, 7, 8, 9, 10), away, strict=True))
    for none in ([], [None, []], [[1, 2], [1, 2]], [[1, 2]]):
        assert whitening.whitened(frame(spark, none), "vec_id", "v").count() == 0


def test_entries_beyond_plain_arithmetic(spark):
    found = whitening.whitened(frame(spark, [[1e300, 1], [-1e300, 2], [0, 0]]), "vec_id", "v").collect()
    assert {r.vec_id: r.deviation for r in found}[0] is None and all(np.isfinite(r.whitened) for r in found)
    rows = [[2.0**40, 0], [0, 1], [2.0**39, 3], [5, 5]]
    got = whitening.whitened(frame(spark, rows), "vec_id", "v").filter("component = 1").collect()
    x = [[int(64 * a) + 1_000_000 for a in r] for r in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    exact = [sum((4 * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    assert [r.deviation for r in sorted(got)] == [e if e < 2**63 else None for e in exact]
    big = np.array([[2**61, 3], [2**61 - 5, -2**61]], np.int64)
    middle = whitening.Centre(7, (3 * 2**62 + 1, -5))
    assert whitening.deviations(big, middle).tolist() == [[7 * int(a) - b for a, b in zip(r, middle.sums, strict=True)] for r in big]
