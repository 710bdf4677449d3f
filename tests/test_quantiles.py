"""Distributed quantiles against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from listingmart.operators.quantiles import coarse_bucket, quantiles, quantiles_of

PROBS = {"p01": 0.01, "p25": 0.25, "median": 0.5, "p75": 0.75, "p99": 0.99}


def check(rows, expected_by_key):
    assert {r["k"] for r in rows} == set(expected_by_key)
    for r in rows:
        values = [v for v in expected_by_key[r["k"]] if v is not None]
        assert r["n_rows"] == len(expected_by_key[r["k"]])
        assert r["n"] == len(values)
        if not values:
            assert all(r[c] is None for c in ("mean", "min", "max", *PROBS))
            continue
        assert r["min"] == min(values) and r["max"] == max(values)
        assert r["mean"] == pytest.approx(np.mean(values), rel=1e-9, abs=1e-9)
        for name, p in PROBS.items():
            assert r[name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12), name


@pytest.mark.parametrize("max_groups", [None, 6])
def test_groups_match_brute_force(spark, max_groups):
    rng = random.Random(5)
    data = {
        "hot": [rng.choice([0.0, 1.5, -2.25, 1e-300, -1e300, 7e7]) for _ in range(3000)],
        "wide": [rng.uniform(-1e6, 1e6) for _ in range(500)],
        "close": [16000 + rng.randrange(5) * 1e-9 for _ in range(200)],
        "one": [4.0],
        "gaps": [None, 3.0, None, 5.0, 4.0],
        "empty": [None, None],
    }
    rows = [(k, v) for k, values in data.items() for v in values]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    check(quantiles_of(df, "v", PROBS, ["k"], max_groups=max_groups).collect(), data)


def test_null_group_drops_out_and_keys_may_be_several(spark):
    df = spark.createDataFrame(
        [("a", 1, 1.0), ("a", 1, 3.0), ("a", 2, 9.0), (None, 1, 5.0)], "k string, m int, v double"
    )
    rows = quantiles_of(df, "v", {"median": 0.5}, ["k", "m"]).collect()
    assert {(r["k"], r["m"], r["median"]) for r in rows} == {("a", 1, 2.0), ("a", 2, 9.0)}


def test_several_columns_in_one_pass(spark):
    df = spark.range(101).select(F.col("id").alias("a"), (-F.col("id") / 2).alias("b"))
    rows = {r["metric"]: r for r in quantiles(df, {"a": "a", "b": F.col("b")}, {"q": 0.1}).collect()}
    assert rows["a"]["q"] == 10.0 and rows["b"]["q"] == -45.0


def test_empty_input_gives_no_group(spark):
    assert quantiles_of(spark.range(0), "id", {"median": 0.5}).collect() == []


def test_infinite_values(spark):
    df = spark.createDataFrame([(math.inf,), (1.0,), (2.0,), (-math.inf,)], "v double")
    row = quantiles_of(df, "v", {"q": 1 / 3, "hi": 1.0}).first()
    assert row["q"] == 1.0 and row["hi"] == math.inf


def test_bucket_is_monotone(spark):
    rng = random.Random(1)
    values = [s * 10 ** rng.uniform(-300, 300) for s in (1, -1) for _ in range(500)] + [0.0, -0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").selectExpr("v", f"{coarse_bucket('v')} AS b")
    buckets = [r["b"] for r in sorted(df.collect(), key=lambda r: r["v"])]
    assert buckets == sorted(buckets)


def test_hot_value_is_folded_before_the_shuffle(spark):
    plan = quantiles_of(spark.range(1000), "id", {"median": 0.5})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in text and "CartesianProduct" not in text and "NestedLoop" not in text
    plan.collect()
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()


def test_null_keys_are_a_group_of_the_mart(spark):
    from listingmart.plans.marts import mart_city_month

    rows = [("a", 1.0), ("a", 3.0), (None, 5.0)]
    listings = spark.createDataFrame(rows, "city string, price_per_m2 double").selectExpr("DATE'2024-01-01' AS month", "*")
    found = {r["city"]: (r["n_listings"], r["median_ppm2"]) for r in mart_city_month(listings).collect()}
    assert found == {"a": (2, 2.0), None: (1, 5.0)}


@pytest.mark.parametrize("max_groups", [None, 3])
def test_values_in_a_narrow_band_do_not_meet_in_one_task(spark, folder, max_groups):
    # A million distinct values within 0.2 %, and as many doubles that follow each other.
    n = 1_000_000
    band = spark.range(n).selectExpr("'band' AS k", f"1000D + id * (2D / {n}) AS v")
    next_to = spark.range(n // 4).selectExpr("'next' AS k", "1D + id * 2.220446049250313e-16D AS v")
    far = spark.createDataFrame([("odd", float("inf")), ("odd", float("-inf")), ("odd", 5e-324), ("odd", 1e-323)], "k string, v double")
    df = band.unionByName(next_to).unionByName(far)
    found = quantiles_of(df, "v", PROBS, ["k"], max_groups=max_groups)
    rows = {r["k"]: r for r in found.collect()}
    for k, values in (("band", 1000 + np.arange(n) * (2 / n)), ("next", 1 + np.arange(n // 4) * 2.0**-52)):
        for name, p in PROBS.items():
            # The statistic interpolates between two neighbours; both are exact.
            low, high = (values[int(f((len(values) - 1) * p))] for f in (math.floor, math.ceil))
            assert low <= rows[k][name] <= high, (k, name)
        assert rows[k]["n"] == len(values)
    assert rows["odd"]["median"] == pytest.approx(7.5e-324, abs=5e-324) and rows["odd"]["max"] == math.inf


def test_no_window_over_more_than_the_cuts(spark):
    from listingmart.operators import quantiles as core

    df = spark.range(200_000).selectExpr("1000D + id * 1e-6D AS v")
    widest = []
    frame = type(df)
    plain = frame.selectExpr

    def watched(self, *expr):
        if any("PARTITION BY cell, lo" in e for e in expr):
            widest.append(self.groupBy("cell", "lo").count().agg(F.max("count")).first()[0] or 0)
        return plain(self, *expr)

    frame.selectExpr = watched
    try:
        quantiles_of(df, "v", PROBS)
    finally:
        frame.selectExpr = plain
    assert len(widest) == core.LEVELS + 1 and max(widest) <= core.CUTS
