"""Derived tables after months arrive, change or are withdrawn, against a full rebuild."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from listingmart.operators.dedup import one_row_per_property
from listingmart.plans import dataset, incremental
from listingmart.plans.marts import MART_COLUMNS, mart_city_month
from listingmart.sources.tables import replace_months, save_processed
from listingmart.streaming.refresh import refresh_long_table
from tests.test_jobs import HEADER, JANUARY, raw, write  # noqa: F401

COLUMNS = "listing_id string, property_fingerprint string, city string, price double, area_m2 double, price_per_m2 double, month date"
MONTHS = [dt.date(2024, m, 1) for m in range(1, 6)]


def listings(spark, rows):
    return spark.createDataFrame([(i, k, "x", float(p), 10.0, p / 10.0, MONTHS[m]) for i, k, p, m in rows], COLUMNS)


FIRST = [("a1", "a", 100, 0), ("a2", "a", 90, 1), ("b1", "b", 50, 1), ("c1", "c", 70, 0), ("d1", "d", 10, 2), ("e1", "e", 5, 0), ("e2", "e", 6, 1)]


@pytest.mark.parametrize(
    "changes",
    [
        {3: [("a3", "a", 80, 3), ("f1", "f", 1, 3)]},  # a new last month
        {1: []},  # withdrawn: earlier rows of a and e come back, b goes
        {1: [("a2", "a", 95, 1)]},  # delivered again
        {0: [("g1", "g", 1, 0)], 4: [("c5", "c", 1, 4)]},  # an old month again, and a new one
        {2: []},  # the only month of d
        {0: [("a1", "a", 100, 0), ("c1", "c", 70, 0), ("e1", "e", 5, 0)]},  # nothing new
        {0: [], 1: [], 2: []},
    ],
)
def test_refresh_equals_rebuild(spark, folder, changes):
    long_path = save_processed(listings(spark, FIRST), folder, "long", partition_by=("month",))
    static_path = save_processed(one_row_per_property(spark.read.parquet(long_path)), folder, "static", partition_by=("month",))
    incremental.refresh_mart(spark, long_path, f"{folder}/state", f"{folder}/mart", MONTHS)
    months = [MONTHS[m] for m in changes]
    new = [r for rows in changes.values() for r in rows]
    replace_months(listings(spark, new), long_path, months)
    now = [r for r in FIRST if r[3] not in changes] + new
    wanted_long = listings(spark, now)
    assert sorted(map(str, spark.read.schema(wanted_long.schema).parquet(long_path).collect())) == sorted(map(str, wanted_long.collect()))

    if now:
        written = incremental.refresh_static(spark, long_path, static_path, months)
        found = spark.read.schema(wanted_long.schema).parquet(static_path)
        assert sorted(found.collect()) == sorted(one_row_per_property(wanted_long).select(*found.columns).collect())
        if new == FIRST[:1] + FIRST[3:4] + FIRST[5:6]:
            assert not written
        incremental.refresh_mart(spark, long_path, f"{folder}/state", f"{folder}/mart", months)
        mart = spark.read.schema(incremental.MART_SCHEMA).parquet(f"{folder}/mart")
        assert sorted(mart.select(*MART_COLUMNS).collect()) == sorted(mart_city_month(wanted_long).collect())


def test_refresh_reads_touched_months_only(spark, folder):
    path = save_processed(incremental.state_of(listings(spark, FIRST)), folder, "state", partition_by=("month",))
    plan = incremental.mart_of_state(spark.read.parquet(path).filter(F.col("month").isin(MONTHS[1:2])))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(month" in text or "PartitionFilters: [isnotnull(month" in text


def test_spans_of_months(spark):
    state = incremental.state_of(listings(spark, FIRST))
    found = incremental.quantiles_of_state(state, {"median": 0.5}, months=MONTHS[:2]).filter("metric = 'price'").first()
    assert (found.n, found.median) == (6, 60.0)
    both = incremental.quantiles_of_state(state, {"median": 0.5}, ["city"]).filter("metric = 'price'").first()
    assert (both.city, both.n, both.median) == ("x", 7, 50.0)


def test_stream_renews_what_was_derived(spark, raw):  # noqa: F811
    out = f"{raw}/out"
    dataset.build_dataset(spark, raw, out)
    dataset.build_database(spark, out)
    write(f"{raw}/sale", "more_2024_03.csv", f"{HEADER}\n{JANUARY}n9,Warszawa,tenement,50,900000,52.2,21.0,2,yes\n")
    refresh_long_table(spark, f"{raw}/sale", "sale", f"{out}/sale_long.parquet", f"{raw}/checkpoint", derived=out).awaitTermination(240)

    def tables():
        names = ("listings_sale_static", "mart_city_month_sale", "mart_state_sale")
        return [sorted(str(sorted(r.asDict().items())) for r in spark.read.parquet(f"{out}/{n}.parquet").collect()) for n in names]

    after = tables()
    assert any("2024, 3, 1" in r for r in after[0]) and any("2024, 3, 1" in r for r in after[1])
    dataset.build_database(spark, out)
    assert tables() == after
