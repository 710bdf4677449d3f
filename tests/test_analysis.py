"""Filters, statistics, trends, yields and repeats on small frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from listingmart.functions.bins import add_bins
from listingmart.operators import filters, joins, repeats, stats, trends, yields
from listingmart.plans import reports
from listingmart.schema import AMENITY_COLUMNS, VALUE_LABELS


@pytest.fixture(scope="module")
def listings(spark):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame(
        {
            "listing_id": [f"l{i:03d}" for i in range(n)],
            "city": "warszawa",
            "month": [f"2024-0{1 + i % 3}-01" for i in range(n)],
            "market": "sale",
            "district": rng.choice(["wola", "ursus", "ochota"], n, p=[0.8, 0.15, 0.05]),
            "price": np.round(rng.lognormal(13, 0.4, n), 2),
            "area_m2": np.round(rng.uniform(20, 120, n), 1),
            "floor": rng.integers(0, 25, n),
            "build_year": rng.integers(1890, 2024, n),
            "poi_count": rng.integers(0, 50, n).astype(float),
            "centre_distance": np.round(rng.uniform(0, 15, n), 2),
        }
    )
    pdf["price_per_m2"] = pdf["price"] / pdf["area_m2"]
    pdf["has_elevator"] = rng.choice([True, False], n)
    df = spark.createDataFrame(pdf).withColumn("month", F.to_date("month")).repartition(5).cache()
    return pdf, df


def test_registry_covers_every_filter():
    assert len(filters.FILTERS) == 26
    assert set(filters.FILTERS) >= set(VALUE_LABELS) | set(AMENITY_COLUMNS)


def test_filters(listings):
    pdf, df = listings
    spec = {
        "district": ["wola", "ursus"], "area_m2": (30, 90), "price": (None, 700000.0), "has_elevator": True,
        "nonsense": 3, "ownership": ["condominium"], "condition": None, "floor": (None, None),
    }
    expected = pdf[pdf.district.isin(["wola", "ursus"]) & pdf.area_m2.between(30, 90) & (pdf.price <= 700000) & pdf.has_elevator]
    assert filters.apply_filters(df, spec).count() == len(expected)
    assert filters.apply_filters(df, {"district": "ochota", "has_elevator": False}).count() == (pdf.district == "ochota").sum()
    assert filters.apply_filters(df, {"district": []}).count() == len(pdf)
    with pytest.raises(ValueError, match="Invalid value"):
        filters.apply_filters(df, {"district": ["nowhere"]})
    for wrong in ((1, 2, 3), 5):
        with pytest.raises(ValueError, match="expects"):
            filters.apply_filters(df, {"price": wrong})
    odd = {"price": filters.FilterSpec("price", "odd")}
    with pytest.raises(ValueError, match="Unknown filter kind"):
        filters.apply_filters(df, {"price": 1}, odd)


def test_flag_filter_reads_text_and_numbers(spark):
    df = spark.createDataFrame([("1", 1), ("0", 0), ("True", 1), (None, None)], "has_balcony string, has_security int")
    assert filters.apply_filters(df, {"has_balcony": True}).count() == 2
    assert filters.apply_filters(df, {"has_security": True}).count() == 2


def test_clipping(listings):
    pdf, df = listings
    bounds = filters.get_clip_bounds(df, ["price", "absent"], p_low=0.05, p_high=0.9)
    assert bounds == {"price": pytest.approx((pdf.price.quantile(0.05), pdf.price.quantile(0.9)))}
    assert filters.get_clip_bounds(df, ["price"], clip=False) == {} == filters.get_clip_bounds(df, [])
    values = filters.column_values(df, "price", bounds=bounds)
    assert sorted(r[0] for r in values.collect()) == pytest.approx(sorted(pdf.price.clip(*bounds["price"])))
    assert filters.column_values(df, "price", bounds=bounds, clip=False).agg(F.max("value")).first()[0] == pdf.price.max()
    with pytest.raises(ValueError, match="not found"):
        filters.column_values(df, "absent")


def test_clip_keeps_nulls(spark):
    df = spark.createDataFrame([(None,), (1.0,), (9.0,)], "v double")
    assert [r[0] for r in df.select(filters.clip_value(F.col("v"), (2.0, 5.0))).collect()] == [None, 2.0, 5.0]
    assert filters.get_clip_bounds(df.filter("v IS NULL"), ["v"]) == {}


def test_default_spec(listings):
    pdf, df = listings
    spec = filters.default_filter_spec(df)
    assert spec["_clip"] is True and "rooms" not in spec and "school_distance" not in spec
    assert spec["price"] == pytest.approx((pdf.price.quantile(0.01), pdf.price.quantile(0.99)))
    floor = pdf.floor.quantile([0.01, 0.99])
    assert spec["floor"] == (int(floor.iloc[0]), int(floor.iloc[1]))
    assert spec["centre_distance"] == (None, pytest.approx(pdf.centre_distance.quantile(0.99)))
    assert spec["poi_count"] == (int(pdf.poi_count.quantile(0.01)), None)


def test_default_spec_of_odd_columns(spark):
    df = spark.createDataFrame(
        [(5.0, None, None, None, None)], "price double, area_m2 double, floor int, poi_count double, centre_distance double"
    )
    spec = filters.default_filter_spec(df)
    assert spec["price"] == (5.0, 6.0) and spec["area_m2"] == (0.0, 1.0)
    assert spec["floor"] == (None, None) and spec["poi_count"] == (0.0, None) and spec["centre_distance"] == (None, 1.0)


def test_options(listings):
    _, df = listings
    rows = [(r["column"], r["raw"], r["display"]) for r in filters.filter_options(df).collect()]
    assert rows == [("district", d, d.title()) for d in ("ochota", "ursus", "wola")]


def test_kpis_and_trends(listings):
    pdf, df = listings
    row = stats.listing_kpis(df).first()
    assert row["n_listings"] == len(pdf)
    assert row["median_price_per_m2"] == pytest.approx(pdf.price_per_m2.median())
    assert row["median_price"] == pytest.approx(pdf.price.median())
    assert row["avg_area_m2"] == pytest.approx(pdf.area_m2.mean())
    by = pdf.groupby("month")
    expected = {
        "listings": by.size().astype(float), "median_price_per_m2": by.price_per_m2.median(),
        "median_price": by.price.median(), "avg_area_m2": by.area_m2.mean(),
    }
    for r in trends.month_trends(df).collect():
        last, before = expected[r["metric"]].iloc[-1], expected[r["metric"]].iloc[-2]
        assert (r["latest"], r["previous"]) == pytest.approx((last, before))
        assert r["change_pct"] == pytest.approx((last - before) / before * 100)
        assert r["direction"] == ("up" if last > before else "down" if last < before else "flat")
    area = expected["avg_area_m2"]
    assert trends.calculate_trend(df, F.avg("area_m2")) == pytest.approx((area.iloc[-1] / area.iloc[-2] - 1) * 100)
    assert trends.calculate_trend(df, trends.Metric("mean", "area_m2")) == pytest.approx((area.iloc[-1] / area.iloc[-2] - 1) * 100)


def test_trend_needs_two_months_and_a_base(listings, spark):
    _, df = listings
    single = df.filter("month = date'2024-02-01'")
    assert {r["change_pct"] for r in trends.month_trends(single).collect()} == {None}
    assert trends.calculate_trend(single, trends.Metric("count")) is None
    assert trends.calculate_trend(single, F.count(F.lit(1))) is None
    assert trends.calculate_trend(df.limit(0), trends.Metric("count")) is None
    assert trends.calculate_trend(df.drop("month"), trends.Metric("count")) is None
    zero = spark.createDataFrame([("2024-01-01", 0.0), ("2024-03-01", 5.0)], "month string, price double")
    assert trends.calculate_trend(zero, trends.Metric("median", "price")) is None
    with pytest.raises(ValueError):
        trends.Metric("sum")


def test_series_changes(spark):
    mart = spark.createDataFrame(
        [("w", "2024-01-01", 10.0), ("w", "2024-02-01", None), ("w", "2024-04-01", 15.0), ("k", "2024-01-01", 0.0),
         ("k", "2024-02-01", 4.0), ("x", "2024-01-01", 1.0)],
        "city string, month string, median_ppm2 double",
    )
    pct = {(r["city"], r["month"]): r["median_ppm2_mom"] for r in trends.pct_change(mart, "median_ppm2").collect()}
    assert pct[("w", "2024-02-01")] == 0.0 and pct[("w", "2024-04-01")] == pytest.approx(50.0)
    assert pct[("w", "2024-01-01")] is None and pct[("k", "2024-02-01")] is None
    last = {r["city"]: r for r in trends.latest_change(mart, "median_ppm2").collect()}
    assert last["w"]["latest"] == 15.0 and last["w"]["change_pct"] is None and last["w"]["n_months"] == 3
    assert last["k"]["change_pct"] is None and last["x"]["previous"] is None and last["x"]["direction"] is None


def test_histogram(listings, spark):
    pdf, df = listings
    rows = stats.histogram(df, "price", bins=20).collect()
    counts, edges = np.histogram(pdf.price, bins=20)
    found = dict(zip([r["bin"] for r in rows], [r["n"] for r in rows]))
    assert [found.get(i, 0) for i in range(20)] == list(counts)
    assert rows[0]["bin_lo"] == pytest.approx(edges[0]) and rows[-1]["bin_hi"] == pytest.approx(edges[-1])
    same = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    assert [(r["bin"], r["n"]) for r in stats.histogram(same, "v", bins=4).collect()] == [(0, 2)]
    row = stats.clipped_median(df, "price", bounds={"price": (0.0, 1.0)}).first()
    assert (row["n"], row["median"]) == (len(pdf), 1.0)


def test_boxes(listings):
    pdf, df = listings
    row = stats.box(df, "price").first()
    q1, q2, q3 = pdf.price.quantile([0.25, 0.5, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = pdf.price[pdf.price.between(low, high)]
    assert (row["p25"], row["median"], row["p75"]) == pytest.approx((q1, q2, q3))
    assert (row["whisker_low"], row["whisker_high"]) == (inside.min(), inside.max())
    assert row["n_outliers"] == len(pdf) - len(inside) == stats.box_outliers(df, "price").count()


@pytest.mark.parametrize("max_groups", [None, 3])
def test_box_by_category(listings, max_groups):
    pdf, df = listings
    rows = stats.box_by_category(df, "price", "district", min_n=30, max_groups=max_groups).collect()
    sizes = pdf.groupby("district").price.agg(["size", "median"])
    wanted = sizes[sizes["size"] >= 30].sort_values("median")
    assert [r["district"] for r in rows] == list(wanted.index)
    assert [r["n"] for r in rows] == list(wanted["size"]) and rows[0]["label"] == rows[0]["district"].title()


def test_box_orders(listings):
    pdf, df = listings
    by_count = stats.box_by_category(df, "price", "district", min_n=1, sort_by="count").collect()
    assert [r["district"] for r in by_count] == list(pdf.district.value_counts(ascending=True).index)
    chosen = stats.box_by_category(df, "price", "district", min_n=300, order=["wola", "ochota"]).collect()
    assert [r["district"] for r in chosen] == ["wola", "ochota"]
    bins = [r["floor_bin"] for r in stats.box_by_category(add_bins(df), "price", "floor_bin", min_n=1).collect()]
    assert bins == ["0-5", "5-10", "10-15", "15-20", "20+"]
    with pytest.raises(ValueError, match="min_n"):
        stats.box_by_category(df, "price", "district", min_n=10_000, require_groups=True)
    with pytest.raises(ValueError, match="sort_by"):
        stats.box_by_category(df, "price", "district", sort_by="name")


def test_trendline(listings):
    pdf, df = listings
    row = stats.ols_trendline(df, "area_m2", "price", bounds={"price": (1e5, 6e5)}).first()
    slope, intercept = np.polyfit(pdf.area_m2, pdf.price.clip(1e5, 6e5), 1)
    assert row["slope"] == pytest.approx(slope) and row["intercept"] == pytest.approx(intercept)
    assert stats.scatter_points(df, "area_m2", "price").count() == row["n"] == len(pdf)


def test_yields(listings, spark):
    pdf, df = listings
    rent_pdf = pdf.assign(market="rent", price_per_m2=pdf.price_per_m2 / 180)
    rent = spark.createDataFrame(rent_pdf.drop(columns="has_elevator"))
    rent = rent.unionByName(rent.limit(1).withColumn("district", F.lit("elsewhere")))
    rows = yields.yield_by_category(df, rent, "district", min_n=30).collect()
    merged = rent_pdf.merge(pdf.groupby("district").price_per_m2.median().rename("b").reset_index(), on="district")
    merged["y"] = merged.price_per_m2 * 12 / merged.b * 100
    expected = merged.groupby("district").y.agg(["count", "median", "mean"])
    expected = expected[expected["count"] >= 30].sort_values("median", ascending=False)
    assert [r["district"] for r in rows] == list(expected.index)
    assert [r["median"] for r in rows] == pytest.approx(list(expected["median"]))
    assert [r["mean"] for r in rows] == pytest.approx(list(expected["mean"]))
    summary = yields.yield_by_category(df, rent, "district", min_n=1)
    row = yields.median_of_groups(summary).first()
    assert row["n_groups"] == 3 and row["yield_median"] == pytest.approx(merged.groupby("district").y.median().median())


def test_salted_join_equals_broadcast_join(listings):
    _, df = listings
    small = df.groupBy("district").agg(F.max("price").alias("top"))
    def rows(limit):
        joined = joins.join_groups(df, small, ["district"], "price", small_rows=3, limit=limit)
        return sorted((r["listing_id"], r["top"]) for r in joined.collect())
    assert rows(0) == rows(3) and len(rows(0)) == df.count()


def test_repeats(spark):
    df = spark.createDataFrame(
        [("a", "2024-01-01")] * 3 + [("a", "2024-02-01"), ("b", "2024-01-01"), ("b", "2024-01-01"), ("c", "2024-03-01")],
        "property_fingerprint string, month string",
    )
    numbers, top = repeats.compute_repeat_stats(df, top_n=2)
    assert numbers == repeats.DuplicateStats(7, 3, 2, 6, 6 / 7, 1, 4, 4 / 7)
    assert [tuple(r) for r in top.collect()] == [
        ("a", 4, 2, "2024-01-01", "2024-02-01"), ("b", 2, 1, "2024-01-01", "2024-01-01"),
    ]
    empty, _ = repeats.compute_repeat_stats(df.limit(0))
    assert empty == repeats.DuplicateStats(0, 0, 0, 0, 0.0, 0, 0, 0.0)
    with pytest.raises(ValueError, match="month"):
        repeats.compute_repeat_stats(df.drop("month"))


def test_counts_and_checks(listings):
    pdf, df = listings
    assert [tuple(r) for r in stats.value_counts(df, "district", top=1).collect()] == [("wola", (pdf.district == "wola").sum())]
    assert [r["n"] for r in stats.value_counts(df, "month").collect()] == list(pdf.groupby("month").size())
    profile = stats.load_profile(df, ["price", "rooms", "lat"]).first()
    assert profile["missing_columns"] == "lat,rooms" and str(profile["max_month"]) == "2024-03-01"
    assert tuple(stats.quality_check(df.withColumn("price", -F.col("price"))).first()) == ("sale", 400, 400, 0, 0)
    assert stats.newest(df, ["month"], 10).count() == 10 and stats.preview(df).count() == 200


def test_market_report(listings):
    pdf, df = listings
    report = reports.market_report(df)
    kpi = report["kpis"].first()["n_listings"]
    assert 0 < kpi < len(pdf)
    assert report["histogram"].agg(F.sum("n")).first()[0] == kpi == report["scatter"].count()
    unfiltered = reports.market_report(df, {"_clip": False}, box_category="district")
    assert unfiltered["kpis"].first()["n_listings"] == len(pdf)
    assert unfiltered["trendline"].first()["n"] == len(pdf)
