"""Files in and out: monthly CSVs, stored tables, SQL views and the refresh stream."""

import datetime as dt
import json
import os
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThan, IsNotNull, LessThanOrEqual

from listingmart.operators.repeats import run_repeat_prevalence
from listingmart.plans import dataset, reports
from listingmart.sources import monthly_csv, monthly_headers, tables
from listingmart.streaming.refresh import refresh_long_table

HEADER = "id,city,type,squareMeters,price,latitude,longitude,rooms,hasBalcony"
JANUARY = """a1,Warszawa,tenement,50,500000,52.2,21.0,2,yes
a2, WARSZAWA,"block, of flats",40,400000,52.3,21.1,NA,no
a3,Kraków,tenement,50,1,50.0,19.9,1,no
a4,Warszawa,N/A,50,1,52.2,21.0,1,no
"""
FEBRUARY_HEADER = "price,id,type,city,squareMeters,longitude,latitude,rooms,extraColumn"
FEBRUARY = """520000,b1,tenement,warszawa,50,21.0,52.2,2,x
900000,b2,tenement,warszawa,90,21.0,52.2,2,x
"""


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)


@pytest.fixture
def raw(folder):
    write(f"{folder}/sale", "sale_2024_01.csv", f"{HEADER}\n{JANUARY}")
    write(f"{folder}/sale", "sale-2024-02.csv", f"{FEBRUARY_HEADER}\n{FEBRUARY}")
    write(f"{folder}/rent", "rent_2024_01.csv", f"{HEADER}\nr1,Warszawa,tenement,50,2500,52.2,21.0,2,yes\n")
    write(f"{folder}/rent", "rent_2024_03.csv", f"{HEADER}\nr1,Warszawa,tenement,50,2600,52.2,21.0,2,yes\n")
    return folder


def test_columns_are_matched_by_name(spark, raw):
    df = monthly_csv.load_sale_monthly(spark, f"{raw}/sale")
    rows = {r["listing_id"]: r for r in df.collect()}
    assert set(rows) == {"a1", "a2", "a3", "a4", "b1", "b2"}
    assert rows["b1"]["price"] == "520000" and rows["b1"]["lat"] == "52.2" and rows["b1"]["extraColumn"] == "x"
    assert rows["b1"]["has_balcony"] is None and rows["a1"]["extraColumn"] is None
    assert rows["a2"]["listing_type"] == "block, of flats" and rows["a2"]["rooms"] is None
    assert rows["a4"]["listing_type"] is None
    assert rows["a1"]["month"] == dt.date(2024, 1, 1) and rows["b2"]["month"] == dt.date(2024, 2, 1)
    assert {r["market"] for r in rows.values()} == {"sale"}


def test_files_with_one_header_share_a_scan(spark, folder):
    for month in range(1, 7):
        write(folder, f"sale_2024_0{month}.csv", f"{HEADER}\n{JANUARY}")
    df = monthly_csv.load_sale_monthly(spark, folder)
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1
    assert df.select("month").distinct().count() == 6


def job_count(spark, action):
    """How many jobs an action starts, by the status tracker."""
    group = f"jobs-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_headers_of_many_files_are_one_job(spark, folder):
    """The number of jobs that find the headers is that of a folder with three files."""
    headers = ["id,city,price", "price,id", "city,id,note"]
    for n in range(200):
        month = f"{2001 + n // 12}_{n % 12 + 1:02d}"
        write(f"{folder}/many", f"sale_{month}.csv", f"{headers[n % 3]}\n")
        if n < 3:
            write(f"{folder}/few", f"sale_{month}.csv", f"{headers[n % 3]}\n")
    found = {}
    jobs = [job_count(spark, lambda: found.update({k: monthly_csv.headers_of(spark, f"{folder}/{k}")})) for k in ("few", "many")]
    assert jobs == [1, 1]
    assert {h: len(paths) for h, paths in found["many"].items()} == {tuple(h.split(",")): n for h, n in zip(headers, (67, 67, 66))}
    assert sum(found["few"].values(), [])[0].startswith("file:/")


def test_only_files_of_the_wanted_months_are_opened(spark, folder):
    write(folder, "sale_2024_01.csv", f"{HEADER}\n{JANUARY}")
    write(folder, "sale_2024_02.csv", "unread")
    write(folder, "sale_2024_03.csv", f"{FEBRUARY_HEADER}\n{FEBRUARY}")
    months = {dt.date(2024, 1, 1), dt.date(2024, 3, 1)}
    df = monthly_csv.load_monthly(spark, folder, "sale", months=months)
    assert {r.month for r in df.select("month").distinct().collect()} == months and "unread" not in df.columns

    reader = monthly_headers.HeaderReader({"path": f"file:{folder}"})
    left = reader.pushFilters([GreaterThan(("month",), dt.date(2024, 1, 1)), IsNotNull(("month",)), LessThanOrEqual(("month",), dt.date(2024, 2, 1))])
    assert list(left) == [IsNotNull(("month",))]
    assert [p.paths for p in reader.partitions()] == [("sale_2024_02.csv",)]

    monthly_headers.register(spark)
    source = spark.read.format(monthly_headers.FORMAT).load(f"file:{folder}")
    late = source.filter("month > date'2024-01-01' AND month <= date'2024-03-01' AND month <> date'2024-02-01'")
    assert [r.header[0] for r in late.collect()] == ["price"]
    # What the source takes is not tested again by Spark: only the inequality is left.
    plan = late._jdf.queryExecution().optimizedPlan().toString()
    assert "= 2024-02-01)" in plan and "2024-01-01" not in plan and "2024-03-01" not in plan
    with pytest.raises(ValueError, match="no CSV file"):
        monthly_csv.load_monthly(spark, folder, "sale", months={dt.date(2030, 1, 1)})


def test_headers_are_read_as_the_csv_reader_names_them(spark, folder):
    texts = {
        "sale_2024_01.csv": "id,Price,price,,note\n1,2,3,4,5\n",
        "sale_2024_02.csv": '\ufeff"id","a ""b"", c"," d "\r\n1,2,3\r\n',
        "sale_2024_03.csv": '\n\nid,"two\nlines",city\n1,2,3\n',
        "sale_2024_04.csv": "",
        "sale_2024_05.csv": "id",
    }
    for name, text in texts.items():
        write(folder, name, text)
    for header, paths in monthly_csv.headers_of(spark, folder).items():
        for path in paths:
            own = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path).columns
            assert list(header) == own, path


def test_bad_file_names(spark, folder):
    with pytest.raises(ValueError, match="no CSV file of the rent market"):
        write(folder, "notes.txt", "x")
        monthly_csv.load_rent_monthly(spark, folder)
    write(folder, "sale_1999.csv", HEADER)
    with pytest.raises(ValueError, match="sale_1999.csv"):
        monthly_csv.load_sale_monthly(spark, folder)
    with pytest.raises(ValueError):
        monthly_csv.check_file_name("sale_2024_13.csv")
    names = spark.createDataFrame([("x_2023-07_2024_01.csv",)], "n string")
    assert names.select(monthly_csv.month_of_name(F.col("n"))).first()[0] == dt.date(2023, 7, 1)
    with pytest.raises(Exception, match="No month in the file name"):
        spark.createDataFrame([("x.csv",)], "n string").select(monthly_csv.month_of_name(F.col("n"))).collect()


def districts(folder):
    box = [[[20.9, 52.1], [21.05, 52.1], [21.05, 52.25], [20.9, 52.25], [20.9, 52.1]]]
    feature = {"type": "Feature", "properties": {"name": "Wola"}, "geometry": {"type": "Polygon", "coordinates": box}}
    write(folder, "districts.json", json.dumps({"type": "FeatureCollection", "features": [feature]}))
    return f"{folder}/districts.json"


def test_from_files_to_reports(spark, raw):
    out = f"{raw}/out"
    paths = dataset.build_dataset(spark, raw, out, districts(raw))
    assert sorted(os.listdir(paths["sale"]))[-2:] == ["month=2024-01-01", "month=2024-02-01"]
    named = dataset.build_database(spark, out)
    sale = {r["listing_id"]: r for r in spark.sql("SELECT * FROM listings_sale").collect()}
    assert set(sale) == {"a1", "a2", "b1", "b2"} and sale["a1"]["district"] == "wola" and sale["a2"]["district"] is None
    assert [r["listing_id"] for r in dataset.load_static(spark, "rent").collect()] == ["r1"]
    assert spark.table("listings_all").count() == 6
    assert {t.name for t in spark.catalog.listTables()} >= set(named)
    described = {r["col_name"] for r in spark.sql("DESCRIBE listings_sale_static").collect()}
    assert {"property_fingerprint", "price_per_m2", "district"} <= described
    newest = spark.sql("SELECT month, city, price FROM listings_sale ORDER BY month DESC LIMIT 10").collect()
    assert newest[0]["month"] == dt.date(2024, 2, 1)
    proxy = dataset.load_mart(spark, "yield_proxy").collect()
    assert len(proxy) == 1 and proxy[0]["gross_yield_proxy"] == pytest.approx(50 * 12 / 10000)
    series = reports.time_series_report(named)
    assert [r["n_listings"] for r in series["sale"].collect()] == [2, 2]
    assert series["rent_latest"].first()["change_pct"] == pytest.approx(4.0)
    by_rooms = reports.yield_report(named["listings_sale_static"], named["listings_rent_static"], "rooms", {})
    assert by_rooms["listings"].first()[0] == 1 and by_rooms["summary"].count() == 0
    numbers, _ = run_repeat_prevalence(spark, paths["rent"])
    assert (numbers.total_records, numbers.multi_month_fingerprints) == (2, 1)


def test_stored_tables(spark, folder):
    df = spark.createDataFrame([("sale", "2024-01-01", 1.0, "x"), ("rent", "2024-02-01", 2.0, 'a "b", c')], "market string, month string, price double, note string")
    path = tables.save_processed(df, folder, "long")
    assert path.endswith("/long.parquet") and tables.load_processed(spark, folder, "long").count() == 2
    csv = tables.export_csv(df, f"{folder}/out.csv")
    back = spark.read.option("header", True).option("escape", '"').schema(df.schema).csv(csv)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError, match="lat"):
        tables.load_parquet_filtered(spark, path)
    shuffled = df.select("price", "note", "month", "market")
    assert tables.union_markets(df, shuffled).filter("price > 1").count() == 2


def test_partition_filter_reaches_the_scan(spark, folder):
    df = spark.createDataFrame([("sale", "2024-01-01", 1.0), ("rent", "2024-02-01", 2.0)], "market string, month string, price double")
    path = tables.save_processed(df.withColumn("month", F.to_date("month")), folder, "long")
    plan = spark.read.parquet(path).filter("market = 'sale' AND price > 0.5").select("price")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(market" in text and "GreaterThan(price,0.5)" in text
    assert "ReadSchema: struct<price:double>" in text


def test_refresh_stream_equals_batch(spark, raw):
    target, checkpoint = f"{raw}/long", f"{raw}/checkpoint"

    def run():
        refresh_long_table(spark, f"{raw}/sale", "sale", target, checkpoint).awaitTermination(120)
        return sorted((r["listing_id"], str(r["month"]), r["price"]) for r in spark.read.parquet(target).collect())

    first = run()
    assert {r[0] for r in first} == {"a1", "a2", "b1", "b2"}
    write(f"{raw}/sale", "more_2024_02.csv", f"{HEADER}\nb3,Warszawa,tenement,60,700000,52.2,21.0,2,yes\n")
    second = run()
    assert {r[0] for r in second} == {"a1", "a2", "b1", "b2", "b3"}
    assert run() == second


def test_quoted_line_breaks_stay_in_one_row(spark, folder):
    write(folder, "sale_2024_01.csv", f'{HEADER}\nq1,Warszawa,"two\nlines",50,500000,52.2,21.0,2,yes\nq2,Warszawa,tenement\n')
    rows = {r["listing_id"]: r for r in monthly_csv.load_sale_monthly(spark, folder).collect()}
    assert set(rows) == {"q1", "q2"}
    assert rows["q1"]["listing_type"] == "two\nlines" and rows["q1"]["price"] == "500000"
    assert rows["q2"]["price"] is None


def test_surplus_fields_fail(spark, folder):
    write(folder, "sale_2024_01.csv", f"{HEADER}\n{JANUARY}a9,Warszawa,tenement,50,1,52.2,21.0,1,no,more\n")
    with pytest.raises(Exception, match="more fields than the header"):
        monthly_csv.load_sale_monthly(spark, folder).select("listing_id").collect()


def test_refresh_drops_a_month_that_came_out_empty(spark, raw):
    target, checkpoint = f"{raw}/long", f"{raw}/checkpoint"

    def run():
        refresh_long_table(spark, f"{raw}/sale", "sale", target, checkpoint).awaitTermination(120)
        return {r["listing_id"] for r in spark.read.parquet(target).collect()}

    assert run() == {"a1", "a2", "b1", "b2"}
    write(f"{raw}/sale", "sale-2024-02.csv", f"{FEBRUARY_HEADER}\n520000,b1,tenement,warszawa,0,21.0,52.2,2,x\n")
    write(f"{raw}/sale", "more_2024_02.csv", f"{HEADER}\nb3,Warszawa,tenement,0,700000,52.2,21.0,2,yes\n")
    assert run() == {"a1", "a2"}


def test_marts_are_stored(spark, raw):
    dataset.build_dataset(spark, raw, f"{raw}/out")
    tables_of = dataset.build_database(spark, f"{raw}/out")
    plan = tables_of["mart_city_month_yield_proxy"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "mart_city_month_yield_proxy.parquet" in plan
    static = tables_of["listings_sale_static"].filter(F.col("month") == dt.date(2024, 2, 1))
    assert "PartitionFilters: [isnotnull(month" in static._jdf.queryExecution().executedPlan().toString()
