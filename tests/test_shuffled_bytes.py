"""What whole rows carry through the shuffles before the long and the static table, and what decides the number of tasks."""

import gzip
import os

from listingmart.functions.fingerprint import FingerprintConfig
from listingmart.operators.clean import clean_base
from listingmart.operators.dedup import one_row_per_property
from listingmart.plans import dataset
from listingmart.sources import monthly_csv


def raw(spark):
    return spark.sql("""SELECT concat('l', id) AS listing_id, 'sale' AS market, 'Warszawa' AS city, 'x' AS listing_type, DATE'2024-01-01' + cast(31 * (id % 2) AS int) AS month,
        cast(40 + id % 3 + if(id % 5 = 0, 0.4, 0) AS string) AS area_m2, cast(100 + id AS string) AS price, if(id % 4 = 0, NULL, 52.1 + (id % 6) / 100) AS lat, 21.0D AS lon,
        CASE id % 4 WHEN 0 THEN '3.5' WHEN 1 THEN '4' WHEN 2 THEN '-999999' END AS floor, CASE id % 3 WHEN 0 THEN '1990.2' WHEN 1 THEN '1990' END AS build_year,
        if(id % 2 = 0, 'yes', 'n') AS has_balcony FROM range(300)""")


def test_the_key_is_not_shuffled_and_the_rows_are_the_same(spark):
    for cfg in (None, FingerprintConfig(area_step=5.0, fingerprint_cols=("floor",))):
        plain, stored = (clean_base(raw(spark), cfg=cfg, by_month=b) for b in (False, True))
        assert stored.columns == plain.columns and stored.count() > 0
        assert sorted(map(str, stored.collect())) == sorted(map(str, plain.collect()))
        plan = stored._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        below = plan[plan.index("Exchange ") :]
        assert plan.count("Exchange ") == 1 and "AS property_fingerprint" not in below and "AS property_fingerprint" in plan


def test_a_static_tables_rows_are_shuffled_without_a_hash_of_the_key(spark):
    long = spark.sql("SELECT concat('p', id % 9) AS property_fingerprint, DATE'2024-01-01' AS month, double(id) AS price, 'a' AS listing_id FROM range(20)")
    plan = one_row_per_property(long, by_month=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "_key_hash" not in plan[plan.index("Exchange hashpartitioning") :]


def test_csv_files_are_not_read_to_count_their_rows(spark, folder, monkeypatch):
    """The size of the files tells about how many rows they hold; the build job reads them once."""
    header = "id,city,type,squareMeters,price,latitude,longitude"
    for market in ("sale", "rent"):
        os.makedirs(f"{folder}/{market}")
        text = "\n".join([header, *(f"{market}{i},Warszawa,x,40,{100 + i},52.1,21.0" for i in range(400))]) + "\n"
        with open(f"{folder}/{market}/{market}_2024_01.csv", "w") as f:
            f.write(text)
        with gzip.open(f"{folder}/{market}/{market}_2024_02.csv.gz", "wt") as f:
            f.write(text)
    size = sum(-(-os.path.getsize(f"{folder}/sale/sale_2024_0{n}") // per) for n, per in (("1.csv", monthly_csv.ROW_BYTES), ("2.csv.gz", monthly_csv.PACKED_ROW_BYTES)))
    assert monthly_csv.rows_about(spark, f"{folder}/sale") == size

    def count(self):
        raise AssertionError("a table was counted")

    monkeypatch.setattr(type(spark.range(1)), "count", count)
    paths = dataset.build_dataset(spark, folder, f"{folder}/out")
    assert {m: len(spark.read.parquet(p).collect()) for m, p in paths.items()} == {"sale": 2, "rent": 2}


def test_a_stored_tables_shuffle_files_are_deleted(spark, folder):
    """The files of a write's shuffle go with the next write at the latest, whether it shuffles or not."""
    import time

    from listingmart.sources.tables import save_processed

    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        files = blocks.getAllFiles()
        names = [files.apply(i).getName() for i in range(files.size())]
        return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    before = shuffled()
    rows = spark.range(50_000).selectExpr("uuid() AS id", "id % 3 AS month")
    save_processed(rows.repartition("month"), folder, "rows", partition_by=("month",), regroup=False)
    made = shuffled() - before
    save_processed(spark.range(3).coalesce(1), folder, "few", partition_by=(), regroup=False)
    left = shuffled() & made
    for _ in range(40):
        if not left:
            break
        time.sleep(0.25)
        left = shuffled() & made
    assert not left and spark.read.parquet(f"{folder}/rows.parquet").count() == 50_000
