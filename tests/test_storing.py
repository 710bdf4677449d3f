"""Long tables are stored with one shuffle; packed monthly files are read like plain ones."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from listingmart.functions.coercion import normalize_city, to_boolean
from listingmart.operators.dedup import deduplicate_within_month
from listingmart.sources.monthly_csv import list_csv_files, load_monthly


def listings(spark):
    return spark.sql("""SELECT concat('l', id) AS listing_id, if(id % 17 = 0, NULL, concat('p', id % 40)) AS property_fingerprint,
        if(id % 19 = 0, NULL, add_months(DATE'2024-01-01', cast(id % 5 AS int))) AS month, if(id % 7 = 0, NULL, double(id % 3)) AS price
        FROM range(2000) AS t(id)""")


def test_rows_stored_by_month_are_shuffled_once_and_the_same(spark):
    df = listings(spark)
    stored, plain = deduplicate_within_month(df, by_month=True), deduplicate_within_month(df)
    assert stored.columns == plain.columns
    assert sorted(map(str, stored.collect())) == sorted(map(str, plain.collect()))
    plan = stored._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange ") == 1
    # Nothing is sorted before the shuffle.
    assert "Sort" not in plan[plan.index("Exchange ") :]


@pytest.mark.parametrize("name", ["sale_2024_01.csv.gz", "sale_2024_01.csv"])
def test_packed_files_are_read(spark, folder, name):
    text = "id,city,price,note\na,Warszawa,1,\"x\ny\"\nb,Kraków,2,\n".encode()
    os.makedirs(f"{folder}/sale")
    with open(f"{folder}/sale/{name}", "wb") as f:
        f.write(gzip.compress(text) if name.endswith(".gz") else text)
    rows = load_monthly(spark, f"{folder}/sale", "sale").orderBy("price").collect()
    assert [(r.city, r.price, r.note, str(r.month)) for r in rows] == [("Warszawa", "1", "x\ny", "2024-01-01"), ("Kraków", "2", None, "2024-01-01")]
    assert [p.rsplit("/", 1)[1] for p in list_csv_files(spark, f"{folder}/sale")] == [name]


def test_words_and_cities_with_any_blanks(spark):
    blanks = ["\t", " ", "\x1c", " ", "　", "\u0085", "\x0b", " "]
    words = [(f"{b}Yes{b}{b}", True) for b in blanks] + [("n", False), ("F", False), ("y es", None), ("maybe", None), ("", None), (None, None)]
    df = spark.createDataFrame(words, "w string, expected boolean")
    found = df.select("expected", to_boolean("w", df.schema["w"].dataType).alias("got")).collect()
    assert [r.got for r in found] == [r.expected for r in found]
    cities = [(f"{b}Nowy{b}{b}Sącz{b}", "nowy sącz") for b in blanks] + [("ŁÓDŹ", "łódź"), ("", ""), (None, None)]
    df = spark.createDataFrame(cities, "c string, expected string")
    assert df.filter(~normalize_city("c").eqNullSafe(F.col("expected"))).count() == 0


def test_what_a_task_sorts_does_not_follow_the_rows(spark, monkeypatch):
    from listingmart.operators import dedup

    monkeypatch.setattr(dedup, "TASK_ROWS", 500)
    monkeypatch.setattr(dedup, "PART_ROWS", 1000)
    most = []
    for n in (20_000, 80_000):
        df = spark.range(n).selectExpr("concat('l', id) AS listing_id", "concat('p', id) AS property_fingerprint", "add_months(DATE'2024-01-01', cast(id % 84 AS int)) AS month", "double(id % 3) AS price")
        stored = deduplicate_within_month(df, by_month=True, rows=n)
        most.append(stored.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        assert stored.count() == n
    assert max(most) < 3000
    rows = listings(spark)
    assert sorted(map(str, deduplicate_within_month(rows, by_month=True, rows=2000).collect())) == sorted(map(str, deduplicate_within_month(rows).collect()))
