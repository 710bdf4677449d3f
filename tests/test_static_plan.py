"""One row per property of a long table: the same rows as of any table, without sorting whole rows in the map tasks."""

from __future__ import annotations

import random
from datetime import date

from listingmart.operators.dedup import one_row_per_property


def long_table(spark):
    rng = random.Random(6)
    rows = {(f"p{rng.randint(0, 80)}", date(2024, rng.randint(1, 12), 1)): (float(rng.randint(1, 3)), f"id{rng.randint(0, 5)}", n) for n in range(600)}
    rows = [(*key, *rest) for key, rest in rows.items()] + [(None, date(2024, 1, 1), 1.0, "id0", -1), ("p1", None, 1.0, "id0", -2)]
    return spark.createDataFrame(rows, "property_fingerprint string, month date, price double, listing_id string, n int")


def test_a_long_tables_static_rows_are_the_same(spark):
    long = long_table(spark)
    found, plain = (sorted(map(tuple, one_row_per_property(long, by_month=b).collect())) for b in (True, False))
    assert found == plain and len(found) == 81


def test_rows_of_a_long_table_are_sorted_after_the_shuffle_only(spark):
    plan = one_row_per_property(long_table(spark), by_month=True)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning") :]
    assert plan.count("Exchange hashpartitioning") == 1 and "Sort [" not in below and "WindowGroupLimit" not in below
