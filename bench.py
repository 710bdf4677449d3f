"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of local cores. Every result is
computed in full. ``build_tables`` is the one-time build of the stored listing tables; the queries
after it read these tables, except those that start from raw listings.
"""

from __future__ import annotations

import json
import os
import time

from checks import queries as registry
from listingmart.session import local_session

HEADLINES = (
    "clean_counts", "dedup_within_month", "district_counts", "fingerprints",
    "mart_sale", "mart_rent", "mart_yield_proxy", "static_sale", "static_rent", "listings_all_qa",
    "filter_combined", "default_filter_bounds", "clip_bounds", "winsorized", "default_view",
    "kpi", "kpi_trend", "histogram", "box_overall", "box_by_district", "box_by_build_year_bin",
    "ols_trendline", "yield_by_district", "yield_by_rooms", "yield_median_of_medians",
    "mom_change", "mom_latest", "repeat_groups", "repeat_stats", "top_repeats", "labels",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    took: dict[str, float] = {}

    def timed(name: str, action) -> None:
        start = time.perf_counter()
        action()
        took[name] = round(time.perf_counter() - start, 3)

    timed("build_tables", lambda: registry.fixture(spark, sf_dir))
    queries = registry.registered()
    for name in HEADLINES:
        timed(name, lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
