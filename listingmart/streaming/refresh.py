"""Refresh of a stored long table as monthly files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from listingmart.functions.fingerprint import FingerprintConfig
from listingmart.operators.clean import clean_base
from listingmart.operators.districts import DistrictLayer
from listingmart.plans.incremental import refresh_derived
from listingmart.sources.monthly_csv import check_file_name, load_monthly
from listingmart.sources.tables import replace_months

FILE_LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def _month(path: str):
    return check_file_name(path.rsplit("/", 1)[-1])


def refresh_long_table(
    spark: SparkSession,
    raw_folder: str,
    market: str,
    long_path: str,
    checkpoint: str,
    layer: DistrictLayer | None = None,
    *,
    cfg: FingerprintConfig | None = None,
    derived: str | None = None,
) -> StreamingQuery:
    """Process the files that are new since the last run, then stop.

    The stream carries file names only. For every month that got a file, all files of the month are
    cleaned again and its partition is replaced, so a repeated batch leaves the same table, and a
    month delivered in several files stays whole. A month whose files hold no valid listing any more
    loses its partition. A file that is written again under its old name does not count as new.

    ``derived`` is the folder that `build_database` filled; its static table and marts then follow (``long_path`` has to
    be the long table of that folder).
    """

    def arrived(batch: DataFrame, _: int) -> None:
        months = {_month(row.path) for row in batch.collect()}
        if not months:
            return
        long = clean_base(load_monthly(spark, raw_folder, market, months=months), layer, cfg=cfg)
        replace_months(long, long_path, months)
        if derived is not None:
            refresh_derived(spark, derived, market, months)

    arrivals = (
        spark.readStream.format("binaryFile")
        .schema(FILE_LISTING)
        .option("pathGlobFilter", "*.csv")
        .load(raw_folder)
        .select("path")
    )
    return (
        arrivals.writeStream.foreachBatch(arrived)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
