"""Cleaning chain: typed columns, validity filters, district, fingerprint, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmart.functions import coercion
from listingmart.functions.fingerprint import FingerprintConfig, add_property_fingerprint, fingerprint_of
from listingmart.operators.dedup import deal_by_month, deduplicate_within_month
from listingmart.operators.districts import DistrictLayer, assign_district
from listingmart.schema import (
    AMENITY_COLUMNS,
    CITY,
    CRITICAL_COLUMNS,
    FLOAT_COLUMNS,
    INTEGER_COLUMNS,
    REQUIRED_COLUMNS,
)


def require_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED_COLUMNS) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def coerce_types(df: DataFrame) -> DataFrame:
    """Give every known column its type; optional columns that are absent stay absent. Whole numbers
    stay double here, because the fingerprint is made of the double."""
    types = {f.name: f.dataType for f in df.schema.fields}
    typed = {
        "month": coercion.to_month("month", types["month"]),
        "city": coercion.normalize_city("city"),
    }
    for c in ("price", "area_m2", *FLOAT_COLUMNS):
        if c in types:
            typed[c] = coercion.to_number(c, types[c])
    for c in INTEGER_COLUMNS:
        if c in types:
            typed[c] = coercion.to_whole_number(c, types[c])
    for c in AMENITY_COLUMNS:
        if c in types:
            typed[c] = coercion.to_boolean(c, types[c])
    return df.withColumns(typed)


def drop_invalid(df: DataFrame) -> DataFrame:
    """Drop rows with a null critical field, a non-positive price or a non-positive area."""
    return df.dropna(subset=list(CRITICAL_COLUMNS)).filter((F.col("price") > 0) & (F.col("area_m2") > 0))


def filter_city(df: DataFrame, city: str = CITY) -> DataFrame:
    if "city" not in df.columns:
        raise ValueError("Missing required column: city")
    return df.filter(F.col("city") == city)


def add_price_per_m2(df: DataFrame) -> DataFrame:
    return df.withColumn("price_per_m2", F.try_divide("price", "area_m2"))


def cast_integers(df: DataFrame) -> DataFrame:
    """Store whole-number columns as nullable integers."""
    types = {f.name: f.dataType for f in df.schema.fields}
    present = [c for c in INTEGER_COLUMNS if c in types]
    numbers = df.withColumns({c: coercion.to_number(c, types[c]) for c in present})
    return numbers.withColumns({c: coercion.to_int(c) for c in present})


def locate_and_key(
    df: DataFrame, layer: DistrictLayer | None, cfg: FingerprintConfig | None = None
) -> DataFrame:
    """District and fingerprint of valid listings. Without a layer the district is unknown."""
    return add_property_fingerprint(locate(df, layer), cfg)


def locate(df: DataFrame, layer: DistrictLayer | None) -> DataFrame:
    """District of valid listings with a place."""
    if layer is None:
        return df.dropna(subset=["lat", "lon"]).withColumn("district", F.lit(None).cast("string"))
    return assign_district(df, layer)


def clean_base(
    df: DataFrame,
    layer: DistrictLayer | None = None,
    *,
    cfg: FingerprintConfig | None = None,
    city: str = CITY,
    by_month: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Raw listings -> long table: one row per property and month, typed, located and keyed. ``by_month`` and ``rows`` as in the deduplication.

    Rows that are shuffled by month leave their key behind, the longest of their texts, and get it again where they meet."""
    located = (
        require_columns(df)
        .transform(coerce_types)
        .transform(drop_invalid)
        .transform(filter_city, city)
        .transform(locate, layer)
    )
    if by_month:
        located = deal_by_month(located, fingerprint_of(located, cfg), rows=rows)
    return (
        located.transform(add_property_fingerprint, cfg)
        .transform(cast_integers)
        .transform(deduplicate_within_month, by_month=by_month, dealt=by_month)
        .transform(add_price_per_m2)
    )
