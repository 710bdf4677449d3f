"""Property fingerprint: one text key per physical property."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingmart.schema import SENTINEL

# Attributes that take part in the key, in key order.
KEY_ATTRIBUTES = (
    "market",
    "city",
    "listing_type",
    "build_year",
    "floors_total",
    "floor",
    "has_elevator",
    "has_balcony",
    "has_parking_space",
    "has_security",
    "has_storage_room",
)
MISSING_TOKEN = "<NA>"


@dataclass(frozen=True)
class FingerprintConfig:
    """Rounding of the coordinates, grid of the area and the attributes of the key."""

    lat_round: int = 4
    lon_round: int = 4
    area_step: float = 1.0
    fingerprint_cols: tuple[str, ...] = KEY_ATTRIBUTES


def round_half_even(c: Column, digits: int) -> Column:
    scale = F.lit(10.0**digits)
    return F.rint(c * scale) / scale


def quantize(c: Column, step: float) -> Column:
    """Nearest multiple of ``step``, ties to the even multiple."""
    if step <= 0:
        raise ValueError("area_step must be > 0")
    return F.rint(c / F.lit(float(step))) * F.lit(float(step))


def key_text(c: Column, dtype: T.DataType) -> Column:
    """Deterministic text of one key part. Numbers go through double, so that a column gives the
    same key before and after it is stored as an integer."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "1").otherwise("0")
    if isinstance(dtype, T.NumericType):
        return F.coalesce(c.cast("double"), F.lit(SENTINEL)).cast("string")
    return F.coalesce(c.cast("string"), F.lit(MISSING_TOKEN))


def add_property_fingerprint(
    df: DataFrame,
    cfg: FingerprintConfig | None = None,
    *,
    lat_col: str = "lat",
    lon_col: str = "lon",
    area_col: str = "area_m2",
    out_col: str = "property_fingerprint",
) -> DataFrame:
    """Append the key; the columns it is made of keep their types and nulls."""
    return df.withColumn(out_col, fingerprint_of(df, cfg, lat_col=lat_col, lon_col=lon_col, area_col=area_col))


def fingerprint_of(
    df: DataFrame,
    cfg: FingerprintConfig | None = None,
    *,
    lat_col: str = "lat",
    lon_col: str = "lon",
    area_col: str = "area_m2",
) -> Column:
    """The key of the rows of ``df``."""
    cfg = cfg or FingerprintConfig()
    missing = [c for c in (lat_col, lon_col, area_col) if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns for fingerprinting: {missing}")
    number = T.DoubleType()
    parts = [
        key_text(round_half_even(F.col(lat_col), cfg.lat_round), number),
        key_text(round_half_even(F.col(lon_col), cfg.lon_round), number),
        key_text(quantize(F.col(area_col), cfg.area_step), number),
    ]
    parts += [
        key_text(F.col(c), df.schema[c].dataType) for c in cfg.fingerprint_cols if c in df.columns
    ]
    return F.concat_ws("|", *parts)
