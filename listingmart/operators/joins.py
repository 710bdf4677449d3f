"""Join of a large table with a per-group table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000
# Rows of one key are spread over this many tasks when the small side is too large to broadcast.
SALTS = 64


def join_groups(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: str,
    *,
    small_rows: int | None,
    limit: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Inner join on ``keys``; ``small`` has one row per key.

    ``small_rows`` is a known bound on its size: within ``limit`` it is broadcast. Otherwise both
    sides are shuffled with a salt taken from the ``spread`` column, so that a key with most of the rows does
    not end up in one task.
    """
    keys = list(keys)
    if small_rows is not None and small_rows <= limit:
        return big.join(F.broadcast(small), keys)
    salted = big.withColumn("_salt", F.expr(f"cast(pmod(xxhash64(`{spread}`), {SALTS}) AS int)"))
    copies = small.withColumn("_salt", F.expr(f"explode(sequence(0, {SALTS - 1}))"))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def counted(small: DataFrame) -> tuple[DataFrame, int]:
    """Compute a per-group table once and return it with its row count."""
    kept = small.persist()
    return kept, kept.count()
