"""Helpers that the operators share: intermediate tables, joins with a table of unknown size, batches handed to Python."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# A table is broadcast only after it was stored and counted, and only up to so many rows and bytes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 16 << 20
# Rows of one key are spread over so many tasks where the other side cannot be broadcast.
SALTS = 32
# Bytes of rows that a task hands to Python at a time. Spark's own bound (64 MB, 10,000 rows) lets long texts fill some 100 MB
# outside the heap for each task, in doubling buffers, and as much again in its worker.
HANDED, HANDED_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="llm-")


def scratch(spark: SparkSession) -> str:
    """A new folder for intermediate tables, below the shared ``spark.checkpoint.dir``.

    Only a session on the local machine that lacks the setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors can reach.")
        folder = _own_folder()
    return f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True if a stored table is proven to fit a broadcast. String and binary columns count with their real length."""
    wide = [F.octet_length(c) for c, kind in table.dtypes if kind in ("string", "binary")]
    length = sum((F.coalesce(c, F.lit(0)) for c in wide), F.lit(8 * len(table.columns)))
    n, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(length), F.lit(0))).first()
    return n <= rows and total <= size


def by_shuffle(table: DataFrame) -> DataFrame:
    """A side of a join that Spark must not broadcast on its own. It guesses sizes from compressed files, and of rows that are
    exploded not even that; the driver would hold many times as much."""
    return table.hint("shuffle_merge")


def side(table: DataFrame) -> DataFrame:
    """A stored table as a side of a join: Spark may broadcast it only if its checked size allows it."""
    return table if is_small(table) else by_shuffle(table)


def attach(big: DataFrame, small: DataFrame, on: Sequence[str], how: str, spread: str) -> DataFrame:
    """Join a large table with a stored table that has one row per key (``how``: inner, left, left_semi, left_anti).

    The stored table is broadcast if its checked size allows it. Otherwise both sides are shuffled, with a salt taken
    from the ``spread`` column of the large side, so that a key that holds a third of the rows meets in many tasks.
    """
    on = list(on)
    if is_small(small):
        return big.join(F.broadcast(small), on, how)
    salt = unused("_salt", big, small)
    salted = big.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(by_shuffle(copies), [*on, salt], how).drop(salt)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """`mapInArrow` over batches of about `HANDED_BYTES`, a longer row alone.

    The bound is a setting of the session and stays there; one that the session already has is left as it is.
    """
    conf = df.sparkSession.conf
    if conf.get(HANDED, None) is None:
        conf.set(HANDED, str(HANDED_BYTES))
    return df.mapInArrow(run, schema)


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores until no column of the tables is called so (in any case)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def need(df: DataFrame, *columns: str) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"Columns are missing: {', '.join(absent)}")
