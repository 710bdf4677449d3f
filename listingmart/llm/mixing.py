"""Mixing sources to target weights: repetition rates per source and hash-seeded copies per document.

Sizes are summed per source (partial sums before the shuffle, so a hot source is no hot task). The wanted total is
shared by weight; no source may exceed ``max_rate`` times its own size, and what it cannot take is shared again by
weight among the rest. The shares are found by rounds over the table of sources, each a distributed sum of which three
numbers reach the driver. A document is taken floor(rate) times, and once more with the probability of the fraction,
drawn from a hash of seed, source and id, so reruns and lost executors draw alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingmart.llm.common import attach, need, stored, unused

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_RATE = 2
SEED = "mix-1"
# Columns that `mixed` adds.
OWN = ("size", "source_size", "target", "copies")
WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def ranked(sources: DataFrame) -> DataFrame:
    """Sources with their place (from 0) by code point, null last; placed by a distributed sort."""
    # Spark compares strings by their UTF-8 bytes, which is the order of code points.
    ordered = sources.orderBy(F.col("source").asc_nulls_last())
    schema = T.StructType([*ordered.schema.fields, T.StructField("place", T.LongType())])
    return sources.sparkSession.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    With nothing to share (no source, or all sizes 0) every target is 0.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    table = stored(ranked(sizes).withColumn("weight", weight).withColumn("most", (max_rate * F.col("source_size")).cast("double")))
    total = share * float(table.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        # A source that is full at this level is full at any later one, for the level only rises.
        full = F.col("most") <= F.lit(level) * F.col("weight")
        held, weighed, n = table.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if not weighed:
            break
        new = max(level, (total - (held or 0.0)) / weighed)
        if new == level:
            break
        level = new
    target = F.least(F.col("most"), F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def draw(seed: str, *parts: Column) -> Column:
    """Uniform number in [0, 1) from a hash of the parts (52 bits of an MD5)."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) with size, source_size, target and copies (0 or more).

    Null text has size 0. Null source is a source of its own. Repeated rows draw alike. Rows with size 0 are kept or
    repeated by the same draw; they take no words. Other columns stay; size, source_size, target and copies are
    overwritten if they exist.
    """
    need(docs, "doc_id", "text", "source")
    docs = docs.drop(*OWN).withColumn("size", size_of(F.col("text")))
    sizes = stored(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    wanted = targets(sizes, weights, share, max_rate)
    key = unused("_source", docs)
    named = F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")).alias(key)
    keyed = stored(wanted.select(named, "source_size", "target"))
    joined = attach(docs.select("*", named), keyed, [key], "inner", "doc_id").drop(key)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = draw(seed, F.col("source"), F.col("doc_id")) < rate - F.floor(rate)
    return joined.withColumn("copies", F.floor(rate) + extra.cast("bigint"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    # The mix's own columns must not take the place of the table's.
    clashing = [c for c in docs.columns if c.lower() in OWN]
    names = {c: unused(f"_own_{c}", docs) for c in clashing}
    taken = mixed(docs.withColumnsRenamed(names), **options)
    copy = unused("_copy", taken)
    every = taken.filter("copies > 0").withColumn(copy, F.explode(F.expr("sequence(1L, copies)")))
    return every.select(*(F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns))
