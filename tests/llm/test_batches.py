"""Rows that the operators hand to Python: a bounded number of bytes at a time, however long the texts are."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from listingmart.llm import common, langid, ngram_join, packing, queries, toxicity


@pytest.fixture
def unset(spark):
    before = spark.conf.get(common.HANDED, None)
    spark.conf.unset(common.HANDED)
    yield spark
    spark.conf.unset(common.HANDED) if before is None else spark.conf.set(common.HANDED, before)


def documents(spark, n):
    """Texts of 4,000 bytes in one partition, one of them longer than a batch."""
    rows = spark.range(0, n, 1, 1).withColumnRenamed("id", "doc_id")
    long = F.when(F.col("doc_id") == n // 2, F.repeat(F.lit("word "), common.HANDED_BYTES // 4)).otherwise(F.rpad(F.col("doc_id").cast("string"), 4000, " abc"))
    return rows.select("doc_id", long.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))


def sizes():
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    return run


def test_batches_are_bounded_by_bytes(unset):
    found = common.in_batches(documents(unset, 3000), sizes(), "n long, size long").collect()
    assert sum(r.n for r in found) == 3000
    small = [r.size for r in found if r.size < 1.1 * common.HANDED_BYTES]
    assert len(found) >= 5 and len(small) >= len(found) - 1 and max(r.size for r in found) < 3 * common.HANDED_BYTES


@pytest.mark.parametrize(
    "call",
    [
        lambda docs: toxicity.scored(docs, toxicity.constant(0.5)),
        lambda docs: toxicity.kept(docs, toxicity.constant(0.5)),
        lambda docs: toxicity.hashed(docs.select(F.col("doc_id").alias("place"), F.struct(F.lit(1).alias("toxic"), "lang").alias("label"), "text")),
        lambda docs: langid.model(docs.limit(20)) and docs,
        lambda docs: ngram_join.describe(docs.withColumnRenamed("doc_id", "id"), 5),
        lambda docs: packing.pieces(docs, queries.tokenizer()),
    ],
)
def test_operators_hand_over_bounded_batches(unset, call):
    call(documents(unset, 3000))
    found = documents(unset, 3000).mapInArrow(sizes(), "n long, size long").collect()
    assert max(r.size for r in found) < 3 * common.HANDED_BYTES


def test_a_bound_of_the_session_stays(unset):
    unset.conf.set(common.HANDED, "123456")
    found = common.in_batches(documents(unset, 300), sizes(), "n long, size long").collect()
    assert unset.conf.get(common.HANDED) == "123456" and len(found) > 9
