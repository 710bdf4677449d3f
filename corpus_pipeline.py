"""Corpus pipeline: from the documents table to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read as the next stage's
docs. All stages but the last return the columns of documents. Null, empty and repeated rows follow the docstrings of
the operators; no stage samples or cuts its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingmart.llm import langid, mixing, ngram_join, packing, queries, toxicity
from listingmart.llm.common import attach, scratch, stored, unused


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold of their language."""
    return toxicity.kept(docs, toxicity.model(docs, queries.table(spark, sf_dir, "labels")))


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that some known language fits."""
    return langid.kept(docs, langid.model(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id.

    Rows without an id, and texts without words, belong to no class and stay. Rows that repeat an id are judged one by one, by
    the shingles of their texts; of those that also share these, and of those without words, one stays.
    """
    found = stored(ngram_join.classified(docs.select(F.col("doc_id").alias("id"), "text")).filter("id IS NOT NULL").withColumnRenamed("id", "doc_id"))
    first = F.expr("head IS NULL OR (component_id = doc_id AND set = head)")
    again = stored(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    gone = stored(found.filter(~first).select("doc_id").distinct())
    if not again.limit(1).count():
        return attach(docs, gone, ["doc_id"], "left_anti", "doc_id")
    alone = attach(attach(docs, again, ["doc_id"], "left_anti", "doc_id"), gone, ["doc_id"], "left_anti", "doc_id")
    stay = stored(attach(found, again, ["doc_id"], "left_semi", "doc_id").filter(first).select("doc_id", "set").distinct())
    own = unused("set", docs)
    named = ngram_join.with_sets(attach(docs, again, ["doc_id"], "left_semi", "doc_id"), name=own)
    once = attach(named, stay.withColumnRenamed("set", own), ["doc_id", own], "left_semi", own).dropDuplicates(["doc_id", own]).drop(own)
    return alone.unionByName(once)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences."""
    return packing.packed(docs, queries.tokenizer())


STAGES = [
    ("toxicity", clean),
    ("language_id", in_a_language),
    ("ngram_jaccard_join", distinct),
    ("mixing", mix),
    ("packing", pack),
]

# A trained network and tokenizer decide what comes out, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
