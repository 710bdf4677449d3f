"""Held-out rows and bounded samples of labelled rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listingmart.llm.common import attach, stored


def held_out(doc_id: Column) -> Column:
    """True for the quarter of rows that no model may learn from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


# A frequent label is ranked among about twice the rows it may give, and so many more that it hardly ever gives too few.
SPARE = 200


def labelled(docs: DataFrame, labels: DataFrame, per_label: int | None, most: int, least: int = 1) -> pa.Table:
    """(text, label) of the rows that `drawn` takes, in their order."""
    rows = drawn(docs, labels, per_label, most, least)
    return rows.select("text", "label", "order").toArrow().sort_by("order").select(["text", "label"])


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """Rows with their ``number`` from 0 on in an order that is total. The driver gets one count per partition."""
    ordered = stored(rows.orderBy(*by).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).cast("int")
    before, total = [F.lit(-1), F.lit(0).cast("long")], 0
    for r in ordered.groupBy(part.alias("part")).count().orderBy("part").collect():
        before += [F.lit(r.part), F.lit(total).cast("long")]
        total += r["count"]
    return ordered.withColumn("number", F.create_map(*before)[part] + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at")


def placed(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, text, label, place) of all documents with a text that may be learned from, or of ``most``; ``place`` numbers them.

    As in `drawn` the order is a hash of the id, and an id that repeats counts once, with its largest label and least text.
    """
    known = labels.filter(F.col("label").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.withColumn("order", F.xxhash64("doc_id"))
    if most is not None:
        known = known.orderBy("order", "doc_id").limit(most)
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    known = known.join(texts.groupBy("doc_id").agg(F.count("*").alias("copies")), "doc_id")
    chosen = stored(numbered(known, "order", "doc_id").select("doc_id", "label", F.col("number").alias("place"), "copies"))
    found = attach(texts, chosen, ["doc_id"], "inner", "text")
    # Only texts of ids that repeat have to meet.
    alone = found.filter("copies = 1").select("doc_id", "label", "place", "text")
    return alone.unionByName(found.filter("copies > 1").groupBy("doc_id", "label", "place").agg(F.min("text").alias("text")))


def drawn(docs: DataFrame, labels: DataFrame, per_label: int | None, most: int, least: int = 1) -> DataFrame:
    """(doc_id, text, label, order) of at most ``most`` documents that may be learned from, and at most ``per_label`` of each label.

    ``labels`` is (doc_id, label). Documents are taken in the order of a hash of their id: ids first, then the whole
    texts of those. An id that repeats counts once, with its largest label. With ``per_label`` the labels fill up evenly,
    so a rare one keeps all it has while a frequent one is cut; ``least`` documents of each are taken even beyond ``most``.
    A label's rows are thinned by the hash to about twice ``per_label`` before they are ranked, so that no task ranks
    more, however frequent a label is.
    """
    known = labels.filter(F.col("label").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.withColumn("order", F.xxhash64("doc_id"))
    if per_label is None:
        first = known.orderBy("order", "doc_id").limit(most)
    else:
        known = stored(known)
        share = stored(known.groupBy("label").agg((F.lit(2.0 * per_label + SPARE) / F.count("*")).alias("share")))
        known = attach(known, share, ["label"], "inner", "doc_id").filter("share >= 1 OR order < share * 18446744073709551616D - 9223372036854775808D")
        known = known.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("order", "doc_id"))).filter(F.col("nth") <= per_label)
        known = stored(known.select("doc_id", "label", "order", "nth"))
        first = known.orderBy("nth", "order", "doc_id").limit(max(most, known.filter(F.col("nth") <= least).count()))
    chosen = stored(first.select("doc_id", "label", "order"))
    found = attach(docs.select("doc_id", "text").filter(F.col("text").isNotNull()), chosen, ["doc_id"], "inner", "doc_id")
    once = found.groupBy("doc_id", "label", "order").agg(F.min("text").alias("text"))
    return once.select("doc_id", "text", "label", "order")
