"""Samples of labelled rows: rare labels."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from listingmart.llm import langid, samples, toxicity
from tests.llm.test_operators import docs


def rare_language(spark):
    rng = random.Random(3)
    words = {"en": "the house and dog with that this", "fr": "les maison avec chien dans cette", "xx": "kwa nyumba mbwa hii yake sana"}
    rows = []
    for i in range(3000):
        lang = "xx" if i % 197 == 5 else "fr" if i % 4 == 0 else "en"
        rows.append((i, " ".join(rng.choice(words[lang].split()) for _ in range(12)), lang, "s"))
    return docs(spark, rows)


def test_a_rare_label_is_not_cut_for_frequent_ones(spark):
    table = rare_language(spark)
    labels = table.selectExpr("doc_id", "lang AS label")
    free = labels.filter(~samples.held_out(labels["doc_id"]) & (labels["label"] == "xx")).count()
    assert free > 5
    found = Counter(samples.labelled(table, labels, 50, 60).column("label").to_pylist())
    assert found["xx"] == free and sum(found.values()) == 60 and abs(found["en"] - found["fr"]) <= 1
    # A total that the labels do not fit in takes so many of each all the same.
    found = Counter(samples.labelled(table, labels, 50, 2, 4).column("label").to_pylist())
    assert found == {"en": 4, "fr": 4, "xx": 4}


def test_a_rare_language_is_predicted(spark):
    table = rare_language(spark)
    fitted = langid.model(table, 50, 60)
    own = langid.identified(table, fitted).join(table.select("doc_id", "lang"), "doc_id").filter("held_out AND lang = 'xx'")
    assert own.count() and own.filter("lang_pred <> lang").count() == 0


def test_a_text_beyond_the_bound_on_words_is_not_learned_from(spark):
    rows = [(i, ("vile scum " if i % 2 else "kind words ") + f"number {i}", "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(401)], "doc_id long, toxic int")
    plain = toxicity.model(docs(spark, rows), labels, words_at_most=1 << 14)
    long = docs(spark, [*rows, (400, "kind words " * 1000, "en", "s")])
    found = toxicity.model(long, labels, words_at_most=1 << 14)
    assert np.array_equal(plain.table, found.table) and plain.thresholds == found.thresholds
    # Rows in order of the hash are used until their words are.
    assert not np.array_equal(plain.table, toxicity.model(docs(spark, rows), labels, words_at_most=400).table)
