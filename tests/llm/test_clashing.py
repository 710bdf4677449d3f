"""Tables whose other columns are called like what the operators make: every value comes out as it went in."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from listingmart.llm import chat, common, langid, mixing, toxicity

NAMES = ("size", "copies", "source_size", "target", "set", "head", "label", "row", "pack", "_salt", "_copy", "_source", "_own_size", "order", "nth", "n", "id", "component_id", "token", "score", "held_out")


@pytest.fixture(params=[True, False], ids=["broadcast", "shuffled"])
def branch(request, monkeypatch):
    if not request.param:
        monkeypatch.setattr(common, "is_small", lambda *a, **k: False)


def odd(spark):
    texts = ["one two three four five six seven", "one two three four five six seven", "das Haus und der Hund", "", None, "a b c d e f", "one TWO three four five six seven"]
    rows = [(i if i < 5 else 2, t, ("en", "de", None)[i % 3], ("a", None, "b")[i % 3]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return docs.select("*", *(F.concat_ws("-", F.lit(n), "doc_id", "text").alias(n) for n in NAMES))


def values(df):
    return [tuple(r) for r in df.collect()]


def test_mix_keeps_the_tables_columns(spark, branch):
    docs = odd(spark)
    found = mixing.repeated(docs)
    assert found.columns == docs.columns and set(values(found)) <= set(values(docs))
    rows = {(r.doc_id, r.text): r for r in mixing.mixed(docs).collect()}
    assert len(rows) == 7 and all(r["_salt"].startswith("_salt-") and r["_source"].startswith("_source-") for r in rows.values())
    copies = {k: r.copies for k, r in rows.items()}
    assert sum(copies.values()) == found.count()


def test_near_copies_keep_the_tables_columns(spark, branch):
    docs = odd(spark)
    found = corpus_pipeline.distinct(spark, docs, "")
    assert found.columns == docs.columns and set(values(found)) <= set(values(docs))
    # 0, 1 and the repeated 2 hold the same words; 2 also names a text of its own.
    assert sorted((r.doc_id, (r.text or "")[:3]) for r in found.collect()) == [(0, "one"), (2, "a b"), (2, "das"), (3, ""), (4, "")]


def test_filters_keep_the_tables_columns(spark):
    docs = odd(spark)
    net = toxicity.fit([], toxicity.np.zeros(0, toxicity.np.int64), [])
    speaks = langid.fit(["the house and the dog", "das haus und der hund"] * 20, ["en", "de"] * 20)
    for found in (toxicity.kept(docs, net), langid.kept(docs, speaks)):
        assert found.columns == docs.columns and set(values(found)) <= set(values(docs))
    assert len(values(toxicity.kept(docs, net))) == 7


def test_unknown_records_make_no_turn(spark):
    records = spark.createDataFrame([(1, '{"x":1}'), (2, '{"prompt":"p","response":""}'), (3, None)], "k bigint, rec string")
    turns = chat.from_json(records, "k", "rec")
    assert sorted(r.conv_id for r in chat.formatted(turns).collect()) == [2, 2]
    assert sorted(r.conv_id for r in chat.rejected(turns).collect()) == [1, 3]


def test_thresholds_of_small_languages():
    import numpy as np

    rng = np.random.default_rng(0)
    toxic = rng.integers(0, 2, 400)
    score = np.where(toxic == 1, 0.7, 0.55) + rng.uniform(-0.05, 0.05, 400)
    langs = ["en"] * 395 + ["de"] * 4 + [None]
    found = toxicity.calibrated(score, toxic, langs)
    assert set(found) == {None, "en", "de"} and all(0.6 <= t <= 0.65 for t in found.values())
    # Many rows of its own outweigh the common threshold.
    own = np.where(toxic == 1, 0.3, 0.1)
    both = toxicity.calibrated(np.concatenate((score, own)), np.concatenate((toxic, toxic)), langs + ["fr"] * 400)
    assert both["fr"] <= 0.3 and both["en"] >= 0.6
    assert toxicity.calibrated(np.zeros(0), np.zeros(0, np.int64), []) == {None: toxicity.THRESHOLD}
