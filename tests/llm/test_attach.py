"""Joins with a table that is too large for the driver."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from listingmart.llm import common


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_table_that_is_not_proven_small_is_never_broadcast(spark, monkeypatch, how):
    big = spark.sql("SELECT id % 7 AS k, id AS v FROM range(40) UNION ALL SELECT NULL, 40")
    small = common.stored(spark.sql("SELECT id AS k, id * 2 AS w FROM range(5)"))
    expected = sorted(map(tuple, common.attach(big, small, ["k"], how, "v").select("v").collect()))
    monkeypatch.setattr(common, "is_small", lambda table: False)
    found = common.attach(big, small, ["k"], how, "v")
    rows = sorted(map(tuple, found.select("v").collect()))
    plan = plan_of(found.select("v"))
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert rows == expected and len(rows) == {"inner": 30, "left": 41, "left_semi": 30, "left_anti": 11}[how]


def test_the_driver_does_not_hold_the_labels(spark, monkeypatch):
    """Labels meet the documents' languages by shuffle, whatever their files' size."""
    from listingmart.llm import samples, toxicity

    class Seen(Exception):
        pass

    def seen(docs, known, most):
        raise Seen(plan_of(known), sorted(map(tuple, known.select("doc_id", "label.toxic", "label.lang").collect())))

    monkeypatch.setattr(samples, "placed", seen)
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "c", None), (2, "d", "fr"), (None, "e", "en")], "doc_id long, text string, lang string")
    labels = common.stored(spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1), (1, 5)], "doc_id long, toxic int"))
    with pytest.raises(Seen) as found:
        toxicity.model(docs, labels)
    plan, rows = found.value.args
    assert "Broadcast" not in plan
    assert rows == [(1, 1, "en"), (2, 0, "fr")]


def test_near_copies_broadcast_no_table_that_is_not_proven_small(spark, monkeypatch):
    """Labels and pairs of many near copies stay off the driver, and the result is the same without any small table."""
    from listingmart.llm import ngram_join

    docs = spark.sql("SELECT id, concat_ws(' ', transform(sequence(1, 40), x -> concat('w', id div 2, '_', x)), if(id % 2 = 0, 'q', 'r')) AS text FROM range(24)")
    links = common.stored(spark.sql("SELECT id AS a, id + 1 AS b FROM range(9) WHERE id <> 4"))
    expected = sorted(map(tuple, ngram_join.similar(docs).collect()))
    labels = sorted(map(tuple, ngram_join.components(links).collect()))
    assert [r[2] for r in expected] == [2 * (i // 2) for i in range(24)] and labels == [(i, 0 if i < 5 else 5) for i in range(10)]
    plans = []

    def seen(df, keep=common.stored):
        plans.append(plan_of(df))
        return keep(df)

    monkeypatch.setattr(common, "is_small", lambda table: False)
    assert sorted(map(tuple, ngram_join.similar(docs).collect())) == expected
    monkeypatch.setattr(ngram_join, "stored", seen)
    assert sorted(map(tuple, ngram_join.components(links).collect())) == labels
    assert not [p for p in plans if "set" in p and "FileScan" in p and "BroadcastHashJoin" in p]


def test_the_most_repeated_shingles_are_chosen_off_the_driver(spark, monkeypatch):
    from listingmart.llm import ngram_join

    plans = []

    def seen(df, keep=common.stored):
        plans.append(plan_of(df))
        return keep(df)

    monkeypatch.setattr(ngram_join, "stored", seen)
    monkeypatch.setattr(ngram_join, "HEAVY", 3)
    described = spark.sql("SELECT if(id = 0, NULL, id * 10) AS token, if(id = 0, 99L, 14 + id) AS n FROM range(9) UNION ALL SELECT 20L, 100L")
    token, level = ngram_join.heaviest(described)
    assert token.tolist() == [20, 70, 80] and level.tolist() == [6, 4, 4]
    assert len(plans) == 1 and "TakeOrderedAndProject" in plans[0]
