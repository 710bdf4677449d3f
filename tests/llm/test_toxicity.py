"""Toxicity learned from every labelled row, against the same in memory."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from listingmart.llm import samples, toxicity
from tests.llm.test_operators import docs


def labelled(n, seed=1):
    """Rows with near and exact copies, texts without words and several languages."""
    rng = random.Random(seed)
    plain, vile = [f"w{i}" for i in range(300)], ["scum", "vile", "filth"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        text = " ".join(rng.choice(plain) for _ in range(rng.randint(1, 30)))
        text += " " + rng.choice(vile) if toxic and i % 5 else ""
        if i % 11 == 3:
            text = (rows[-2][1] or "w1") + (" again" if i % 2 else "")
        rows.append((i, None if i % 97 == 9 else "" if i % 89 == 9 else text, ["en", "de", "fr", None][i % 4], "s"))
        labels.append((i, int(toxic)))
    return rows, labels


def in_memory(spark, rows, labels):
    """The rows that may be learned from in order of the hash, and what `fit` makes of them."""
    order = spark.range(len(rows)).filter(~samples.held_out(F.col("id"))).orderBy(F.xxhash64("id")).toPandas()["id"].tolist()
    used = [i for i in order if rows[i][1] is not None]
    return toxicity.fit([rows[i][1] for i in used], np.array([labels[i][1] for i in used]), [rows[i][2] for i in used])


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = labelled(1500)
    return rows, labels, toxicity.model(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_one_block_equals_the_fit_in_memory(spark, fitted):
    rows, labels, found = fitted
    plain = in_memory(spark, rows, labels)
    assert np.array_equal(found.table, plain.table) and np.array_equal(found.weights, plain.weights)
    assert found.bias == plain.bias and found.thresholds == plain.thresholds and set(found.thresholds) == {None, "en", "de", "fr"}


def test_blocks_are_averaged(spark, fitted, monkeypatch):
    rows, labels, one = fitted
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 50)
    found = toxicity.model(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert not np.array_equal(found.weights, one.weights)
    score = toxicity.scores(found, ["w1 w2 scum", "w1 w2 w3"])
    assert score[0] > 2 * score[1]


def test_words_beyond_the_first_ten_thousand_rows_are_learned(spark):
    order = [r.id for r in spark.range(16_000).filter(~samples.held_out(F.col("id"))).orderBy(F.xxhash64("id")).collect()]
    assert len(order) > 11_000
    late = set(order[10_000:])
    rng = random.Random(2)
    rows = []
    for i in range(16_000):
        bad = "" if i % 3 else "scum" if i in late else "filth"
        rows.append((i, " ".join([*(rng.choice("abcdefghijklmnop") + str(rng.randint(0, 99)) for _ in range(12)), bad]), "en", "s"))
    net = toxicity.model(docs(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(16_000)], "doc_id long, toxic int"))
    ids = toxicity.tokens([b"scum filth a1"])[0]
    assert (net.table[ids[:2], 0] > 0.5).all() and net.table[ids[2], 0] < 0.5


def test_copies_are_found_as_in_memory(spark):
    rows, _ = labelled(400, 5)
    texts = [t for _, t, _, _ in rows if t is not None]
    ids, bounds = toxicity.joined(texts)
    own = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    table = spark.createDataFrame([(i, len(x), x.tolist()) for i, x in enumerate(own)], "place long, n long, words array<int>")
    assert sorted(r.place for r in toxicity.first_of_copies(table).collect()) == toxicity.without_copies(own)


def test_one_label_alone_gives_its_share(spark):
    rows, labels = labelled(40)
    for toxic, share in ((0, 0.01), (1, 0.99)):
        net = toxicity.model(docs(spark, rows), spark.createDataFrame([(i, toxic) for i, _ in labels], "doc_id long, toxic int"))
        assert toxicity.scores(net, ["scum"])[0] == pytest.approx(share)
