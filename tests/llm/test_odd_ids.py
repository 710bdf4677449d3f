"""Near copies among rows whose id is null or repeats."""

from __future__ import annotations

import corpus_pipeline
from listingmart.llm import ngram_join
from tests.llm.test_operators import docs


def run_of(first: int, n: int = 100, word: str = "w") -> str:
    return " ".join(f"{word}{i}" for i in range(first, first + n))


def test_a_text_without_an_id_links_others(spark):
    rows = [(1, run_of(0)), (None, run_of(8)), (3, run_of(16)), (4, run_of(0, word="x")), (None, run_of(0, word="y")), (None, run_of(8, word="y"))]
    found = ngram_join.similar(spark.createDataFrame(rows, "id bigint, text string")).collect()
    assert len(found) == len(rows) and {(r.id, r.component_id) for r in found} == {(1, 1), (3, 1), (4, 4), (None, None)}


def test_rows_that_repeat_an_id_are_judged_by_their_texts(spark):
    rows = [
        (1, run_of(0)),
        (5, run_of(8)),  # near copy of 1
        (5, run_of(0, word="x")),  # nobody's copy, of an id that has one
        (5, run_of(0, word="x") + " "),  # the same shingles once more
        (6, run_of(4, word="x")),  # near copy of 5
        (7, run_of(0, word="y")),  # two near copies with the same id
        (7, run_of(4, word="y")),
        (8, None),
        (8, ""),
        (None, run_of(0)),
        (9, run_of(0, word="z")),
    ]
    kept = corpus_pipeline.distinct(spark, docs(spark, [(i, t, "en", "s") for i, t in rows]), "")
    assert kept.columns == docs(spark, []).columns
    found = sorted((r.doc_id or 0, (r.text or "").split(" ")[0][:1]) for r in kept.collect())
    assert found == [(0, "w"), (1, "w"), (5, "x"), (7, "y"), (8, ""), (9, "z")]
