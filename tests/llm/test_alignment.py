"""Alignment against plain cuts, its counts against brute force, and both libraries' ids."""

from __future__ import annotations

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from listingmart.llm import alignment, queries

LEFT, RIGHT = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")
TEXTS = [
    "Hello world, this is a test.", "  two  blanks\n\nand\ttabs ", "naïve café — 日本語 😀😀", "<|endoftext|> <s> </s>", "a▁b", "", None, "x", "Hello world, this is a test.",
    " ", "\n", "don't we'll I'VE 12345 1/2 ½ ١٢٣", "a" * 5000, " " * 2000 + "b", "日本" * 700, "\u0000�", "ab" * 3000,
]


def plain(a: list[int], b: list[int], sizes) -> list[tuple[list[int], list[int]]]:
    """Groups by the set of common ends."""

    def ends(ids, side):
        total, found = 0, []
        for i in ids:
            total += sizes[side][i]
            found.append(total)
        return found

    left, right = ends(a, 0), ends(b, 1)
    found, x, y = [], 0, 0
    for c in sorted(set(left) & set(right)):
        p, q = left.index(c, x) + 1, right.index(c, y) + 1
        found.append((a[x:p], b[y:q]))
        x, y = p, q
    return found


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text, by the libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    tool = alignment.aligner(LEFT, RIGHT)
    one = Tokenizer.from_file(LEFT)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=RIGHT)
    links, rows = [], []
    for text in texts:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if any(b"".join(s.bytes[i] for i in ids) != raw for s, ids in ((tool.left, a), (tool.right, b))):
            a = b = []
        cut = plain(a, b, tool.sizes)
        links.append(Counter(p for x, y in cut for p in ((i, j) for i in x for j in y)))
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in cut)
        rows.append((len(a), len(b), len(cut), links[-1].total(), hashlib.sha256(shown.encode()).hexdigest() if a else ""))
    held = Counter(p for x in links for p in x)
    most: dict[int, int] = {}
    for (i, _), n in held.items():
        most[i] = max(most.get(i, 0), n)
    return [(*r[:4], sum(t for p, t in x.items() if held[p] == most[p[0]]), sum(t * held[p] for p, t in x.items()), r[4]) for r, x in zip(rows, links, strict=True)]


def test_segments_are_the_common_cuts():
    rng = random.Random(5)
    for _ in range(2000):
        n = rng.randint(1, 60)
        share = rng.choice((0.2, 0.5, 0.9, 1))
        left, right = ([e for e in range(1, n) if rng.random() < share] + [n] for _ in range(2))
        cuts = []
        for i, j, p, q in alignment.segments(np.array(left), np.array(right)):
            if q:
                assert left[i + p - 1] == right[j + q - 1] and p + q > 2
                cuts.append(left[i + p - 1])
            else:
                assert left[i : i + p] == right[j : j + p]
                cuts += left[i : i + p]
        assert cuts == sorted(set(left) & set(right))


@pytest.mark.parametrize("most", [500_000, 200, 3, 0])
def test_counts_equal_brute_force(spark, most):
    docs = spark.createDataFrame([(i // 2 if i < 8 else None, t, "x", 7) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, row string, pair int")
    found = alignment.scored(docs, LEFT, RIGHT, most).collect()
    wanted = brute(TEXTS)
    assert sorted(tuple(r)[1:] for r in found) == sorted(wanted)
    assert sorted((r.doc_id for r in found), key=str) == sorted((i // 2 if i < 8 else None for i in range(len(TEXTS))), key=str)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents").collect()
    found = {r.doc_id: tuple(r)[1:] for r in queries.op11_alignment(spark, sf).collect()}
    assert found == dict(zip((d.doc_id for d in docs), brute([d.text for d in docs]), strict=True))


def test_groups_cover_the_text(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    rows = alignment.groups(docs, LEFT, RIGHT).orderBy("doc_id", "start").collect()
    tool = alignment.aligner(LEFT, RIGHT)
    for i, text in enumerate(TEXTS):
        own = [r for r in rows if r.doc_id == i]
        if text and "▁" not in text and own:
            raw = (" " + text).encode()
            assert [r.start for r in own] == [0, *(r.stop for r in own[:-1])] and own[-1].stop == len(raw)
            for r in own:
                assert raw[r.start : r.stop] == b"".join(tool.left.bytes[k] for k in r.left_ids) == b"".join(tool.right.bytes[k] for k in r.right_ids)
    assert {r.doc_id for r in rows} == {i for i, t in enumerate(TEXTS) if t and "▁" not in t}


def test_fast_and_slow_library_agree():
    from tokenizers import Tokenizer

    tool, plain_tool = alignment.aligner(LEFT, RIGHT).left, Tokenizer.from_file(LEFT)
    plain_tool.encode_special_tokens = True
    rng = random.Random(2)
    parts = [chr(i) for i in range(0x250)] + ["  ", "'s", "'ll", "<|endoftext|>", "\n\n", "abc", "The"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    assert tool.fast is not None and [x.tolist() for x in tool.encode(texts)] == [x.ids for x in plain_tool.encode_batch(texts, add_special_tokens=False)]


def test_empty_table(spark):
    assert alignment.scored(spark.createDataFrame([], "doc_id bigint, text string"), LEFT, RIGHT).count() == 0


def test_ids_of_odd_texts():
    import sentencepiece
    from tokenizers import Tokenizer

    tool, one = alignment.Aligner(LEFT, RIGHT), Tokenizer.from_file(LEFT)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=RIGHT)
    rng = random.Random(8)
    parts = [" ", " ", " ", "  ", "\n", "\t", " ", "a", "The", "é", "日", "😀", "'s", "1", "!", "<s>", "x" * 40, ",", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    for text, (a, b) in zip(texts, tool.tokens(texts), strict=True):
        if len(a):
            assert a.tolist() == one.encode(" " + text, add_special_tokens=False).ids and b.tolist() == two.encode(text)
    assert sum(len(a) > 0 for a, _ in tool.tokens(texts)) > 2000


def test_links_and_text_cost_little_beside_the_cuts():
    tool, rng = alignment.aligner(LEFT, RIGHT), np.random.default_rng(4)
    sizes = rng.integers(2, 7, 200_000)
    a, b = (np.empty(len(sizes), np.int64) for _ in range(2))
    for ids, own in zip((a, b), tool.sizes, strict=True):
        for s in range(2, 7):
            ids[sizes == s] = rng.choice(np.flatnonzero(own == s)[:900], (sizes == s).sum())

    def least(call) -> float:
        took = []
        for _ in range(9):
            begun = time.process_time()
            call()
            took.append(time.process_time() - begun)
        return min(took)

    groups, links, text, pairs, times = tool.align(a, b)
    assert groups == links == times.sum() == len(a) and text == ";".join(f"{x}|{y}" for x, y in zip(a.tolist(), b.tolist(), strict=True)).encode()
    assert set(pairs.tolist()) == set((a * tool.width + b).tolist())
    assert least(lambda: tool.align(a, b)) < 2.6 * least(lambda: alignment.segments(*tool.ends(a, b)))
