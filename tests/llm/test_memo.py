"""What a Python worker remembers of the tokenizer's ids: small, and right whatever the order it was met in."""

from __future__ import annotations

import tracemalloc

from listingmart.llm import packing, queries


def test_remembered_units_are_small_and_right():
    from tokenizers import Tokenizer

    path = queries.tokenizer()
    made, plain = packing.Encoder(path), Tokenizer.from_file(path)
    starts = [a + b for a in ("b", "ch", "d", "f", "g", "sch", "tr") for b in ("ala", "ebo", "iku", "ono", "uta", "yri")]
    texts = [" ".join(f"{start}{c}{d}{e}" for c in "aeiou" for d in "klmnprst" for e in "bdfgw") + " Élan" for start in starts] * 2
    tracemalloc.start()
    sizes = [len(made.encode([t.encode()])[0]) for t in texts]
    used = tracemalloc.get_traced_memory()[0] - made.flat.nbytes
    tracemalloc.stop()
    assert len(starts) * 200 < made.known.size < len(starts) * 200 + 10
    assert used < 60 * made.known.size
    for t, n in zip(texts, sizes, strict=True):
        assert made.encode([t.encode()])[0].tolist() == plain.encode(t, add_special_tokens=False).ids and n > 200


def test_forgotten_units_are_learned_again(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    made = packing.Encoder(queries.tokenizer())
    first = [made.encode([b"one two three four five", b""]) for _ in range(3)]
    assert all([x.tolist() for x in found] == [x.tolist() for x in first[0]] for found in first)
    assert made.encode([b"four six"])[0][0] == first[0][0][3] and len(made.known) == 2
