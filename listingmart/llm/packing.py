"""Packing token pieces into windows by Karmarkar-Karp multiway differencing.

Tokens are counted where the text lies: one pass over the texts emits a row per piece, and only these small rows are
shuffled. A document is cut at the window's capacity; one in ten is cut into small pieces, which fill what whole
documents leave. Pieces meet in groups of bounded size, dealt by row and not by any key, so equal documents do not gather. In a group, differencing starts from one partial partition
for each piece and merges, again and again, the two with the largest imbalance, the fullest window of one onto the
emptiest of the other, which leaves near-equal windows. If a window exceeds the capacity, the number of windows
rises by one and the group is partitioned again.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmart.llm import words
from listingmart.llm.common import in_batches, need

CAPACITY = 4096
END = 2
# Every so many documents one is cut into small pieces: they level the windows, which whole documents leave uneven.
FILLER_EVERY, FILLER = 10, 128
# Documents that are partitioned together, on average.
GROUP = 800
# Rows, and bytes of text, that are taken at a time.
SLICE, ENCODED = 500, 512 << 10
# Units whose ids a Python worker remembers (some 40 bytes each).
REMEMBERED = 600_000

# Classes of bytes: white space, letter, digit, other ASCII sign, beyond ASCII; then where to cut between two of them.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[128:] = 4
_CLASS[39] = 5  # apostrophe: never cut behind it
# The byte alphabet's signs for bytes 128 to 160 and 173; other bytes from 161 on stand for themselves.
_ALPHABET = {b: 290 + b - 128 for b in range(128, 161)} | {173: 323}
_CUT = np.zeros((6, 6), bool)
_CUT[[1, 1, 1, 2, 2, 2, 3, 3], [2, 3, 5, 1, 3, 5, 1, 2]] = True


def difference(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` near-equal windows, by multiway differencing."""
    if k == 1:
        return [list(range(len(sizes)))]
    # A partial partition: sums of its windows in descending order, less the smallest, and the items of each.
    # Only windows that differ from the emptiest are kept, so a single piece costs one entry, not k.
    heap: list[tuple[float, int, np.ndarray, list[list[int]]]] = []
    for i, size in enumerate(sizes.tolist()):
        heap.append((-size, i, np.array([size], np.int64), [[i]]))
    heapq.heapify(heap)
    empty = len(sizes)
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        free = k - len(a)
        # The fullest of b go to the emptiest of a: first to those without a sum of their own, then from the smallest up.
        over = len(b) - free
        if over <= 0:
            sums, items = np.concatenate((a, b)), left + right
        else:
            sums = np.concatenate((a, b[:free]))
            items = left + right[:free]
            for j in range(over):
                sums[len(a) - 1 - j] += b[free + j]
                items[len(a) - 1 - j] = items[len(a) - 1 - j] + right[free + j]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        items = [items[j] for j in order.tolist()]
        low = 0
        if len(sums) == k:
            low = int(sums[-1])
        heapq.heappush(heap, (-(int(sums[0]) - low), empty, sums, items))
        empty += 1
    items = heap[0][3]
    return items + [[] for _ in range(k - len(items))]


def windows(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Partition into as few near-equal windows as differencing finds room in."""
    if not len(sizes):
        return []
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = difference(sizes, k)
        if max(int(sizes[w].sum()) for w in found if w) <= capacity:
            return [w for w in found if w]
        k += 1


class Encoder:
    """Token ids of texts, each distinct unit encoded once.

    The tokenizer drops white space, lower-cases, and never joins letters, digits and other signs, so a text's ids are
    those of its units: runs of bytes cut at ASCII white space and between ASCII letters, digits and other ASCII signs.
    Not cut are bytes beyond ASCII from their neighbours, and what follows an apostrophe. A text that spells one of the
    special tokens is encoded as it stands. Units are looked up by a 64-bit hash.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(special) or b"(?!)")
        self.forget()

    def forget(self) -> None:
        # Hashes in ascending order, where their ids begin and how many they are: numbers in arrays take a fraction of a dict.
        self.known, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        """Ids of each unit. Lower-cased Latin letters need no rule but the byte alphabet, and go straight to the merges."""
        found: list[list[int]] = [[]] * len(texts)
        rest = []
        model = self.tokenizer.model
        for i, text in enumerate(texts):
            if text.isascii() and text.isalpha():
                found[i] = [x.id for x in model.tokenize(text.lower())]
            elif text.isalpha() and max(text) < "\u0180" and "\u0130" not in text:
                found[i] = [x.id for x in model.tokenize(text.lower().encode().decode("latin-1").translate(_ALPHABET))]
            else:
                rest.append(i)
        for i, x in zip(rest, self.tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = x.ids
        return found

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Remember the ids of units that are not known yet; their hashes ascend."""
        if not texts:
            return
        found = self.ids_of(texts)
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        starts = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        at = np.searchsorted(self.known, hashes) + np.arange(len(hashes))
        old = np.ones(len(self.known) + len(hashes), bool)
        old[at] = False
        for name, new in (("known", hashes), ("starts", starts), ("sizes", sizes)):
            merged = np.empty(len(old), new.dtype)
            merged[at], merged[old] = new, getattr(self, name)
            setattr(self, name, merged)
        self.used += total

    def encode(self, raws: list[bytes]) -> list[np.ndarray]:
        """Ids of each UTF-8 text."""
        if len(self.known) > REMEMBERED or self.used > 8 * REMEMBERED:
            self.forget()
        odd = {i: raw for i, raw in enumerate(raws) if self.special.search(raw)}
        buffer, begins, ends, hashes, offsets = words.units([b"" if i in odd else raw for i, raw in enumerate(raws)], _CLASS, _CUT)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)] != distinct
        self.learn(distinct[new], [buffer[begins[i] : ends[i]].decode("utf-8", "replace") for i in first[new].tolist()])
        at = np.searchsorted(self.known, distinct)[inverse]
        sizes = self.sizes[at]
        total = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(self.starts[at] - total[:-1], sizes) + np.arange(total[-1])]
        bounds = total[offsets].tolist()
        found = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i, raw in odd.items():
            found[i] = np.array(self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        return found


_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, row, start, length, ids_crc32, doc_tokens): every document's ids, with ``end`` after them, in pieces."""
    kind = docs.select("doc_id").schema.simpleString()[7:-1]
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = Encoder(tokenizer)
        encoder, seen = _ENCODERS[tokenizer], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = []
                for first, raws in words.batches(part.column("text").to_pylist(), ENCODED):
                    for i, found in enumerate(encoder.encode(raws), first):
                        ids = found.astype("<u4").tobytes() + last
                        seen += 1
                        n = len(ids) // 4
                        whole = n - n % capacity
                        step = FILLER if seen % FILLER_EVERY == 0 else capacity
                        for start in [*range(0, whole, capacity), *range(whole, n, step)]:
                            stop = min(start + (capacity if start < whole else step), n)
                            rows.append((i, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), n))
                of, *numbers = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(of), part.column("row").take(of), *numbers],
                    ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"],
                )

    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return in_batches(numbered, run, f"{kind}, row bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their sequence_id and offset; sequences hold at most ``capacity`` ids.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur, null ids are kept. Other
    columns are left out. An empty table gives no piece.
    """
    need(docs, "doc_id", "text")
    cut = pieces(docs, tokenizer, capacity, end)
    groups = max(1, -(-docs.count() // GROUP))
    kind = docs.select("doc_id").schema.simpleString()[7:-1]

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "start"], kind="stable", ignore_index=True)
        sizes = frame["length"].to_numpy()
        full, rest = np.flatnonzero(sizes == capacity), np.flatnonzero(sizes < capacity)
        found = [[i] for i in full.tolist()] + [rest[w].tolist() for w in windows(sizes[rest], capacity)]
        order = np.array([i for w in found for i in w])
        local = np.repeat(np.arange(len(found)), [len(w) for w in found])
        ends = np.cumsum(sizes[order])
        first = np.concatenate(([True], np.diff(local) > 0))
        begins = ends - sizes[order]
        out = frame.iloc[order].drop(columns=["row", "pack"]).reset_index(drop=True)
        out["sequence_id"] = int(frame["pack"].iloc[0]) * 2**32 + local
        out["offset"] = begins - begins[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        return out

    dealt = cut.withColumn("pack", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("bigint"))
    schema = f"{kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return dealt.groupBy("pack").applyInPandas(pack, schema)
