"""Cross-tokenizer alignment by diagonal run skipping.

A document is encoded twice. Where a token of the one and a token of the other end at the same byte, the text is cut; what
lies between two cuts is a group, and every token of a group is linked with every token of the other side in it. Most
groups are one-to-one, and inside a stretch of those the two arrays of token ends are equal at a constant index shift.
So the walk compares blocks of the arrays at the current shift, doubles the block while they are equal, halves it to find
where they part, resolves the irregular group there token by token, and goes on with the new shift.

Links are then weighed by the number of documents that hold them. One pass encodes and aligns; it stores each document's
distinct pairs of ids with their number. Pairs are counted with partial sums before the shuffle. The counts come back to
the documents in two ways that give the same sums: pairs that many documents hold, of which there are at most
`BROADCAST_ROWS`, by broadcast; the rest, none of which can be a hot key, by a shuffled join.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listingmart.llm.common import BROADCAST_ROWS, need, stored

BATCH_CHARS = 1 << 20
# Links that a group lists; longer groups count their distinct ids.
LISTED = 256
# Beyond Latin letters two libraries may know different versions of Unicode, and very long white space is too deep for the
# faster one's expressions; such texts go to the file's own library.
_SLOW = re.compile("[^\0-ɏ]|\\s{1000}")

_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Sign to byte of byte-level vocabularies: printable Latin-1 bytes are themselves, the rest follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Ids of a byte-level BPE vocabulary file, and the bytes of each id. Special tokens in a text are plain text.

    Ids that are numbered by merge order let a faster library do the same merges for texts in Latin script.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.slow, self.fast = path, None, None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        signs = byte_alphabet()
        known = {i: bytes(map(signs.__getitem__, t)) for t, i in model["vocab"].items() if all(c in signs for c in t)}
        self.bytes = [known.get(i, b"") for i in range(max(model["vocab"].values()) + 1)]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        if [model["vocab"][m] for m in merged] == list(range(256, 256 + len(merged))):
            import tiktoken

            ranks = {t: i for i, t in known.items() if i < 256 + len(merged)}
            self.fast = tiktoken.Encoding(path, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        slow = [i for i, t in enumerate(texts) if self.fast is None or _SLOW.search(t)]
        found = [np.zeros(0, np.int64)] * len(texts)
        if slow:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
                self.slow.encode_special_tokens = True
            for i, x in zip(slow, self.slow.encode_batch([texts[i] for i in slow], add_special_tokens=False), strict=True):
                found[i] = np.array(x.ids, np.int64)
        if len(slow) < len(texts):
            left = set(slow)
            for i, t in enumerate(texts):
                if i not in left:
                    found[i] = self.fast.encode_to_numpy(t, disallowed_special=()).astype(np.int64)
        return found


class Pieces:
    """Ids of a piece vocabulary with byte fallback, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


def segments(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(i, j, n, m): from tokens i and j on, n one-to-one groups if m is 0, else one group of n and m tokens.

    ``left`` and ``right`` are where the tokens end (64-bit, ascending), with the same last end. Blocks of the two arrays
    are compared as bytes.
    """
    found = []
    one, other = left.tobytes(), right.tobytes()
    ends, others = left.tolist(), right.tolist()
    i, shift, n = 0, 0, len(ends)
    while i < n:
        at, step, off = 8 * i, 16, 8 * shift
        while one[at : at + step] == other[at + off : at + off + step]:
            at += step
            if at >= 8 * n:
                break
            step *= 2
        else:
            while step > 8:
                step >>= 1
                if one[at : at + step] == other[at + off : at + off + step]:
                    at += step
        x = min(at >> 3, n)
        if x > i:
            found.append((i, i + shift, x - i, 0))
        if x >= n:
            break
        i, y = x, x + shift
        j = y
        a, b = ends[x], others[y]
        while a != b:
            if a < b:
                x += 1
                a = ends[x]
            else:
                y += 1
                b = others[y]
        found.append((i, j, x + 1 - i, y + 1 - j))
        i, shift = x + 1, y - x
    return found


def spread(segments: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens on the left and on the right of every group, from the segments of a document."""
    found = np.fromiter(chain.from_iterable(segments), np.int64, 4 * len(segments)).reshape(-1, 4)
    n, m = found[:, 2], found[:, 3]
    run = m == 0
    times = np.where(run, n, 1)
    return np.repeat(np.where(run, 1, n), times), np.repeat(np.where(run, 1, m), times)


def decimals(n: int) -> np.ndarray:
    """The digits of each number below ``n``, as eight bytes with zeros behind; the last one stays free for a sign."""
    if n > 10**7:
        raise ValueError("Ids have more than seven digits.")
    return np.array([b"%d" % i for i in range(n)], "S8").view("<u8")


class Aligner:
    """Both vocabularies, with what a Python worker keeps of them."""

    def __init__(self, left: str, right: str) -> None:
        self.left, self.right = ByteLevel(left), Pieces(right)
        self.sizes = [np.array([len(x) for x in side.bytes], np.int64) for side in (self.left, self.right)]
        self.width = len(self.right.bytes)
        self.digits = [decimals(len(side.bytes)) for side in (self.left, self.right)]

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids on both sides; none where the text is empty or either side does not give back its bytes.

        The left vocabulary only cuts bytes and joins them again, so its length tells; the right one may change signs.
        """
        used = [t for t in texts if t]
        pairs = iter(zip(used, self.left.encode([" " + t for t in used]), self.right.encode(used) if used else [], strict=True))
        none = np.zeros(0, np.int64)
        found = []
        for text in texts:
            ids = none, none
            if text:
                text, a, b = next(pairs)
                raw = b" " + text.encode()
                if len(raw) == int(self.sizes[0][a].sum()) and raw == b"".join(map(self.right.bytes.__getitem__, b.tolist())):
                    ids = a, b
            found.append(ids)
        return found

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.sizes[0][a].cumsum(), self.sizes[1][b].cumsum()

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[int, int, bytes, np.ndarray, np.ndarray]:
        """Groups, links, the groups as text, and the distinct pairs (left id * right vocabulary + right id) with their number."""
        one, other = spread(segments(*self.ends(a, b)))
        ends, others = one.cumsum(), other.cumsum()
        links = one * other
        # Most groups are one-to-one; of the others, short ones list their links.
        single, short = links == 1, (links > 1) & (links <= LISTED)
        x, y, m, held = (ends - one)[short], (others - other)[short], other[short], links[short]
        k = np.arange(held.sum()) - np.repeat(held.cumsum() - held, held)
        i, j = np.divmod(k, np.repeat(m, held))
        scaled = a * self.width
        codes = [scaled[ends[single] - 1] + b[others[single] - 1], scaled[np.repeat(x, held) + i] + b[np.repeat(y, held) + j]]
        pairs, times = np.unique(np.concatenate(codes), return_counts=True)
        wide: list[tuple[np.ndarray, np.ndarray]] = []
        for g in np.flatnonzero(links > LISTED).tolist():  # a long group repeats few ids: multiply their numbers instead of listing its links
            (x, p), (y, q) = (np.unique(ids[end - size : end], return_counts=True) for ids, end, size in ((a, ends[g], one[g]), (b, others[g], other[g])))
            wide.append(((x[:, None] * self.width + y).ravel(), (p[:, None] * q).ravel()))
        if wide:
            pairs, place = np.unique(np.concatenate([pairs, *(c for c, _ in wide)]), return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, place, np.concatenate([times, *(t for _, t in wide)]))
            times = total
        return len(one), int(links.sum()), self.text(a, b, one, other), pairs, times

    def text(self, a: np.ndarray, b: np.ndarray, one: np.ndarray, other: np.ndarray) -> bytes:
        """`a1,a2|b1;a3|b2,b3`: the ids of each group, of which `one` and `other` tell the sizes.

        Every id is eight bytes, its digits and at the end the sign behind it; without the zeros between they are the text.
        """
        out = np.empty(len(a) + len(b), "<u8")
        for ids, digits, own, before, sign in ((a, self.digits[0], one, other.cumsum() - other, b"|"), (b, self.digits[1], other, one.cumsum(), b";")):
            signs = np.full(len(ids), ord(",") << 56, "<u8")
            signs[own.cumsum() - 1] = ord(sign) << 56
            out[np.arange(len(ids)) + np.repeat(before, own)] = digits[ids] | signs
        return out.tobytes().translate(None, b"\0")[:-1]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(left: str, right: str) -> Aligner:
    if (left, right) not in _ALIGNERS:
        _ALIGNERS[left, right] = Aligner(left, right)
    return _ALIGNERS[left, right]


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch (its last column is the text) of about `BATCH_CHARS`; a longer text makes one alone."""
    texts = batch.column(batch.num_columns - 1).to_pylist()
    first, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if i > first and held + size > BATCH_CHARS:
            yield batch.slice(first, i - first), texts[first:i]
            first, held = i, 0
        held += size
    if first < len(texts):
        yield batch.slice(first), texts[first:]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else [], kind))


def groups(docs: DataFrame, left: str, right: str) -> DataFrame:
    """(doc_id, start, stop, left_ids, right_ids): every group of every document, with the bytes of space+text it covers.

    Documents without tokens (see `aligned`) have no group.
    """
    need(docs, "doc_id", "text")
    ids = docs.select("doc_id").schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(left, right)
        for batch in batches:
            for part, texts in slices(batch):
                for k, (a, b) in enumerate(tool.tokens(texts)):
                    ends = tool.ends(a, b)[0].tolist()
                    rows = []
                    for i, j, n, m in segments(*tool.ends(a, b)):
                        rows += [(i, j, n, m)] if m else [(i + t, j + t, 1, 1) for t in range(n)]
                    if not rows:
                        continue
                    starts = [ends[i - 1] if i else 0 for i, _, _, _ in rows]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array([k] * len(rows))), pa.array(starts, pa.int64()), pa.array([ends[i + n - 1] for i, _, n, _ in rows], pa.int64()),
                            pa.array([a[i : i + n] for i, _, n, _ in rows], pa.list_(pa.int32())), pa.array([b[j : j + m] for _, j, _, m in rows], pa.list_(pa.int32())),
                        ],
                        ["doc_id", "start", "stop", "left_ids", "right_ids"],
                    )

    return docs.select("doc_id", "text").mapInArrow(run, f"{ids}, start bigint, stop bigint, left_ids array<int>, right_ids array<int>")


def aligned(docs: DataFrame, left: str, right: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row.

    A text that is null or empty, or that either vocabulary does not give back byte by byte, has no tokens: all numbers
    are 0, the digest is ''. A pair is left id * size of the right vocabulary + right id; ``times`` says how many links of
    the document it is. Repeated rows count as documents of their own.
    """
    need(docs, "doc_id", "text")
    ids = docs.select("doc_id").schema.simpleString()[7:-1]
    narrow = len(aligner(left, right).left.bytes) * aligner(left, right).width < 2**31
    code, kind = ("int", pa.int32()) if narrow else ("bigint", pa.int64())

    def of(tool: Aligner, texts: list[str | None]) -> list[pa.Array]:
        counts, digests, pairs, times = [], [], [], []
        for a, b in tool.tokens(texts):
            n_groups, n_links, shown, codes, number = tool.align(a, b) if len(a) else (0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64))
            counts.append((len(a), len(b), n_groups, n_links))
            digests.append(hashlib.sha256(shown).hexdigest() if len(a) else "")
            pairs.append(codes)
            times.append(number)
        numbers = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)]
        return [*numbers, pa.array(digests, pa.string()), _lists(pairs, kind), _lists(times, pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(left, right)
        for batch in batches:
            for part, texts in slices(batch):
                # Millions of small lists and tuples, none in a cycle: the search for cycles only costs time.
                gc.disable()
                try:
                    columns = of(tool, texts)
                finally:
                    gc.enable()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *columns],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(run, f"row bigint, {ids}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<{code}>, times array<bigint>")


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """(pair, count, best): documents that hold each pair, and whether no pair of the same left id has more.

    The window holds the pairs of one left id, at most as many as the right vocabulary has ids.
    """
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    of_left = Window.partitionBy(F.floor(F.col("pair") / F.lit(width)))
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_left))


def often(counts: DataFrame, most: int = BROADCAST_ROWS) -> int:
    """The least power of two that at most ``most`` pairs reach with their number of documents."""
    bits = {r.bits: r.n for r in counts.groupBy(F.length(F.bin("count")).alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()}
    held, level = 0, 64
    while level > 1 and held + bits.get(level - 1, 0) <= most:
        level -= 1
        held += bits.get(level, 0)
    return 2 ** (level - 1)


def scored(docs: DataFrame, left: str, right: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs`` (doc_id, text).

    count_sum adds over the document's links the number of documents that hold the pair; n_best counts the links whose
    number is the highest of their left id. Null ids and repeated rows stay; other columns are left out.
    """
    found = stored(aligned(docs, left, right))
    counts = stored(pair_counts(found, aligner(left, right).width))
    level = often(counts, most)
    hot, rest = F.broadcast(counts.filter(F.col("count") >= level)), counts.filter(F.col("count") < level)
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    weighed = links.join(hot, "pair")
    if level > 1:
        weighed = weighed.unionByName(links.join(hot.select("pair"), "pair", "left_anti").join(rest, "pair").select(weighed.columns))
    sums = weighed.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    own = found.drop("pairs", "times").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return own.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
