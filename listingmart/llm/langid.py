"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For every bit a linear classifier over hashed letter n-grams (two and three
letters, words kept apart by a blank) tells the languages with a 1 from those with a 0. A text's bits are
answered from its whole text, and the language is the one whose codeword has the least loss, the logistic losses of the bits
weighed by how well each classifier did on rows it had not seen. The score is the share of the best language after a softmax of the
losses; a text is ambiguous when it is low. All models together are one small table, which is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmart.llm import samples
from listingmart.llm.common import in_batches, need

# Labelled documents of a language, and in all, that are used at most; and of a language even beyond that.
PER_LANG, SAMPLE, LEAST = 600, 2000, 100
BUCKETS = 1 << 12  # for pairs, and as many for triples
EPOCHS, RATE = 150, 0.05
TOGETHER = 512  # rows of the feature table that are dense at once
UNKNOWN, AMBIGUOUS = "und", 0.5
# Below this score a text is rejected by a filter: hardly better than any language by chance.
REJECTED = 0.3
BATCH_CHARS = 1 << 19
SLICE = 500


def _letters() -> np.ndarray:
    """Lower-case letter of each code point, blank for what is no letter."""
    out = np.full(0x110000, 32, np.int32)
    for i in range(0x110000):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_LETTERS: list[np.ndarray] = []


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each pair and triple, -1 where there is no letter; where each text begins; its number of letters)."""
    if not _LETTERS:
        _LETTERS.append(_letters())
    joined = " " + "  ".join(texts) + "   "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _LETTERS[0][points].astype(np.uint32)
    a, b, c = x[:-2], x[1:-1], x[2:]
    pair = (a * np.uint32(2654435761) ^ b * np.uint32(2246822519)) * np.uint32(3266489917)
    triple = (pair ^ c * np.uint32(668265263)) * np.uint32(374761393)
    letter = b != 32
    two = np.where(letter, (pair >> np.uint32(20)).astype(np.int32), -1)
    three = np.where(letter, (triple >> np.uint32(20)).astype(np.int32) + BUCKETS, -1)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    count = np.add.reduceat(letter.astype(np.int64), np.minimum(begins, len(letter) - 1)) if len(texts) else np.zeros(0, np.int64)
    return np.stack((two, three)), begins, count


def codewords(k: int) -> np.ndarray:
    """k rows of signs, all different: every split in two for few languages, else random ones far apart."""
    if k <= 5:
        splits = range(1, 2 ** (k - 1)) if k > 1 else [1]
        return np.array([[1 if i == 0 or not s >> (i - 1) & 1 else -1 for s in splits] for i in range(k)])
    rng = np.random.default_rng(11)
    bits = max(15, math.ceil(10 * math.log2(k)))
    best, far = None, -1
    for _ in range(200):
        made = rng.choice([-1, 1], (k, bits))
        apart = ((bits - made @ made.T) // 2 + np.eye(k, dtype=int) * bits).min()
        if apart > far and (np.abs(made.sum(0)) < k).all():
            best, far = made, apart
    return best


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray
    table: np.ndarray  # one row per bucket, one column per bit
    bias: np.ndarray
    weights: np.ndarray


class _Rows:
    """Sparse table of the share of each bucket in each text; a few rows at a time are made dense."""

    def __init__(self, at: list[np.ndarray], share: list[np.ndarray]) -> None:
        self.ends = np.cumsum([0, *map(len, at)])
        self.at = np.concatenate([np.zeros(0, np.uint16), *at])
        self.share = np.concatenate([np.zeros(0, np.float32), *share])
        self.held = np.zeros((min(TOGETHER, len(at)), 2 * BUCKETS), np.float32)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def scaled(self) -> np.ndarray:
        """The deviation of each bucket, by which its shares are divided."""
        n = max(1, len(self))
        mean = np.bincount(self.at, self.share, 2 * BUCKETS) / n
        square = np.bincount(self.at, self.share.astype(np.float64) ** 2, 2 * BUCKETS) / n
        scale = (np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-4).astype(np.float32)
        self.share /= scale[self.at]
        return scale

    def dense(self, start: int, end: int) -> Iterator[tuple[slice, np.ndarray]]:
        for a in range(start, end, TOGETHER):
            b = min(end, a + TOGETHER)
            own, part = slice(self.ends[a], self.ends[b]), self.held[: b - a]
            part[:] = 0
            part[np.repeat(np.arange(b - a), np.diff(self.ends[a : b + 1])), self.at[own]] = self.share[own]
            yield slice(a, b), part


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's pairs and triples, and the share of each."""
    ids, _, count = grams([text])
    own = np.bincount(ids[ids >= 0], minlength=2 * BUCKETS)
    at = np.flatnonzero(own).astype(np.uint16)
    return at, (own[at] / max(1, int(count[0]))).astype(np.float32)


def passage(text: str, seed: int) -> str:
    """A short passage from anywhere in a text."""
    rng = np.random.default_rng(seed % (1 << 63))
    n = int(rng.integers(20, 200))
    at = int(rng.integers(0, max(1, len(text) - n)))
    return text[at : at + n]


def fit(texts: list[str], langs: list[str]) -> Model:
    """One classifier per bit, on whole texts and as many short passages of them."""
    found = [shares(t) for t in texts] + [shares(passage(t, i)) for i, t in enumerate(texts)]
    return fit_shares([at for at, _ in found], [share for _, share in found], [*langs, *langs])


def fit_shares(at: list[np.ndarray], share: list[np.ndarray], langs: list[str]) -> Model:
    """One classifier per bit, on the buckets of texts and their shares."""
    names = sorted(set(langs))
    codes = codewords(len(names)) if names else np.zeros((0, 1), int)
    # Every eighth row tests; rows are put in that order at once, so that both parts are ranges of one table.
    order = sorted(range(len(at)), key=lambda i: (i % 8 == 7, i))
    rows = _Rows([at[i] for i in order], [share[i] for i in order])
    known = codes[[names.index(langs[i]) for i in order]].astype(np.float32) if names else np.zeros((0, codes.shape[1]), np.float32)
    scale = rows.scaled()
    cut = len(rows) - len(rows) // 8
    w, b = np.zeros((2 * BUCKETS, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    first, second = [np.zeros_like(p) for p in (w, b)], [np.zeros_like(p) for p in (w, b)]
    for step in range(1, EPOCHS + 1 if cut else 1):
        slopes = [1e-5 * w, np.zeros_like(b)]
        for own, x in rows.dense(0, cut):
            y = known[own]
            error = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / cut
            slopes[0] += x.T @ error
            slopes[1] += error.sum(0)
        for p, g, m, v in zip((w, b), slopes, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    hits = sum((((x @ w + b) * known[own] > 0).sum(0) for own, x in rows.dense(cut, len(rows))), np.zeros(codes.shape[1]))
    right = hits / (len(rows) - cut) if cut < len(rows) else np.full(codes.shape[1], 0.9)
    right = np.clip(right, 0.5, 0.99)
    return Model(names, codes, (w / scale[:, None]).astype(np.float32), b, np.log(right / (1 - right)))


def answers(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Answer of each bit's classifier per text, and the number of letters."""
    found, counts, group, held = [], [], [], 0

    def flush() -> None:
        ids, begins, count = grams(group)
        ends = [*begins[1:].tolist(), ids.shape[1]]
        for a, b, n in zip(begins.tolist(), ends, count.tolist(), strict=True):
            total = np.zeros(model.table.shape[1])
            for at in range(a, b, BATCH_CHARS):
                own = ids[:, at : min(b, at + BATCH_CHARS)]
                total += model.table[own[own >= 0]].sum(0, dtype=np.float64)
            found.append(total / max(1, n) + model.bias)
            counts.append(n)

    for text in texts:
        if group and held + len(text) > BATCH_CHARS:
            flush()
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        flush()
    return np.array(found).reshape(len(texts), -1), np.array(counts, np.int64)


def decode(model: Model, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language with the least weighted loss, and its share of a softmax."""
    margins = bits[:, None, :] * model.codes[None, :, :]
    loss = (np.logaddexp(0, -margins) * model.weights).sum(2) / model.weights.sum()
    best = loss.argmin(1)
    share = np.exp(-3 * (loss - loss.min(1, keepdims=True)))
    return best, 1 / share.sum(1)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    if not model.langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    bits, letters = answers(model, [t or "" for t in texts])
    best, score = decode(model, bits)
    return [model.langs[k] if n else UNKNOWN for k, n in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters > 0, score, 0.0)


def model(docs: DataFrame, per_lang: int = PER_LANG, most: int = SAMPLE, least: int = LEAST) -> Model:
    """Fit on a sample of documents that are not held out, evenly by language. None: every text is unknown.

    Executors count the n-grams; the driver gets at most 2 * `BUCKETS` numbers of a text, whatever its length.
    """
    need(docs, "doc_id", "text", "lang")
    known = docs.filter(F.col("text").isNotNull()).select("doc_id", F.col("lang").alias("label"))
    rows = samples.drawn(docs, known, per_lang, most, least).select("order", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for whole, make in ((True, lambda t, _: shares(t)), (False, lambda t, seed: shares(passage(t, seed)))):
                    found = [make(t, seed) for t, seed in zip(part.column("text").to_pylist(), part.column("order").to_pylist(), strict=True)]
                    lists = [pa.array([own[k] for own in found], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.float32()))]
                    yield pa.RecordBatch.from_arrays([part.column("order"), part.column("label"), pa.array([whole] * len(found)), *lists], ["order", "label", "whole", "at", "share"])

    kind = rows.schema["label"].dataType.simpleString()
    found = in_batches(rows, run, f"order long, label {kind}, whole boolean, at array<int>, share array<float>").toArrow()
    found = found.sort_by([("whole", "descending"), ("order", "ascending")])
    at = [x.values.to_numpy().astype(np.uint16) for x in found.column("at")]
    return fit_shares(at, [x.values.to_numpy() for x in found.column("share")], found.column("label").to_pylist())


def identified(docs: DataFrame, fitted: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every row; null texts and texts without a letter are `und`, 0."""
    need(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    ids = docs.select("doc_id").schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                lang, score = predict(shared.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(score < AMBIGUOUS)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    flagged = docs.select("doc_id", samples.held_out(F.col("doc_id")).alias("held_out"), "text")
    return in_batches(flagged, run, f"{ids}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def kept(docs: DataFrame, fitted: Model) -> DataFrame:
    """Rows of ``docs`` with a language: a text without a letter, or that no language fits clearly, goes."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                lang, score = predict(shared.value, part.column(at).to_pylist())
                yield part.filter(pa.array([x != UNKNOWN and s >= REJECTED for x, s in zip(lang, score.tolist(), strict=True)], pa.bool_()))

    return in_batches(docs, run, docs.schema)
