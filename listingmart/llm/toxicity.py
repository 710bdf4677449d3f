"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are lower-cased runs of letters, digits or other signs, hashed to a table of embeddings. Filters one, two and
three words wide run over the whole text, each keeps its largest answer, and a logistic unit weighs these. The embedding's
first component starts as the shrunken log-odds of a word that is clearly more frequent in toxic documents, counted on one part of the sample;
the network is trained on another, so that words which one document alone has mean nothing. Thresholds per
language are calibrated on a third part. The model has a fixed size and is broadcast.

`model` learns from every labelled row. Executors count words, train and try thresholds; the driver gets sums of the model's
size. For training the rows are dealt to blocks: in each epoch every block goes on from the shared network, and the mean of
what the blocks make of it is shared next.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmart.llm import samples, words
from listingmart.llm.common import attach, by_shuffle, in_batches, need, stored

# Documents that are trained on together, and words of them, on average.
BLOCK_ROWS, BLOCK_WORDS = 2_000, 1 << 22
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 6
EPOCHS, BATCH, RATE = 8, 32, 0.01
SHRINK = 3.0
THRESHOLD = 0.3
# Weight, in rows, of all languages' errors in the choice of one language's threshold, and the thresholds to choose from.
PRIOR = 50
GRID = np.round(np.arange(0.05, 0.96, 0.05), 2)
SLICE = 500
# Where to cut words, as bytes: white space apart, and between ASCII letters, ASCII digits and other ASCII signs.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_CUT = ~np.eye(4, dtype=bool)


@dataclass
class Net:
    table: np.ndarray  # one row per bucket, and a last one of zeros that fills up texts
    filters: list[np.ndarray]  # per width: width, DIM, FILTERS
    shifts: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def limit(self, lang: str | None) -> float:
        """Texts of a language that score at least so much are rejected."""
        return self.thresholds.get(lang, self.thresholds.get(None, THRESHOLD))


def tokens(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word, and the offsets of each text's words."""
    _, _, _, hashes, offsets = words.units(raws, _CLASS, _CUT)
    return (hashes >> np.uint64(46)).astype(np.int32), offsets


def lowered(texts: list[str | None]) -> list[str]:
    return [t.lower() if t else "" for t in texts]


def padded(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one behind the other, each followed by fill words so that no filter sees two texts; where each begins."""
    gap = max(WIDTHS)
    out = np.full(len(ids) + gap * (len(offsets) - 1), BUCKETS, np.int32)
    out[np.arange(len(ids)) + gap * np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = ids
    return out, offsets[:-1] + gap * np.arange(len(offsets) - 1)


def forward(net: Net, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest answer of each filter per text, and the answers themselves."""
    x = net.table[ids]
    n = len(ids)
    answers = np.empty((n, FILTERS * len(WIDTHS)), np.float32)
    for k, width in enumerate(WIDTHS):
        own = answers[:, k * FILTERS : (k + 1) * FILTERS]
        own[:] = net.shifts[k]
        for j in range(width):
            own[: n - j] += x[j:] @ net.filters[k][j]
    return np.maximum.reduceat(answers, begins, axis=0), answers


def hashed_scores(net: Net, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    top, _ = forward(net, *padded(ids, offsets))
    return 1 / (1 + np.exp(-np.clip(np.maximum(top, 0) @ net.weights + net.bias, -30, 30)))


def scores(net: Net, texts: list[str | None]) -> np.ndarray:
    out = [hashed_scores(net, *tokens(raws)) for _, raws in words.batches(lowered(texts))]
    return np.concatenate(out) if out else np.zeros(0)


def copy_keys(ids: np.ndarray) -> list[tuple[tuple[int, int], ...]]:
    """Keys of which near copies share one: any four of six least hashes."""
    least = [(k, int(words.mix(np.unique(ids).astype(np.uint64), 40 + k).min())) for k in range(6)]
    return list(combinations(least, 4))


def without_copies(ids: list[np.ndarray]) -> list[int]:
    """Indices of the texts that are no near copy of an earlier one: copies would make their rare words look telling."""
    seen: set[tuple[tuple[int, int], ...]] = set()
    kept = []
    for i, own in enumerate(ids):
        if not len(own):
            continue
        keys = set(copy_keys(own))
        if not keys & seen:
            kept.append(i)
        seen |= keys
    return kept


def constant(share: float) -> Net:
    """The same score for any text."""
    net = Net(np.zeros((BUCKETS + 1, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), 0.0)
    share = min(0.99, max(0.01, share))
    net.bias = float(np.log(share / (1 - share)))
    return net


def start(seen: np.ndarray, bad: int, good: int, rng: np.random.Generator) -> Net:
    """Embeddings from the log-odds of each bucket, filters that look at them. ``seen`` is the number of documents of each
    label (0, 1) that hold a bucket, ``bad`` and ``good`` that of all toxic and other documents."""
    bad, good = max(1, bad), max(1, good)
    share = bad / (bad + good)
    odds = np.log((seen[1] + SHRINK * share) / bad) - np.log((seen[0] + SHRINK * (1 - share)) / good)
    odds += np.log(bad / share) - np.log(good / (1 - share))
    table = rng.normal(0, 0.02, (BUCKETS + 1, DIM)).astype(np.float32)
    n = seen.sum(0)
    # Chernoff's bound on so many toxic documents by chance, small enough for the number of words looked at.
    q = np.clip(seen[1] / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    sure = n * (q * np.log(q / share) + (1 - q) * np.log((1 - q) / (1 - share)))
    clear = (q > share) & (sure >= np.log(max(2, (n > 0).sum())))
    table[:BUCKETS, 0] = np.where(clear, np.clip(odds, 0, 5), 0)
    table[BUCKETS] = 0
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0] = np.abs(f[0, 0]) + 0.5
    return Net(table, filters, [np.full(FILTERS, -0.8, np.float32) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.2, np.float32), -3.0)


class Training:
    """A network with the moments of Adam."""

    def __init__(self, net: Net) -> None:
        self.net, self.bias, self.step = net, np.array([net.bias], np.float32), 0.0
        self.first, self.second = ([np.zeros_like(p) for p in self.dense()] for _ in range(2))

    def dense(self) -> list[np.ndarray]:
        return [*self.net.filters, *self.net.shifts, self.net.weights, self.bias]

    def state(self) -> np.ndarray:
        """All but the embeddings, in rows of `DIM`."""
        flat = np.concatenate([*(x.ravel() for x in (*self.dense(), *self.first, *self.second)), np.array([self.step], np.float32)])
        return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM)

    def set_state(self, rows: np.ndarray) -> None:
        flat, at = rows.ravel(), 0
        for x in (*self.dense(), *self.first, *self.second):
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        self.step = float(flat[at])

    def done(self) -> Net:
        self.net.bias = float(self.bias[0])
        return self.net

    def epoch(self, ids: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, order: np.ndarray) -> None:
        """Adam on the log loss; only the words that gave a filter its largest answer get a gradient."""
        net, dense, bias = self.net, self.dense(), self.bias
        for batch in np.array_split(order, max(1, len(order) // BATCH)):
            own = np.concatenate([ids[offsets[i] : offsets[i + 1]] for i in batch])
            bounds = np.concatenate(([0], np.cumsum([offsets[i + 1] - offsets[i] for i in batch])))
            filled, begins = padded(own, bounds)
            top, answers = forward(net, filled, begins)
            live = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(live @ net.weights + bias[0], -30, 30)))
            error = ((p - toxic[batch]) / len(batch)).astype(np.float32)
            grads = [np.zeros_like(q) for q in dense]
            grads[-1][0], grads[-2][:] = error.sum(), live.T @ error
            back = error[:, None] * net.weights[None, :] * (top > 0)
            ends = [*begins[1:].tolist(), len(filled)]
            where = np.stack([a + answers[a:b].argmax(0) for a, b in zip(begins.tolist(), ends, strict=True)])
            touched: list[tuple[np.ndarray, np.ndarray]] = []
            for k, width in enumerate(WIDTHS):
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                grads[len(WIDTHS) + k][:] = back[:, part].sum(0)
                for j in range(width):
                    at = filled[np.minimum(where[:, part] + j, len(filled) - 1)]
                    grads[k][j] = np.einsum("df,dfe->ef", back[:, part], net.table[at])
                    touched.append((at.ravel(), (back[:, part, None] * net.filters[k][j].T[None]).reshape(-1, DIM)))
            self.step += 1
            for q, g, m, v in zip(dense, grads, self.first, self.second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= RATE * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
            for at, g in touched:
                np.subtract.at(net.table, at, RATE * g)
            net.table[BUCKETS] = 0


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of the texts, and the offsets of each text's words."""
    ids, offsets = [np.zeros(0, np.int32)], [0]
    for _, raws in words.batches(lowered(texts)):
        some, bounds = tokens(raws)
        ids.append(some)
        offsets += (offsets[-1] + bounds[1:]).tolist()
    return np.concatenate(ids), np.array(offsets)


def fit(texts: list[str], toxic: np.ndarray, langs: list[str | None]) -> Net:
    """Train on labelled texts in memory. Without texts of both labels the score is the share of toxic ones, for any text."""
    every, bounds = joined(texts)
    rng = np.random.default_rng(3)
    parts = np.arange(len(toxic)) % 5  # three for the log-odds, one for training, one for thresholds
    net = constant(float(toxic.mean()) if len(toxic) else 0.0)
    if not len(toxic) or toxic.min() == toxic.max():
        return net

    def pick(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [every[bounds[i] : bounds[i + 1]] for i in rows]
        return np.concatenate(own), np.concatenate(([0], np.cumsum([len(x) for x in own]))), toxic[rows]

    counted, trained = np.flatnonzero(parts < 3), np.flatnonzero(parts == 3)
    counted = counted[without_copies([every[bounds[i] : bounds[i + 1]] for i in counted])]
    if not len(counted) or not len(trained):
        return net
    seen = np.zeros((2, BUCKETS))
    for i in counted:
        seen[toxic[i], np.unique(every[bounds[i] : bounds[i + 1]])] += 1
    training = Training(start(seen, int(toxic[counted].sum()), int((1 - toxic[counted]).sum()), rng))
    for _ in range(EPOCHS):
        training.epoch(*pick(trained), rng.permutation(len(trained)))
    net = training.done()
    rest = np.flatnonzero(parts == 4)
    score = [hashed_scores(net, *pick(rest[at : at + BATCH])[:2]) for at in range(0, len(rest), BATCH)]
    net.thresholds = calibrated(np.concatenate([np.zeros(0), *score]), toxic[rest], [langs[i] for i in rest])
    return net


def wrong(score: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Errors with each threshold of the grid."""
    return ((score[:, None] >= GRID) != toxic[:, None]).sum(0)


def calibrated(score: np.ndarray, toxic: np.ndarray, langs: list[str | None]) -> dict[str | None, float]:
    """Thresholds as `fewest` has them, from scores in memory."""
    of = {lang: np.array([i for i, x in enumerate(langs) if x == lang]) for lang in {*langs}}
    return fewest({lang: wrong(score[rows], toxic[rows]) for lang, rows in of.items()}, len(score))


def fewest(errors: dict[str | None, np.ndarray], n: int) -> dict[str | None, float]:
    """Per language the threshold with the fewest errors among ``n`` rows, the nearest to the default among equals.

    The errors of all languages together count as `PRIOR` rows in each, so a language with few rows stays near the common
    threshold and one with many has its own. That holds for any number of rows; there is no least one. Under None is the
    common threshold, for languages that were not met and for none.
    """
    near = np.abs(GRID - THRESHOLD)

    def best(cost: np.ndarray) -> float:
        return float(GRID[np.lexsort((near, np.round(cost, 9)))[0]])

    every = sum(errors.values(), np.zeros(len(GRID), np.int64))
    common = every * (PRIOR / max(1, n))
    found: dict[str | None, float] = {None: best(every) if n else THRESHOLD}
    for lang in sorted(x for x in errors if x is not None):
        found[lang] = best(errors[lang] + common)
    return found


def hashed(rows: DataFrame) -> DataFrame:
    """(place, toxic, lang, n, words) of labelled rows: the buckets of their words, made where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids, offsets = joined(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                own = [part.column("place"), part.column("toxic"), part.column("lang"), pa.array(np.diff(offsets), pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(own, ["place", "toxic", "lang", "n", "words"])

    return in_batches(rows.select("place", "label.toxic", "label.lang", "text"), run, "place long, toxic int, lang string, n long, words array<int>")


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow column, without nulls."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []


def bounded(rows: DataFrame, words_at_most: int) -> DataFrame:
    """The first rows with so many words in all, without those that have more than a sixteenth of that, numbered anew."""
    short = stored(rows.filter(F.col("n") <= words_at_most // 16))
    lengths = short.select("place", "n").toArrow().sort_by("place")
    fits = int((np.cumsum(lengths.column("n").to_numpy()) <= words_at_most).sum())
    last = lengths.column("place")[fits - 1].as_py() if fits else -1
    chosen = samples.numbered(short.filter(F.col("place") <= last).select("place"), "place").withColumnRenamed("number", "new")
    return short.join(chosen, "place").drop("place").withColumnRenamed("new", "place")


def first_of_copies(rows: DataFrame) -> DataFrame:
    """(place) of the rows with words that share no key of near copies with a row of a lower place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [[hash(k) for k in copy_keys(own)] for own in _lists(batch.column("words"))]
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(keys, pa.list_(pa.int64()))], ["place", "keys"])

    # Rows with all keys alike are copies of the first of them, so a key is met once for each kind of row only.
    named = in_batches(rows.filter("n > 0").select("place", "words"), run, "place long, keys array<long>")
    heads = stored(named.groupBy("keys").agg(F.min("place").alias("place")))
    pairs = heads.select("place", F.explode("keys").alias("key"))
    firsts = pairs.groupBy("key").agg(F.min("place").alias("first"))
    gone = pairs.join(firsts, "key").filter("first < place").select("place").distinct()
    return heads.select("place").join(gone, "place", "left_anti")


def document_counts(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """How many rows of each label hold each bucket, and how many are toxic and not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last place counts rows.
        seen = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for y, own in zip(batch.column("toxic").to_pylist(), _lists(batch.column("words")), strict=True):
                seen[y, np.unique(own)] += 1
                seen[y, BUCKETS] += 1
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *map(pa.array, seen[:, at])], ["bucket", "good", "bad"])

    parts = in_batches(rows.select("toxic", "words"), run, "bucket int, good long, bad long")
    found = parts.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    seen = np.zeros((2, BUCKETS + 1))
    seen[:, found.column("bucket").to_numpy()] = [found.column(c).to_numpy() for c in ("good", "bad")]
    return seen[:, :BUCKETS], int(seen[1, BUCKETS]), int(seen[0, BUCKETS])


def trained(net: Net, rows: DataFrame, rng: np.random.Generator) -> Net:
    """The network after `EPOCHS` passes over all rows, whose blocks are averaged after each."""
    n, held = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_blocks = max(1, -(-n // BLOCK_ROWS), -(-held // BLOCK_WORDS))
    dealt = rows.withColumn("block", F.expr(f"(place div 5) % {n_blocks}")).groupBy("block")
    blocks = stored(dealt.agg(F.array_sort(F.collect_list(F.struct("place", "toxic", "words"))).alias("rows")).select("rows").repartition(n_blocks))
    training, values = Training(net), [f"v{i}" for i in range(DIM)]
    spark = rows.sparkSession
    for epoch in range(EPOCHS):
        shared = spark.sparkContext.broadcast((training, rng))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, epoch=epoch) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    part = batch.column(0).slice(i, 1).flatten()
                    own, own_rng = deepcopy(shared.value)
                    lists = part.field("words")
                    ids, offsets = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
                    for _ in range(epoch + 1):
                        order = own_rng.permutation(len(part))
                    own.epoch(ids, offsets, part.field("toxic").to_numpy().astype(np.int64), order)
                    at = np.flatnonzero((own.net.table != shared.value[0].net.table).any(1))
                    state = own.state()
                    slots = np.concatenate((at, BUCKETS + 1 + np.arange(len(state)))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(slots), *map(pa.array, np.concatenate((own.net.table[at], state)).T.copy())], ["slot", *values])

        parts = in_batches(blocks, run, f"slot int, {', '.join(f'{v} float' for v in values)}")
        # An embedding is averaged over the blocks that moved it, the rest over all.
        mean = parts.groupBy("slot").agg(*(F.avg(v).alias(v) for v in values)).toArrow().sort_by("slot")
        slots, new = mean.column("slot").to_numpy(), np.stack([mean.column(v).to_numpy() for v in values], 1).astype(np.float32)
        words_end = np.searchsorted(slots, BUCKETS + 1)
        training.net.table[slots[:words_end]] = new[:words_end]
        training.set_state(new[words_end:])
        shared.destroy()
    return training.done()


def thresholds(net: Net, rows: DataFrame) -> dict[str | None, float]:
    """Thresholds from the errors on all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(net)
    names = [f"e{i}" for i in range(len(GRID))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            toxic, lists = batch.column("toxic").to_numpy(), _lists(batch.column("words"))
            score = [np.zeros(0)]
            for at in range(0, len(lists), BATCH):
                own = lists[at : at + BATCH]
                score.append(hashed_scores(shared.value, np.concatenate(own), np.concatenate(([0], np.cumsum([len(x) for x in own])))))
            score = np.concatenate(score)
            kinds = list(dict.fromkeys(langs.tolist()))
            errors = [wrong(score[langs == x], toxic[langs == x]) for x in kinds]
            counts = [int((langs == x).sum()) for x in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(counts, pa.int64()), *(pa.array(e, pa.int64()) for e in zip(*errors, strict=True))], ["lang", "n", *names])

    found = in_batches(rows.select("lang", "toxic", "words"), run, f"lang string, n long, {', '.join(f'{e} long' for e in names)}")
    sums = found.groupBy("lang").agg(F.sum("n").alias("n"), *(F.sum(e).alias(e) for e in names)).collect()
    return fewest({r.lang: np.array([r[e] for e in names]) for r in sums}, sum(r.n for r in sums))


def model(docs: DataFrame, labels: DataFrame, most: int | None = None, words_at_most: int | None = None) -> Net:
    """Fit on all labelled documents (labels: doc_id, toxic), never on held-out ones; a caller may set bounds on documents and words.

    Executors hash the words; neither texts nor words reach the driver. Without texts of both labels the score is the share
    of toxic ones, for any text.
    """
    need(docs, "doc_id", "text", "lang")
    need(labels, "doc_id", "toxic")
    # The language travels with the label for the thresholds; no score sees it.
    langs = docs.groupBy("doc_id").agg(F.max("lang").alias("lang"))
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1)).join(by_shuffle(langs), "doc_id").select("doc_id", F.struct(F.col("toxic").cast("int").alias("toxic"), "lang").alias("label"))
    rows = hashed(samples.placed(docs, known, most))
    rows = stored(rows if words_at_most is None else bounded(rows, words_at_most))
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    net = constant(bad / n if n else 0.0)
    if bad in (0, n):
        return net
    # Of five rows three are for the log-odds, one for training, one for thresholds.
    part = F.col("place") % 5
    counted, learned = rows.filter(part < 3), rows.filter(part == 3)
    seen, bad, good = document_counts(attach(counted, stored(first_of_copies(counted)), ["place"], "left_semi", "place"))
    if not bad + good or learned.isEmpty():
        return net
    rng = np.random.default_rng(3)
    net = trained(start(seen, bad, good, rng), learned, rng)
    net.thresholds = thresholds(net, rows.filter(part == 4))
    return net


def scored(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, lang, held_out, score) of every row. Null and empty texts get the score of a text without words."""
    need(docs, "doc_id", "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(net)
    ids = docs.select("doc_id", "lang").schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                score = scores(shared.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("held_out"), pa.array(score.astype(np.float64))], ["doc_id", "lang", "held_out", "score"])

    flagged = docs.select("doc_id", "lang", samples.held_out(F.col("doc_id")).alias("held_out"), "text")
    return in_batches(flagged, run, f"{ids}, held_out boolean, score double")


def kept(docs: DataFrame, net: Net) -> DataFrame:
    """Rows of ``docs`` that score below the threshold of their language (or the general one), with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                limits = np.array([shared.value.limit(x) for x in part.column(lang_at).to_pylist()])
                yield part.filter(pa.array(scores(shared.value, part.column(at).to_pylist()) < limits))

    return in_batches(docs, run, docs.schema)
