"""N-gram Jaccard join: exact near-duplicate classes by prefix filters under two global token orders.

A document is the set of its distinct five-word shingles. Two documents link when they share at least ``num / den`` of
the union. Under any order of all shingles, two linked sets share shingles among their first ``n - ceil(t * n) + 1``, and
how many is bounded from below: what they share is at most the shared part of the prefixes and what one of them
has behind its prefix. Here this filter is applied under two orders, and a pair must pass both before its sets are compared:

1. One pass over the texts gives each document the size and a 64-bit fingerprint of its set (equal sets form one class
   at once) and counts the shingles that repeat. The most repeated ones, a fixed number at most, come last in either
   order; this is a matter of cost only, the filter holds under any order.
2. A second pass emits the prefix under the first order, once per set. Shingles that only one set has are dropped.
3. Sets that share a prefix shingle are compared with the least of them, then with central members of its largest component. Only sets of
   different components of linked sets that still meet in a shingle are compared with each other. So a group of copies costs a
   pair per copy, and no pair that could join two components is left out.
4. A pair is compared if its sizes allow the similarity and it passes the filter under the first order, from the shingles
   kept in step 2, and under the second, from the texts, which are read again for the sets of such pairs only.

Shingles with very many sets are spread over tasks by a salt. Cost grows with the pairs of *different* components that
pass the filters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingmart.llm import words
from listingmart.llm.common import attach, in_batches, need, side, stored

SHINGLE = 5
NUM, DEN = 80, 100
# So many of the most repeated shingles, at most, come last in the orders (16 bytes each, in every task).
HEAVY = 1 << 18
HEAVY_COUNT = 16
# Tokens counted together in a task.
COUNTED = 1 << 21
# Members that stand for a component when it is compared with the others of a shingle.
STAND_INS = 6
# Texts taken from a batch at once.
SLICE = 500
# Sets of a heavy shingle that stay together.
TOGETHER = 1 << 10


def _prefix_length(n: int, num: int, den: int) -> int:
    return n - (num * n + den - 1) // den + 1


def _prefix(tokens: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], seed: int, num: int, den: int) -> np.ndarray:
    """Indices of the first shingles of one set under the order of a seed: by heaviness, then by a scrambled hash."""
    order = words.mix(tokens, seed) >> np.uint64(6)
    if len(heavy[0]):
        at = np.minimum(np.searchsorted(heavy[0], tokens), len(heavy[0]) - 1)
        order |= np.where(heavy[0][at] == tokens, heavy[1][at], 0).astype(np.uint64) << np.uint64(58)
    p = _prefix_length(len(tokens), num, den)
    return np.argpartition(order, p - 1)[:p]


def _fingerprint(tokens: np.ndarray) -> int:
    return int((words.mix(tokens, 11).sum() ^ words.mix(np.array([len(tokens)], np.uint64), 12))[0].astype(np.int64))


def _texts(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(row of the first text, shingles of each text) of a batch, a few texts at a time."""
    for at in range(0, batch.num_rows, SLICE):
        for first, group in words.batches(batch.column("text").slice(at, SLICE).to_pylist()):
            yield at + first, words.shingles(*words.word_hashes(group), size)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays).astype(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def describe(docs: DataFrame, size: int) -> DataFrame:
    """One row per document (id, n, set) and rows of repeated shingles (token, n), told apart by ``token``."""
    schema = docs.select("id").schema.simpleString()[7:-1] + ", n bigint, set bigint, token bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, kind = [], 0, pa.int64()

        def repeated() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            token, n = token[n > 1].astype(np.int64), n[n > 1]
            return pa.RecordBatch.from_arrays([pa.nulls(len(n), kind), pa.array(n), pa.nulls(len(n), pa.int64()), pa.array(token)], ["id", "n", "set", "token"])

        for batch in batches:
            kind = batch.column("id").type
            for first, found in _texts(batch, size):
                n = np.array([len(t) for t in found], np.int64)
                name = np.array([_fingerprint(t) if len(t) else 0 for t in found], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(n)), pa.array(n), pa.array(name), pa.nulls(len(n), pa.int64())], ["id", "n", "set", "token"])
                held += found
                count += int(n.sum())
                if count >= COUNTED:
                    yield repeated()
                    held, count = [], 0
        if held:
            yield repeated()

    return in_batches(docs, run, schema)


def heaviest(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most repeated shingles, sorted, with the logarithm of their count (5 bits). They are chosen and stored by a task: collected
    at once, every partition would send the driver its own candidates, as many as are wanted in all."""
    counts = described.filter(F.col("token").isNotNull()).groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY_COUNT)
    top = stored(counts.orderBy(F.desc("n"), "token").limit(HEAVY)).toArrow()
    token = top.column("token").to_numpy().astype(np.uint64)
    order = np.argsort(token)
    return token[order], np.minimum(63, np.log2(top.column("n").to_numpy().astype(np.float64)[order]).astype(np.int64))


class _New:
    """Fingerprints a task has not seen yet; beyond a bound it lets copies through, which later steps drop."""

    def __init__(self, most: int = 200_000) -> None:
        self.seen: set[int] = set()
        self.most = most

    def __call__(self, name: int) -> bool:
        if name in self.seen:
            return False
        if len(self.seen) < self.most:
            self.seen.add(name)
        return True


def prefixes(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], size: int, num: int, den: int) -> DataFrame:
    """(set, token, part) of the first order, sets that a task sees again left out; ``part`` spreads a heavy token."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = _New()
        tokens_of, levels = shared.value
        for batch in batches:
            for _, found in _texts(batch, size):
                names, chosen, parts = [], [], []
                for tokens in found:
                    if not len(tokens) or not new(name := _fingerprint(tokens)):
                        continue
                    first = tokens[_prefix(tokens, shared.value, 21, num, den)]
                    part = np.zeros(len(first), np.int64)
                    if len(tokens_of):
                        at = np.minimum(np.searchsorted(tokens_of, first), len(tokens_of) - 1)
                        often = (tokens_of[at] == first) & (1 << levels[at] >= 2 * TOGETHER)
                        part = np.where(often, 1 + (name & 0x7FFFFFFF) % np.maximum(1, (2 << levels[at]) // TOGETHER), 0)
                    names.append(name)
                    chosen.append(first)
                    parts.append(part)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), _lists(chosen), _lists(parts)], ["set", "token", "part"])

    arrays = in_batches(docs.select("text"), run, "set bigint, token array<bigint>, part array<bigint>")
    return arrays.select("set", F.explode(F.arrays_zip("token", "part")).alias("x")).select("set", "x.token", "x.part")


def payloads(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], size: int, num: int, den: int) -> DataFrame:
    """(set, second, tokens): the prefix under the second order and the whole set."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = _New()
        for batch in batches:
            for _, found in _texts(batch, size):
                kept = [(name, t) for t in found if len(t) and new(name := _fingerprint(t))]
                second = [t[_prefix(t, shared.value, 22, num, den)] for _, t in kept]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in kept], pa.int64()), _lists(second), _lists([t for _, t in kept])], ["set", "second", "tokens"])

    return in_batches(docs.select("text"), run, "set bigint, second array<bigint>, tokens array<bigint>")


def _sized(num: int, den: int) -> Column:
    return F.expr(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)")


def _enough(common: Column, num: int, den: int) -> Column:
    """True if sets that share ``common`` prefix shingles can share enough in all: behind its prefix a set has ceil(t n) - 1."""
    most = common.cast("bigint") + F.expr(f"ceil({num} * greatest(n_a, n_b) / {den}) - 1")
    return F.lit(num + den) * most >= F.lit(num) * (F.col("n_a") + F.col("n_b"))


def _hopeful(shared: Column, large: Column, small: Column, num: int, den: int) -> Column:
    """False if sets of at most ``large`` and at least ``small`` shingles that share at most ``shared`` prefix shingles cannot pass `_enough`."""
    return F.lit(num + den) * (F.lit(den) * shared + F.lit(num) * large) >= F.lit(num * den) * (large + small)


def compared(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of ``pairs`` (a, b, n_a, n_b) that pass the second filter and reach the similarity in full."""
    common = lambda c: F.size(F.array_intersect(f"{c}_a", f"{c}_b")).cast("bigint")
    end = lambda c, x: sets.select(F.col("set").alias(x), F.col(c).alias(f"{c}_{x}"))
    near = side(pairs).join(end("second", "a"), "a").join(end("second", "b"), "b").filter(_enough(common("second"), num, den)).select("a", "b", "n_a", "n_b")
    full = near.join(end("tokens", "a"), "a").join(end("tokens", "b"), "b").withColumn("common", common("tokens"))
    return full.filter(F.expr(f"{den} * common >= {num} * (n_a + n_b - common)")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(set, label): the least set reachable, by spreading least labels and following them, until nothing changes."""
    both = stored(links.union(links.select("b", "a")).toDF("a", "b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("set")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        held = side(labels)
        near = both.join(held.select(F.col("set").alias("b"), "label"), "b").groupBy(F.col("a").alias("set")).agg(F.min("label").alias("near"))
        least = held.join(near, "set").select("set", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = held.select(F.col("set").alias("label"), F.col("label").alias("far"))
        new = stored(least.join(jump, "label", "left").select("set", F.least("label", F.coalesce("far", "label")).alias("label"), "old"))
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("set", "label")
        if not changed:
            return labels


def similar(docs: DataFrame, size: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(id, n_shingles, component_id) for ``docs`` (id, text): one row per row, in no order.

    Null and empty texts, and texts without a word, have no shingle and link with nothing. Rows with a null id get a
    null component and lend their id to no other row, but their texts link others. Repeated rows are copies. ``num / den`` is compared in integers.
    """
    return classified(docs, size, num, den).select("id", "n_shingles", "component_id")


def with_sets(docs: DataFrame, size: int = SHINGLE, name: str = "set") -> DataFrame:
    """``docs`` with the fingerprint of each row's shingles in a column ``name``, 0 for a text without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, found in _texts(batch, size):
                part = batch.slice(first, len(found))
                names = pa.array([_fingerprint(t) if len(t) else 0 for t in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, names], [*batch.schema.names, name])

    return in_batches(docs, run, T.StructType([*docs.schema, T.StructField(name, T.LongType())]))


def classified(docs: DataFrame, size: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of `similar` with the fingerprint of their ``set`` (0 without a word) and ``head``, the set of their component
    that has its least id, the least set if that id repeats; null if no row of the component has an id."""
    need(docs, "id", "text")
    docs = docs.select("id", "text")
    described = stored(describe(docs, size))
    rows = described.filter("token IS NULL").select("id", "n", "set")
    heavy = heaviest(described)
    classes = stored(rows.filter("n > 0").groupBy("set").agg(F.min("id").alias("least"), F.max("n").alias("n")))
    sides = side(classes)
    nameless = bool(classes.filter("least IS NULL").limit(1).count())

    # Both uses of the spread rows read the same columns, so one exchange serves them. A heavy token lies in several parts.
    spread = prefixes(docs, heavy, size, num, den).repartition("token", "part")
    groups = spread.groupBy("token", "part").agg(F.min("set").alias("low"), F.max("set").alias("high"), F.count(F.lit(1)).alias("often")).filter("low <> high OR part > 0")
    # Shingles in parts count as the most frequent of all.
    groups = groups.select("token", "part", "low", F.when(F.col("part") > 0, F.lit(1 << 62)).otherwise(F.col("often")).alias("often"))
    members = stored(spread.join(groups, ["token", "part"]))
    # One order for all sets, rare shingles first.
    rarest = F.transform(F.sort_array(F.collect_set(F.struct("often", "token"))), lambda x: x["token"])
    sized = attach(members.groupBy("set").agg(rarest.alias("first")), classes.select("set", "n"), ["set"], "inner", "set")
    sets = stored(sized)

    def fetched(pairs: DataFrame) -> DataFrame:
        """Payloads of the sets in pairs, from one document of each; of sets that no id leads to, from the rows without one."""
        names = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct().join(sides, "set")
        ids = stored(names.filter("least IS NOT NULL").select(F.col("least").alias("id")).distinct())
        found = payloads(attach(docs, ids, ["id"], "left_semi", "id"), heavy, size, num, den)
        if nameless:
            wanted = stored(names.filter("least IS NULL").select("set"))
            found = found.union(attach(payloads(docs.filter("id IS NULL"), heavy, size, num, den), wanted, ["set"], "left_semi", "set"))
        return stored(found).dropDuplicates(["set"])

    # Step 3, first the stars.
    heads = members.filter("part > 0").groupBy("token").agg(F.min("low").alias("a"))
    tops = members.filter("part > 0").select("token", F.col("low").alias("b")).distinct().join(heads, "token").select("a", "b")
    stars = members.select(F.col("low").alias("a"), F.col("set").alias("b")).union(tops).filter("a <> b").distinct()
    first = lambda x: sets.select(F.col("set").alias(x), F.col("n").alias(f"n_{x}"), F.col("first").alias(f"first_{x}"))

    def linked(pairs: DataFrame) -> DataFrame:
        near = pairs.join(first("a"), "a").join(first("b"), "b").filter(_sized(num, den) & _enough(F.size(F.array_intersect("first_a", "first_b")), num, den))
        able = stored(near.select("a", "b", "n_a", "n_b"))
        return stored(compared(able, fetched(able), num, den))

    def holders(labels: DataFrame) -> DataFrame:
        """(token, set, n, kept, rest, label) for each prefix shingle of each set; ``rest``: those kept from it on in the order."""
        each = attach(sets, labels, ["set"], "left", "set").select("*", F.posexplode("first").alias("at", "token"))
        return each.select("token", "set", "n", F.size("first").cast("bigint").alias("kept"), (F.size("first") - F.col("at")).cast("bigint").alias("rest"), F.coalesce("label", "set").alias("label"))

    # So far a set has met the least of its shingle only. The component with most sets in a shingle meets the others next, each by
    # the members that kept most of their prefix (they have least of their own and lie in the middle), with some chance.
    links = linked(stars)
    known = holders(components(links))
    chance = lambda k: F.pmod(F.xxhash64("set", F.lit(k)), F.lit(1 + 2 * k))
    some = F.array(*(F.max_by("set", F.struct(F.col("kept") + chance(k), "set")) for k in range(STAND_INS)))
    ends = stored(known.groupBy("token", "label").agg(some.alias("some"), F.count(F.lit(1)).alias("sets")))
    most = ends.groupBy("token").agg(F.max_by("label", F.struct("sets", "label")).alias("low"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("token", "low")
    open_ = ends.join(most, "token")
    firsts = open_.filter("label = low").select("token", F.col("some").alias("one"))
    probes = open_.filter("label <> low").join(firsts, "token").select(F.explode(F.arrays_zip("one", "some")).alias("x")).select(F.col("x.one").alias("a"), F.col("x.some").alias("b"))
    links = links.union(linked(probes.distinct()))
    labels = components(links)

    # Then the sets of different components that meet in a shingle. Two sets meet at the first shingle they share; they share at most
    # as many as either has from there on, and sizes bound how few will do. So a near copy with many shingles of its own makes no
    # pair, and pairs that share some shingles only late in the order are not made either.
    known = holders(labels)
    met = stored(known.groupBy("token", "label").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("most")))
    meets = lambda x: met.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("label", "low", "high", "most")))
    apart = F.expr(f"label_a < label_b AND {den} * high_a >= {num} * low_b AND {den} * high_b >= {num} * low_a")
    apart &= _hopeful(F.least("most_a", "most_b"), F.greatest("high_a", "high_b"), F.least("low_a", "low_b"), num, den)
    left, right = meets("a"), meets("b")
    meet = left.join(right, (left["token"] == right["token"]) & apart).select(left["token"], "label_a", "label_b", "low_b", "high_b", "most_b")
    end = lambda x: known.select("token", *(F.col(c).alias(f"{d}_{x}" if d else x) for c, d in (("label", "label"), ("set", ""), ("n", "n"), ("rest", "rest"))))
    fits = F.expr(f"{den} * n_a >= {num} * low_b AND {den} * high_b >= {num} * n_a")
    fits &= _hopeful(F.least("rest_a", "most_b"), F.greatest("n_a", "high_b"), F.least("n_a", "low_b"), num, den)
    able = _sized(num, den) & _enough(F.least("rest_a", "rest_b"), num, den)
    cross = meet.join(end("a"), ["token", "label_a"]).filter(fits).join(end("b"), ["token", "label_b"]).filter(able)
    new = linked(cross.select("a", "b").distinct())
    if new.limit(1).count():
        labels = components(links.union(new))
    named = classes.join(side(labels), "set", "left").select("set", "least", F.coalesce("label", "set").alias("label"))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"), F.min(F.when(F.col("least").isNotNull(), F.struct("least", "set")))["set"].alias("head"))
    linked = named.join(names, "label").filter("component_id IS NOT NULL").select("set", "component_id", "head")
    out = rows.join(linked, ["set"], "left")
    whose = F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component_id", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), whose.alias("component_id"), "set", "head")
