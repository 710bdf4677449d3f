"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample of rows, and every row is then sent down to its leaf. A query opens tree nodes
from a priority queue, nearest centre first; the leaves it reaches, in that order, are its bins. How many leaves are
visited is calibrated: sample queries are answered exactly over all rows, and visits widen until the wanted share of true neighbours lies in the
visited leaves. Queries then meet the rows of their leaves, in blocks of bounded size, so a leaf that holds a third of
all rows is many tasks' work. Distances are computed in double precision on the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingmart.llm import vectors
from listingmart.llm.common import need, stored

# The tree is fitted on at most SAMPLE rows; CALIBRATION rows are answered exactly to find the visits.
SAMPLE, CALIBRATION = 16_384, 200
BRANCH, LEAF, ROUNDS = 8, 64, 8
RECALL = 0.96
# Rows and queries of a leaf that meet in one task.
BLOCK, QUERIES = 8192, 4096


@dataclass
class Tree:
    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf_of: list[int] = field(default_factory=list)
    leaves: int = 0

    def add(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        self.leaf_of.append(-1)
        return len(self.centres) - 1

    def grow(self, node: int, data: np.ndarray, rng: np.random.Generator) -> None:
        """Split a node by k-means until a part has at most LEAF rows or cannot be split."""
        distinct = np.unique(data, axis=0) if len(data) > LEAF else data
        if len(data) <= LEAF or len(distinct) < 2:
            self.leaf_of[node] = self.leaves
            self.leaves += 1
            return
        centres = distinct[rng.choice(len(distinct), min(BRANCH, len(distinct)), replace=False)]
        for _ in range(ROUNDS):
            nearest = squared(data, centres).argmin(1)
            centres = np.stack([data[nearest == j].mean(0) if (nearest == j).any() else centres[j] for j in range(len(centres))])
        nearest = squared(data, centres).argmin(1)
        parts = [(centres[j], data[nearest == j]) for j in range(len(centres)) if (nearest == j).any()]
        if len(parts) < 2:
            self.leaf_of[node] = self.leaves
            self.leaves += 1
            return
        for centre, part in parts:
            child = self.add(centre)
            self.children[node].append(child)
            self.grow(child, part, rng)

    def leaf(self, data: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest centre at each level."""
        out = np.zeros(len(data), np.int32)
        todo = [(0, np.arange(len(data)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not below:
                out[rows] = self.leaf_of[node]
            elif len(rows):
                nearest = squared(data[rows], np.stack([self.centres[c] for c in below])).argmin(1)
                todo += [(c, rows[nearest == j]) for j, c in enumerate(below)]
        return out

    def visits(self, data: np.ndarray, most: int) -> list[list[int]]:
        """The first ``most`` leaves of each row, best bin first."""
        away = squared(data, np.stack(self.centres)).tolist()
        found = []
        for d in away:
            queue, order = [(0.0, 0)], []
            while queue and len(order) < most:
                _, node = heapq.heappop(queue)
                while below := self.children[node]:
                    near = min(below, key=d.__getitem__)
                    for c in below:
                        if c != near:
                            heapq.heappush(queue, (d[c], c))
                    node = near
                order.append(self.leaf_of[node])
            found.append(order)
        return found


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def fit(sample: np.ndarray) -> Tree:
    tree = Tree()
    root = tree.add(sample.mean(0) if len(sample) else np.zeros(sample.shape[1]))
    tree.grow(root, sample, np.random.default_rng(7))
    return tree


def nearest(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indices and exact distances of each query's k nearest rows but those with its own id; ``ids`` ascend."""
    found = []
    fast = squared(queries, data)
    slack = 1e-9 * ((queries * queries).sum(1)[:, None] + (data * data).sum(1).max(initial=0))[:, 0]
    for i, me in enumerate(own.tolist()):
        row = fast[i]
        row[ids == me] = np.inf
        if k < len(row):
            kept = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + slack[i])
        else:
            kept = np.arange(len(row))
        kept = kept[ids[kept] != me]
        exact = np.sqrt(((data[kept] - queries[i]) ** 2).sum(1))
        order = np.lexsort((ids[kept], exact))[:k]
        found.append((kept[order], exact[order]))
    return found


def _table(own: np.ndarray, ids: np.ndarray, top: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    at = np.concatenate([t for t, _ in top]).astype(np.int64) if top else np.zeros(0, np.int64)
    score = np.concatenate([s for _, s in top]) if top else np.zeros(0)
    return pd.DataFrame({"query_id": np.repeat(own, [len(t) for t, _ in top]), "vec_id": ids[at], "score": score})


def _few(rows: DataFrame, n: int, seed: int) -> pd.DataFrame:
    """At most n rows, by a hash of the id."""
    return rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(n).select("vec_id", "vector").toArrow().to_pandas().drop_duplicates("vec_id")


def exact(rows: DataFrame, dim: int, queries: pd.DataFrame, k: int) -> DataFrame:
    """The k nearest rows of a bounded table of queries, over all rows."""
    asked, own = vectors.matrix(queries["vector"], dim), queries["vec_id"].to_numpy()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.drop_duplicates("vec_id").sort_values("vec_id")
            ids = frame["vec_id"].to_numpy()
            yield _table(own, ids, nearest(asked, own, ids, vectors.matrix(frame["vector"], dim), k))

    found = rows.select("vec_id", "vector").mapInPandas(run, vectors.result_schema(T.DoubleType()))
    return vectors.best(found.distinct(), k, largest=False)


def calibrated(tree: Tree, rows: DataFrame, dim: int, k: int, recall: float) -> int:
    """The least number of leaf visits at which the calibration queries find the wanted share of true neighbours."""
    queries = _few(rows, CALIBRATION, 2)
    truth = exact(rows, dim, queries, k).select("query_id", "vec_id")
    homes = truth.join(rows.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").toPandas()
    order = tree.visits(vectors.matrix(queries["vector"], dim), tree.leaves)
    place = {q: {leaf: i for i, leaf in enumerate(o)} for q, o in zip(queries["vec_id"].tolist(), order, strict=True)}
    needed = sorted(place[q][leaf] + 1 for q, leaf in zip(homes["query_id"].tolist(), homes["leaf"].tolist(), strict=True))
    if not needed:
        return tree.leaves
    visits = 1
    while visits < tree.leaves and np.searchsorted(needed, visits, "right") < recall * len(needed):
        visits += 1
    return visits


def search(data: DataFrame, vec_id: str, vector: str, is_query: Column, k: int, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest rows found, by Euclidean distance.

    Rows with a null id, or a vector that is null, zero or has a null or non-finite component, take no part. Only
    vectors of equal length are compared. Rows that repeat an id count once, and are no candidates of that id. With
    fewer than k rows in the visited leaves, all leaves are searched. Empty tables give no row.
    """
    need(data, vec_id, vector)
    flagged = data.select(F.col(vec_id), F.col(vector), is_query.alias("asks"))
    rows = vectors.taking_part(flagged, vec_id, vector, zero=False)
    asks = vectors.taking_part(flagged.filter("asks"), vec_id, vector, zero=False)
    # A table of vectors has one length, or few: each gets a tree of its own.
    found = [_search(rows.filter(F.col("dim") == d), asks.filter(F.col("dim") == d), d, k, recall) for (d,) in rows.select("dim").distinct().orderBy("dim").collect()]
    if not found:
        return data.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def _search(rows: DataFrame, asks: DataFrame, dim: int, k: int, recall: float) -> DataFrame:
    spark = rows.sparkSession
    tree = fit(vectors.matrix(_few(rows, SAMPLE, 1)["vector"], dim))
    shared = spark.sparkContext.broadcast(tree)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(leaf=shared.value.leaf(vectors.matrix(frame["vector"], dim)))

    kind = rows.schema["vector"].dataType.simpleString()
    homes = stored(rows.select("vec_id", "vector").mapInPandas(place, f"vec_id bigint, vector {kind}, leaf int"))
    sizes = dict(homes.groupBy("leaf").count().collect())
    visits = calibrated(tree, homes, dim, k, recall)
    # Visits widen, too, until the smallest leaves together hold enough rows.
    held = np.cumsum(sorted(sizes.get(i, 0) for i in range(tree.leaves)))
    visits = max(visits, min(tree.leaves, int(np.searchsorted(held, k + 1)) + 1))

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.drop_duplicates("vec_id")
            yield frame.assign(leaf=shared.value.visits(vectors.matrix(frame["vector"], dim), visits))

    asked = stored(asks.select("vec_id", "vector").mapInPandas(choose, f"vec_id bigint, vector {kind}, leaf array<int>"))
    asked = asked.withColumn("leaf", F.explode("leaf"))
    counts = dict(asked.groupBy("leaf").count().collect())
    blocks = F.element_at(F.array(*(F.lit(max(1, -(-sizes.get(i, 0) // BLOCK))) for i in range(tree.leaves))), F.col("leaf") + 1)
    parts = F.element_at(F.array(*(F.lit(max(1, -(-counts.get(i, 0) // QUERIES))) for i in range(tree.leaves))), F.col("leaf") + 1)
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = homes.withColumn("block", deal(blocks)).withColumn("part", each(parts))
    right = asked.withColumn("part", deal(parts)).withColumn("block", each(blocks))

    def tile(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found, wanted = (x.drop_duplicates("vec_id").sort_values("vec_id") for x in (found, wanted))
        ids, own = found["vec_id"].to_numpy(), wanted["vec_id"].to_numpy()
        if not len(ids) or not len(own):
            return _table(own[:0], ids, [])
        return _table(own, ids, nearest(vectors.matrix(wanted["vector"], dim), own, ids, vectors.matrix(found["vector"], dim), k))

    keys = ("leaf", "block", "part")
    tiles = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(tile, vectors.result_schema(T.DoubleType()))
    return vectors.best(tiles, k, largest=False)
