"""Exact interpolated quantiles that stay distributed when one group holds most of the rows.

The built-in exact percentile keeps every distinct value of a group in one task. Here a group is
first folded to a histogram of distinct values (pre-aggregated before its shuffle, spread by value),
then to coarse buckets whose number does not depend on the data size. Running counts over the
buckets tell which of them hold the wanted ranks. Each of those is cut linearly between its least and
its largest value, counted again and narrowed to the cuts that hold a rank, `LEVELS` times; a bucket
has no more doubles than that many cuts tell apart but for a few thousand, so no task ever sorts more
than `CUTS` rows of a group, whatever the values. A copied value is one histogram row however often it
occurs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Buckets per unit of natural logarithm: one bucket spans about 0.1 % of its values' size.
BUCKETS_PER_LOG_UNIT = 1024
# Further from zero than any logarithm of a double times the resolution.
LOG_SPAN = 1000 * BUCKETS_PER_LOG_UNIT
NULL_BUCKET = -10 * LOG_SPAN

# A bucket that holds a rank is cut into so many parts, so many times. A coarse bucket spans at most 2^43
# doubles; after two cuts a part spans about 2^13.
CUTS = 1 << 15
LEVELS = 2

# Where rank targets are joined by shuffle, the values of a bucket are spread over so many tasks.
SALTS = 16

# Most rank targets that may be broadcast to the histogram side.
MAX_BROADCAST_TARGETS = 100_000


def coarse_bucket(v: str) -> str:
    """SQL of a bucket number that never decreases as ``v`` grows; at most three million different."""

    def magnitude(positive: str) -> str:
        return f"cast(floor(least(ln({positive}) * {BUCKETS_PER_LOG_UNIT}, {LOG_SPAN}D)) AS bigint) + {2 * LOG_SPAN}"

    # Never null, so that the join below adds no null filter that would make its scan a second one.
    return (
        f"coalesce(CASE WHEN {v} > 0 THEN {magnitude(v)} WHEN {v} < 0 THEN -({magnitude('-' + v)}) "
        f"WHEN {v} = 0 THEN 0L END, {NULL_BUCKET}L)"
    )


def value_histogram(
    df: DataFrame,
    values: Mapping[str, Column | str],
    keys: Sequence[str] = (),
    *,
    null_keys: bool = False,
) -> DataFrame:
    """``keys, metric, v, n``: how often each distinct value occurs. Rows with a null key drop out,
    unless ``null_keys`` makes null a group like any other."""
    df = df.dropna(subset=list(keys)) if keys and not null_keys else df
    columns = [F.col(v) if isinstance(v, str) else v for v in values.values()]
    narrow = df.select(*keys, *(c.alias(f"_v{i}") for i, c in enumerate(columns)))
    pairs = ", ".join(f"'{name}', cast(_v{i} AS double)" for i, name in enumerate(values))
    long = narrow.selectExpr(*quoted(keys), f"stack({len(columns)}, {pairs}) AS (metric, v)")
    return long.groupBy(*keys, "metric", "v").agg(F.expr("count(1) AS n"))


def quoted(names: Sequence[str]) -> list[str]:
    return [f"`{name}`" for name in names]


def histogram_quantiles(
    hist: DataFrame,
    probs: Mapping[str, float],
    keys: Sequence[str] = (),
    *,
    max_groups: int | None = None,
) -> DataFrame:
    """One row per group of a ``keys, v, n`` histogram: n_rows, n, mean, min, max and the quantiles.

    ``n`` counts non-null values. A group of nulls only is kept, with null statistics.
    ``max_groups`` is a bound on the number of groups that the caller can prove; with it the rank
    targets may be broadcast, without it they are joined by shuffle.
    """
    names = quoted(keys)
    group = f"PARTITION BY {', '.join(names)}"
    low = {name: f"cast(floor((total - 1) * {float(p)!r}D) AS bigint)" for name, p in probs.items()}
    high = {name: f"cast(ceil((total - 1) * {float(p)!r}D) AS bigint)" for name, p in probs.items()}
    ranks = dict.fromkeys((*low.values(), *high.values()))

    # ``w`` is the number of non-null values behind a histogram row. Group and bucket are joined as
    # one struct: on plain keys Spark may prune partitions of one of the two scans of the histogram,
    # and then computes it twice.
    fine = hist.selectExpr(
        *names, "v", "n", "if(v IS NULL, 0L, n) AS w", f"{coarse_bucket('v')} AS bucket"
    )
    coarse = fine.groupBy(*keys, "bucket").agg(
        F.expr("sum(n) AS b_rows"),
        F.expr("sum(w) AS b_n"),
        F.expr("count(1) AS b_values"),
        F.expr("sum(v * n) AS b_sum"),
        F.expr("min(v) AS b_min"),
        F.expr("max(v) AS b_max"),
    )
    ranked = coarse.selectExpr(
        f"struct({', '.join([*names, 'bucket'])}) AS cell",
        "b_n",
        "b_values",
        "b_min AS lo",
        "b_max AS hi",
        f"sum(b_n) OVER ({group} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS through",
        f"sum(b_rows) OVER ({group}) AS n_rows",
        f"sum(b_n) OVER ({group}) AS total",
        f"sum(b_sum) OVER ({group}) AS total_sum",
        f"min(b_min) OVER ({group}) AS min",
        f"max(b_max) OVER ({group}) AS max",
    )
    few = max_groups is not None and max_groups * (2 * len(probs) + 1) <= MAX_BROADCAST_TARGETS
    held = " OR ".join(f"({r} >= through - b_n AND {r} < through)" for r in ranks)
    stats = ("n_rows", "total", "total_sum", "min", "max")

    # Targets are (cell, b_values, before, lo, hi, statistics): an interval of values in a bucket that
    # holds a rank, and how many values of its group come before it. Intervals of a bucket do not overlap.
    def holding_rank(counted: DataFrame) -> DataFrame:
        return counted.filter(f"total = 0 OR {held}").selectExpr("cell", "b_values", "through - b_n AS before", "lo", "hi", *stats)

    cells = fine.selectExpr(f"struct({', '.join([*names, 'bucket'])}) AS cell", "v", "w")

    def within(targets: DataFrame) -> DataFrame:
        """Histogram rows with the target interval they lie in."""
        inside = F.expr("(v >= lo AND v <= hi) OR (v IS NULL AND total = 0)")
        targets = targets.drop("b_values")
        if few:
            right = F.broadcast(targets.withColumnRenamed("cell", "t_cell"))
            return cells.join(right, (F.col("cell") == F.col("t_cell")) & inside).drop("t_cell")
        left = cells.selectExpr("*", f"struct(cell, pmod(hash(v), {SALTS})) AS part")
        salts = f"explode(sequence(0, {SALTS - 1})) AS salt"
        right = targets.selectExpr("*", salts).selectExpr("struct(cell, salt) AS t_part", "before", "lo", "hi", *stats)
        return left.join(right, (F.col("part") == F.col("t_part")) & inside).drop("part", "t_part")

    # Only intervals with too many values are cut; where there are none, adaptive execution finds the
    # cuts' input empty and leaves their stages out.
    targets = holding_rank(ranked)
    narrow = targets.filter(f"b_values <= {CUTS}")
    share = f"if(hi - lo > 0 AND hi - lo < double('inf'), floor((v - lo) / (hi - lo) * {CUTS}), 0L)"
    for level in range(LEVELS):
        cut = within(targets.filter(f"b_values > {CUTS}")).selectExpr("*", f"least({share}, {CUTS - 1}L) AS cut")
        counted = cut.groupBy("cell", "lo", "cut").agg(
            F.expr("sum(w) AS b_n"),
            F.expr("count(1) AS b_values"),
            F.expr("min(v) AS c_min"),
            F.expr("max(v) AS c_max"),
            *(F.expr(f"max({c}) AS {c}") for c in ("before", *stats)),
        )
        targets = holding_rank(
            counted.selectExpr(
                "cell",
                "c_min AS lo",
                "c_max AS hi",
                "b_n",
                "b_values",
                "before + sum(b_n) OVER (PARTITION BY cell, lo ORDER BY cut ROWS UNBOUNDED PRECEDING) AS through",
                *stats,
            )
        )
        narrow = narrow.unionByName(targets if level == LEVELS - 1 else targets.filter(f"b_values <= {CUTS}"))

    running = "sum(w) OVER (PARTITION BY cell, lo ORDER BY v ROWS UNBOUNDED PRECEDING)"
    own = [f"cell.{n} AS {n}" for n in names]
    placed = within(narrow).selectExpr(*own, *stats, "v", "w", f"before + {running} AS through")
    at_rank = [f"max(if({r} >= through - w AND {r} < through, v, NULL)) AS at{i}" for i, r in enumerate(ranks)]
    picked = placed.groupBy(*keys).agg(
        *(F.expr(e) for e in (*(f"max({s}) AS {s}" for s in stats), *at_rank))
    )

    column = {r: f"at{i}" for i, r in enumerate(ranks)}

    def interpolated(name: str) -> str:
        lo, hi = column[low[name]], column[high[name]]
        share = f"((total - 1) * {float(probs[name])!r}D - {low[name]})"
        return f"if({lo} = {hi}, {lo}, {lo} + ({hi} - {lo}) * {share}) AS `{name}`"

    return picked.selectExpr(
        *names,
        "n_rows",
        "total AS n",
        "try_divide(total_sum, total) AS mean",
        "min",
        "max",
        *(interpolated(name) for name in probs),
    )


def quantiles(
    df: DataFrame,
    values: Mapping[str, Column | str],
    probs: Mapping[str, float],
    keys: Sequence[str] = (),
    *,
    max_groups: int | None = None,
    null_keys: bool = False,
) -> DataFrame:
    """Statistics of several columns in one pass: one row per group and metric.

    Without keys the number of groups is the number of metrics, so it needs no bound.
    """
    if not keys:
        max_groups = 1
    return histogram_quantiles(
        value_histogram(df, values, keys, null_keys=null_keys),
        probs,
        [*keys, "metric"],
        max_groups=None if max_groups is None else max_groups * len(values),
    )


def quantiles_of(
    df: DataFrame,
    value: Column | str,
    probs: Mapping[str, float],
    keys: Sequence[str] = (),
    *,
    max_groups: int | None = None,
    null_keys: bool = False,
) -> DataFrame:
    """Statistics of one column: one row per group."""
    found = quantiles(df, {"value": value}, probs, keys, max_groups=max_groups, null_keys=null_keys)
    return found.drop("metric")
