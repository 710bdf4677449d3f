"""Point-in-polygon assignment of listings to districts.

A quadtree is laid over the layer's extent: a cell splits while it holds too many polygon edges, so that clustered or very
detailed polygons get small cells and the rest large ones. Splitting works on rows of edges, level by level. Of every
cell and polygon that meet, the layer knows the cell's edges and whether the cell's upper right corner lies inside. A point is
inside if a path from it to that corner, first to the right, then upwards, crosses an odd number of the cell's edges
(or an even one from an outer corner). So a point meets the edges of its own cell only.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingmart.functions.coercion import slug
from listingmart.schema import CITY
from listingmart.sources.tables import work_folder

# Cells of up to so many edges are not split; in layers with many edges cells may hold their hundred-thousandth part.
EDGES_PER_CELL = 32
MOST_PARTS = 100_000
# A cell that is split has so many children in each direction (a power of two).
SPLIT = 4
# Cells are at most halved so often in each direction. More edges than the bound can only remain where they meet in a point.
MAX_DEPTH = 20
# Long edges side by side and piles of polygons enter ever more cells as these shrink. The splitting ends with the step that
# makes more rows than so many times the layer's edges; cells then hold more edges, which costs time only.
GROWTH = 16
# The cell table is broadcast while it holds at most this many polygon edges (32 bytes each), its keys up to this number.
MAX_BROADCAST_EDGES = 500_000
MAX_BROADCAST_CELLS = 2_000_000
# Above that it is joined by shuffle; the points of one cell are spread over this many salts.
SALTS = 64
# Cells reach a little beyond their borders, so that no rounding separates a point from an edge that it is next to.
MARGIN = 1e-9


@dataclass(frozen=True)
class DistrictLayer:
    """Cells of a polygon layer: ``_depth, _cell, kx, ky, candidates``. ``_cell`` numbers the cells of a depth."""

    cells: DataFrame
    edges: int
    n_cells: int
    depths: tuple[int, ...]
    x0: float
    y0: float
    width: float
    height: float

    def cell(self, x: str, y: str, depth: int) -> Column:
        """Number of the cell of a depth that a point lies in; null outside the layer."""
        side = 1 << depth
        ix = f"floor(({x} - {self.x0!r}D) / {self.width / side!r}D)"
        iy = f"floor(({y} - {self.y0!r}D) / {self.height / side!r}D)"
        inside = f"{ix} BETWEEN 0 AND {side - 1} AND {iy} BETWEEN 0 AND {side - 1}"
        return F.expr(f"CASE WHEN {inside} THEN cast({ix} AS bigint) * {side} + cast({iy} AS bigint) END")


# Edges of all rings of a polygon, each from its lower end to its upper one (a level one to the right); rings are closed.
EDGES = """filter(flatten(transform(rings, ring -> transform(
  ring, (p, i) -> array_sort(array(
    struct(get(p, 1) AS y, get(p, 0) AS x),
    struct(get(get(ring, (i + 1) % size(ring)), 1) AS y, get(get(ring, (i + 1) % size(ring)), 0) AS x)))))),
  e -> get(e, 0).x IS NOT NULL AND get(e, 0).y IS NOT NULL AND get(e, 1).x IS NOT NULL AND get(e, 1).y IS NOT NULL)"""
ENDS = ("x1", "y1", "x2", "y2")


def _side(x: str, y: str, e: str) -> str:
    return f"((({e}x2 - {e}x1) * ({y} - {e}y1)) - (({e}y2 - {e}y1) * ({x} - {e}x1)))"


def _left(x: str, y: str, e: str) -> str:
    """Whether a point lies left of an edge (above a level one). A point on the edge's line counts as moved up a little, and
    to the right by even less; the tests for crossings move it alike."""
    side = _side(x, y, e)
    return f"({side} > 0 OR ({side} = 0 AND {e}x2 > {e}x1))"


def _crosses(x: str, y: str, kx: str, ky: str, e: str = "") -> str:
    """Whether an edge crosses the path from (x, y) to the right or left to kx and from there up or down to ky an odd number of times."""
    across = f"(({e}y1 > {y}) != ({e}y2 > {y}) AND {_left(x, y, e)} != {_left(kx, y, e)})"
    up = f"(({e}x1 > {kx}) != ({e}x2 > {kx}) AND {_left(kx, y, e)} != {_left(kx, ky, e)})"
    return f"({across} != {up})"


def _meets(xa: str, ya: str, xb: str, yb: str) -> str:
    """Whether an edge may have a point in a rectangle."""
    corners = [_side(x, y, "") for x in (xa, xb) for y in (ya, yb)]
    return (
        f"(least(x1, x2) <= {xb} AND greatest(x1, x2) >= {xa} AND y1 <= {yb} AND y2 >= {ya} "
        f"AND least({', '.join(corners)}) <= 0 AND greatest({', '.join(corners)}) >= 0)"
    )


def _edges(polygons: DataFrame, name_col: str, city: str) -> DataFrame:
    """``shape, district, x1, y1, x2, y2``: edges of the named polygons, of equal polygons once."""
    shapes = polygons.filter(F.lower(F.col(name_col)) != city).select(slug(name_col).alias("district"), "rings")
    rows = shapes.dropDuplicates().select(F.xxhash64("district", "rings").alias("shape"), "district", F.explode(F.expr(EDGES)).alias("e"))
    return rows.selectExpr("shape", "district", "e[0].x AS x1", "e[0].y AS y1", "e[1].x AS x2", "e[1].y AS y2")


def build_layer(
    polygons: DataFrame, *, name_col: str = "name", city: str = CITY, edges_per_cell: int = EDGES_PER_CELL, growth: float = GROWTH
) -> DistrictLayer:
    """Quadtree of a layer of ``name, rings`` polygons (``rings`` = array of [lon, lat] rings; holes and further parts are
    just more rings). The polygon named as the whole city and polygons without a name drop out. The levels of the tree are
    stored below the work folder; the driver learns their counts only."""
    if name_col not in polygons.columns:
        raise ValueError(f"Polygons have no column '{name_col}', only {polygons.columns}")
    spark = polygons.sparkSession
    folder = f"{work_folder(spark)}/layer-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    edges = stored(_edges(polygons, name_col, city), "edges")
    n, xa, xb, ya, yb = edges.selectExpr("count(1)", "min(least(x1, x2))", "max(greatest(x1, x2))", "min(y1)", "max(y2)").first()
    if not n:
        raise ValueError("The districts layer has no named polygon.")
    # A rim around the extent: the corner of the outermost cell lies outside all polygons.
    rim_x, rim_y = ((b - a) * 1e-6 or 1e-6 for a, b in ((xa, xb), (ya, yb)))
    x0, y0, width, height = xa - rim_x, ya - rim_y, xb - xa + 2 * rim_x, yb - ya + 2 * rim_y
    most = max(edges_per_cell, n // MOST_PARTS)

    # The children of a cell are numbered; the path from a child's corner leads to its parent's. The depth is a column,
    # so that all levels run the same compiled code.
    w, h = (f"({size!r}D / shiftleft(1L, depth))" for size in (width, height))
    parts = ", ".join(f"struct({SPLIT} * ix + {i} AS ix, {SPLIT} * iy + {j} AS iy)" for i in range(SPLIT) for j in range(SPLIT))
    child = [f"explode(array({parts})) AS c", "shape", "district"]
    right, top = f"({x0!r}D + (c.ix + 1) * {w})", f"({y0!r}D + (c.iy + 1) * {h})"
    far, high = f"({x0!r}D + {SPLIT} * (c.ix div {SPLIT} + 1) * {w})", f"({y0!r}D + {SPLIT} * (c.iy div {SPLIT} + 1) * {h})"
    mx, my = f"{MARGIN * width!r}D", f"{MARGIN * height!r}D"
    rectangle = f"({x0!r}D + c.ix * {w} - {mx})", f"({y0!r}D + c.iy * {h} - {my})", f"({right} + {mx})", f"({top} + {my})"

    cell = ["ix", "iy"]
    open_edges = edges.selectExpr("0L AS ix", "0L AS iy", "0 AS depth", "*")
    open_refs = edges.selectExpr("0L AS ix", "0L AS iy", "0 AS depth", "shape", "district", "0 AS odd", "1L AS n").distinct()
    leaves = [] if n > most else [(0, open_edges, open_refs)]
    depth = 0
    while n > most:
        depth += SPLIT.bit_length() - 1
        below = f"depth + {SPLIT.bit_length() - 1} AS depth"
        cut = open_edges.selectExpr(*child, below, *ENDS).selectExpr(
            "c.ix", "c.iy", "depth", "shape", "district", *ENDS,
            f"cast({_crosses(right, top, far, high)} AS int) AS odd", f"{_meets(*rectangle)} AS here",
        )
        inherited = open_refs.selectExpr(*child, below, "odd").selectExpr("c.ix", "c.iy", "depth", "shape", "district", "odd", "false AS here")
        refs = (
            cut.select(inherited.columns).unionByName(inherited)
            .groupBy(*cell, "depth", "shape", "district")
            .agg(F.expr("bit_xor(odd) AS odd"), F.count_if("here").alias("n"))
            .filter("n > 0 OR odd = 1")
        )
        open_edges, open_refs = stored(cut.filter("here").drop("odd", "here"), f"edges-{depth}"), stored(refs, f"corners-{depth}")
        full = open_refs.groupBy(cell).agg(F.sum("n").alias("held")).filter(F.col("held") > most).select(cell)
        rows = open_edges.count() + open_refs.count()
        n_full = full.count() if depth < MAX_DEPTH and rows <= growth * n else 0
        if not n_full:
            leaves.append((depth, open_edges, open_refs))
            break
        if n_full <= MAX_BROADCAST_CELLS:
            full = F.broadcast(full)
        leaves.append((depth, open_edges.join(full, cell, "left_anti"), open_refs.join(full, cell, "left_anti")))
        open_edges, open_refs = open_edges.join(full, cell, "left_semi"), open_refs.join(full, cell, "left_semi")

    cells = stored(reduce(DataFrame.unionByName, (
        _candidates(*leaf, x0, y0, width, height) for leaf in leaves
    )), "cells")
    held, n_cells = cells.agg(F.coalesce(F.sum("n_edges"), F.lit(0)), F.count(F.lit(1))).first()
    depths = tuple(r[0] for r in cells.select("_depth").distinct().orderBy("_depth").collect())
    return DistrictLayer(cells.drop("n_edges"), held, n_cells, depths, x0, y0, width, height)


def _candidates(depth: int, edges: DataFrame, refs: DataFrame, x0: float, y0: float, width: float, height: float) -> DataFrame:
    """One row per cell: its polygons by name with their edges there. Of polygons that cover the whole cell the first by
    name is enough. A cell's edges are bounded by the splitting, but where more meet in one point or ``growth`` ended it."""
    side = 1 << depth
    # What the cell's corner alone decides of an edge's crossings is stored with the edge.
    kx, ky = f"({x0!r}D + (ix + 1) * {width / side!r}D)", f"({y0!r}D + (iy + 1) * {height / side!r}D)"
    turns = f"(x1 > {kx}) != (x2 > {kx}) AS turns", f"{_left(kx, ky, '')} AS corner"
    lines = edges.selectExpr("ix", "iy", "shape", "district", "0 AS odd", f"struct({', '.join((*ENDS, *turns))}) AS edge")
    corners = refs.filter("n > 0").selectExpr("ix", "iy", "shape", "district", "odd", "NULL AS edge")
    cut = (
        lines.unionByName(corners)
        .groupBy("ix", "iy", "shape", "district")
        .agg(F.expr("bit_xor(odd) = 1 AS odd"), F.collect_list("edge").alias("edges"))
        .selectExpr("ix", "iy", "struct(district, odd, edges) AS candidate", "size(edges) AS n")
    )
    kind = f"array<struct<{', '.join(f'{e}: double' for e in ENDS)}, turns: boolean, corner: boolean>>"
    covers = refs.filter("n = 0").groupBy("ix", "iy").agg(F.min("district").alias("district"))
    covers = covers.selectExpr("ix", "iy", f"struct(district, true AS odd, cast(array() AS {kind}) AS edges) AS candidate", "0 AS n")
    return (
        cut.unionByName(covers)
        .groupBy("ix", "iy")
        .agg(F.sum("n").alias("n_edges"), F.array_sort(F.collect_list("candidate")).alias("candidates"))
        .selectExpr(
            f"{depth} AS _depth", f"ix * {side} + iy AS _cell", f"{x0!r}D + (ix + 1) * {width / side!r}D AS kx",
            f"{y0!r}D + (iy + 1) * {height / side!r}D AS ky", "candidates", "n_edges",
        )
    )


def _first_containing(x: str, y: str) -> str:
    """SQL of the first candidate polygon around a point; a point on the boundary is not inside. Comparisons come before
    products, so that most edges of a cell cost some comparisons."""
    here, below = _left(x, y, "e."), _left("_leaf.kx", y, "e.")
    crosses = f"(((e.y1 > {y}) != (e.y2 > {y}) AND {here} != {below}) != (e.turns AND {below} != e.corner))"
    touches = (
        f"{y} >= e.y1 AND {y} <= e.y2 AND {x} BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) AND {_side(x, y, 'e.')} = 0"
    )
    return f"""get(filter(_leaf.candidates, p ->
      aggregate(p.edges, p.odd, (odd, e) -> odd != {crosses})
      AND NOT exists(p.edges, e -> {touches})), 0).district"""


def assign_district(
    df: DataFrame,
    layer: DistrictLayer,
    *,
    out_col: str = "district",
    lat_col: str = "lat",
    lon_col: str = "lon",
    keep_outside: bool = True,
    broadcast_edges: int = MAX_BROADCAST_EDGES,
) -> DataFrame:
    """Left join of points with the polygon they lie in. Rows without coordinates drop out; of
    overlapping polygons the first by name wins, so a point stays one row. Points outside every
    polygon get null, or drop out with ``keep_outside=False``."""
    missing = [c for c in (lat_col, lon_col) if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    x, y = f"`{lon_col}`", f"`{lat_col}`"
    points = df.drop(out_col).dropna(subset=[lat_col, lon_col])
    leaf = F.struct("kx", "ky", "candidates").alias("_leaf")
    if layer.edges <= broadcast_edges:
        cells = layer.cells.select("_depth", "_cell", leaf)
        joined = _by_depth(points, layer, x, y, cells, "_leaf", True)
    else:
        keyed = layer.cells.select("_depth", "_cell", F.struct("_depth", "_cell").alias("_key"))
        joined = _by_depth(points, layer, x, y, keyed, "_key", layer.n_cells <= MAX_BROADCAST_CELLS)
        salt = F.expr(f"cast(pmod(xxhash64({x}, {y}), {SALTS}) AS int)")
        salted = layer.cells.select(F.struct("_depth", "_cell").alias("_key"), leaf, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        joined = joined.withColumn("_salt", salt).join(salted, ["_key", "_salt"], "left").drop("_key", "_salt")
    out = joined.withColumn(out_col, F.expr(_first_containing(x, y))).drop("_leaf")
    return out if keep_outside else out.filter(F.col(out_col).isNotNull())


def _by_depth(points: DataFrame, layer: DistrictLayer, x: str, y: str, cells: DataFrame, value: str, small: bool) -> DataFrame:
    """Points with the value of the cell that holds them: one join for each depth that has cells."""
    names = []
    for depth in layer.depths:
        names.append(f"{value}_{depth}")
        level = cells.filter(F.col("_depth") == depth).select("_cell", F.col(value).alias(names[-1]))
        points = points.withColumn("_cell", layer.cell(x, y, depth)).join(F.broadcast(level) if small else level, "_cell", "left")
    return points.withColumn(value, F.coalesce(*names)).drop("_cell", *names)
