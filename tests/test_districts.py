"""The quadtree of a district layer against brute force."""

import json
import math

import numpy as np
import pytest

from listingmart.operators import districts
from listingmart.operators.districts import assign_district, build_layer
from listingmart.sources.geojson import read_districts


def brute_force(polygons, points):
    """First name of a polygon around each point: a ray to the right, edge by edge; the boundary is outside."""
    order = sorted(range(len(polygons)), key=lambda i: polygons[i][0])
    edges, owner = [], []
    for rank, i in enumerate(order):
        for ring in polygons[i][1]:
            edges += [(*a, *b) for a, b in zip(ring, ring[1:])]
            owner += [rank] * (len(ring) - 1)
    x1, y1, x2, y2 = np.array(edges).T
    owner = np.array(owner)
    found = []
    for x, y in points:
        side = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        crosses = ((y1 > y) != (y2 > y)) & ((side > 0) == (y2 > y1))
        on = (side == 0) & (np.minimum(x1, x2) <= x) & (x <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= y) & (y <= np.maximum(y1, y2))
        odd = np.bincount(owner[crosses], minlength=len(order)) % 2 == 1
        odd[owner[on]] = False
        found.append(polygons[order[int(np.argmax(odd))]][0] if odd.any() else None)
    return found


def layer_of(spark, folder, polygons, **options):
    features = [{"type": "Feature", "properties": {"name": n}, "geometry": {"type": "Polygon", "coordinates": rings}} for n, rings in polygons]
    path = f"{folder}/layer.json"
    with open(path, "w") as f:
        json.dump({"type": "FeatureCollection", "features": features}, f)
    return build_layer(read_districts(spark, path), **options)


def compared(spark, layer, polygons, points, **options):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(points)]
    df = spark.createDataFrame(rows, "i long, lon double, lat double")
    found = [r["district"] for r in assign_district(df, layer, **options).orderBy("i").collect()]
    assert found == brute_force(polygons, points)
    return found


@pytest.mark.parametrize("seed", [1, 3])
def test_shapes_on_whole_numbers(spark, folder, seed):
    """Corners, level and upright edges on few whole numbers: points meet vertices, edges and cell borders all the time."""
    draw = np.random.default_rng(seed)
    polygons = []
    for i in range(60):
        ring = draw.integers(0, 17, (int(draw.integers(3, 9)), 2)).astype(float).tolist()
        hole = draw.integers(0, 17, (4, 2)).astype(float).tolist()
        polygons.append((f"d{i:03d}", [ring + ring[:1]] + ([hole + hole[:1]] if i % 3 == 0 else [])))
    points = [(x / 2, y / 2) for x in range(-2, 37) for y in range(-2, 37)]
    layer = layer_of(spark, folder, polygons, edges_per_cell=int(2 ** (2 + seed)), growth=1e9)
    assert len(layer.depths) >= 2
    found = compared(spark, layer, polygons, points)
    assert 100 < sum(d is not None for d in found) < len(points)
    compared(spark, layer, polygons, points, broadcast_edges=0)


def test_many_polygons_and_a_large_one(spark, folder):
    """5,000 small polygons, most of them crowded into one corner, and one of 10,000 edges over them."""
    draw = np.random.default_rng(1)
    centres = np.concatenate([draw.normal(0.2, 0.002, (4_000, 2)), draw.uniform(0, 1, (1_000, 2))])
    polygons = [
        (f"p{i:04d}", [[[x - s, y], [x, y - s], [x + s, y], [x + s / 3, y + s / 4], [x, y + s], [x - s, y]]])
        for i, ((x, y), s) in enumerate(zip(centres.tolist(), [*draw.uniform(1e-6, 2e-5, 4_000), *draw.uniform(1e-4, 3e-3, 1_000)]))
    ]
    turns = [2 * math.pi * k / 10_000 for k in range(10_000)]
    star = [[0.5 + (0.3 + 0.0002 * (k % 2)) * math.cos(a), 0.5 + (0.3 + 0.0002 * (k % 2)) * math.sin(a)] for k, a in enumerate(turns)]
    polygons.append(("star", [star + star[:1]]))
    layer = layer_of(spark, folder, polygons)
    angles, far = draw.uniform(0, 2 * math.pi, 150), draw.uniform(0.2998, 0.3004, 150)
    rim = np.stack([0.5 + far * np.cos(angles), 0.5 + far * np.sin(angles)], axis=1)
    points = np.concatenate([centres[::40], draw.uniform(-0.1, 1.1, (200, 2)), draw.normal(0.2, 0.003, (100, 2)), rim]).tolist()
    found = compared(spark, layer, polygons, points)
    assert "star" in found and None in found and len(set(found)) > 100
    compared(spark, layer, polygons, points, broadcast_edges=0)
    held = layer.cells.selectExpr("max(aggregate(candidates, 0, (n, c) -> n + size(c.edges)))").first()[0]
    assert held <= districts.EDGES_PER_CELL


def test_spikes_and_piles_end_the_splitting(spark, folder):
    """Long edges side by side, and polygons on top of each other: smaller cells would only repeat them."""
    draw = np.random.default_rng(2)
    turns = [2 * math.pi * k / 1500 for k in range(1500)]
    star = [[(0.1 + 0.9 * (k % 2)) * math.cos(a), (0.1 + 0.9 * (k % 2)) * math.sin(a)] for k, a in enumerate(turns)]
    polygons = [("star", [star + star[:1]])]
    for i, (x, y) in enumerate(draw.normal(0, 0.05, (150, 2)).tolist()):
        polygons.append((f"t{i}", [[[x - 1, y - 1], [x + 1, y - 1], [x, y + 1], [x - 1, y - 1]]]))
    layer = layer_of(spark, folder, polygons, edges_per_cell=4)
    assert max(layer.depths) < districts.MAX_DEPTH and layer.edges < 200 * 2000
    compared(spark, layer, polygons, draw.uniform(-1.2, 1.2, (500, 2)).tolist())


def test_edges_that_meet_in_a_point_end_the_splitting(spark, folder):
    """Slices of a pie: no cell around the middle can hold few edges."""
    cut = [(math.cos(2 * math.pi * k / 40), math.sin(2 * math.pi * k / 40)) for k in range(41)]
    polygons = [(f"s{k:02d}", [[[0.0, 0.0], list(cut[k]), list(cut[k + 1]), [0.0, 0.0]]]) for k in range(40)]
    layer = layer_of(spark, folder, polygons, edges_per_cell=8)
    assert max(layer.depths) == districts.MAX_DEPTH
    points = [(0.5 * math.cos(a), 0.5 * math.sin(a)) for a in np.linspace(0.01, 6.2, 97)] + [(0.0, 0.0), (1e-7, 1e-8), (2.0, 0.0)]
    assert len(set(compared(spark, layer, polygons, points))) > 39


def test_open_rings_equal_polygons_and_odd_coordinates(spark):
    rows = "('A', array(array(array(0D,0D), array(4D,0D), array(4D,4D), array(0D,4D))))"
    rows = f"{rows}, {rows}, ('B', array(array(array(9D, 9D)), array(), array(array(5D, CAST(NULL AS DOUBLE)), array(6D, 1D))))"
    layer = build_layer(spark.sql(f"SELECT * FROM VALUES {rows} AS t(name, rings)"))
    points = spark.createDataFrame([(1.0, 1.0), (4.0, 1.0), (9.0, 9.0), (5.0, 1.0), (float("inf"), 1.0)], "lon double, lat double")
    assert [r["district"] for r in assign_district(points, layer).collect()] == ["a", None, None, None, None]
