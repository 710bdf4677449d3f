"""GeoJSON documents cut into byte ranges."""

import json
import os
import random

import pytest
from pyspark.errors import PySparkException

from listingmart.sources import json_objects
from listingmart.sources.geojson import read_districts

NASTY = ['a "quoted" } name', "back\\slash\\", 'ends in \\"', "[{", "Łódź ]", "{\"type\": \"Feature\"}", "", "\\\\", "tab\tline\n"]


def document(n, seed):
    """A FeatureCollection whose texts hold brackets, quotes and backslashes; foreign members around the features."""
    draw = random.Random(seed)
    features = []
    for i in range(n):
        ring = [[draw.uniform(20, 22), draw.uniform(51, 53)] for _ in range(draw.randint(3, 30))]
        ring.append(ring[0])
        hole = [[21.0, 52.0], [21.1, 52.0], [21.1, 52.1], [21.0, 52.0]]
        shape = [
            {"type": "Polygon", "coordinates": [ring, hole]},
            {"type": "MultiPolygon", "coordinates": [[ring], [hole]]},
            {"type": "Point", "coordinates": ring[0]},
            None,
        ][draw.choice((0, 0, 1, 1, 2, 3))]
        name = f"{draw.choice(NASTY)} {i}"
        members = [("type", "Feature"), ("properties", {"name": name, "note": {"type": "Feature", "x": [{"y": "}"}]}}), ("geometry", shape)]
        draw.shuffle(members)
        features.append(dict(members))
    crs = {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}
    members = [("type", "FeatureCollection"), ("features", features), ("crs", crs), ("title", 'a "{" b'), ("history", [{"type": "Note", "properties": {"name": "no"}}])]
    draw.shuffle(members)
    return dict(members)


def expected(doc):
    found = []
    for f in doc["features"]:
        if f["geometry"] and f["geometry"]["type"] in ("Polygon", "MultiPolygon"):
            rings = f["geometry"]["coordinates"]
            found.append((f["properties"]["name"], rings if f["geometry"]["type"] == "Polygon" else sum(rings, [])))
    return sorted(found)


def save(folder, text, name="districts.json"):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)
    return f"{folder}/{name}"


@pytest.mark.parametrize("step", [1, 2, 3, 7, 64, 1000, 1 << 20])
def test_ranges_of_any_size_find_the_same_objects(folder, step):
    """Without Spark: the two reads and the sums between them, for ranges down to one byte."""
    text = json.dumps(document(12, step), indent=step % 3 or None, ensure_ascii=step % 2 == 0)
    path = save(folder, text)
    reader = json_objects.RangeReader({"path": f"file:{path}", "range_bytes": str(step)})
    reader.size = max(step, -(-len(text.encode()) // 4000))
    depth, in_string, found = 0, False, []
    for part in reader.partitions():
        for where, start, end, flips, outside, inside in reader.read(part):
            with json_objects.opened(f"file:{where}")[0].open_input_file(where) as raw:
                found += json_objects.Document(raw).objects(start, end, depth, in_string)
            depth, in_string = depth + (inside if in_string else outside), in_string != flips
    assert (depth, in_string) == (0, False)
    whole = json.loads(text)
    features = [json.loads(t) for level, t in found if level == 2 and json.loads(t).get("type") == "Feature"]
    assert features == whole["features"]
    assert [json.loads(t) for level, t in found if level == 1] == [v for v in whole.values() if isinstance(v, dict)]


def test_districts_of_a_document_in_ranges(spark, folder):
    doc = document(300, 5)
    path = save(folder, json.dumps(doc, indent=1))
    read = read_districts(spark, path, range_bytes=5000)
    assert sorted((r["name"], r["rings"]) for r in read.collect()) == expected(doc)
    assert read.rdd.getNumPartitions() == -(-os.path.getsize(path) // 5000)
    assert sorted((r["name"], r["rings"]) for r in read_districts(spark, path).collect()) == expected(doc)


def test_folder_of_documents(spark, folder):
    docs = [document(5, 1), document(6, 2)]
    for i, doc in enumerate(docs):
        save(f"{folder}/parts", json.dumps(doc), f"{i}.json")
    save(f"{folder}/parts", "", "_SUCCESS")
    read = read_districts(spark, f"{folder}/parts", range_bytes=700)
    assert sorted((r["name"], r["rings"]) for r in read.collect()) == sorted(expected(docs[0]) + expected(docs[1]))


def test_broken_documents(spark, folder):
    whole = json.dumps(document(5, 3))
    with pytest.raises(ValueError, match="Not a complete JSON document"):
        read_districts(spark, save(folder, whole[:-1]), range_bytes=300)
    with pytest.raises(ValueError, match="has a property"):
        read_districts(spark, save(folder, '{"type": "FeatureCollection", "features": []}', "empty.json"))
    with pytest.raises((ValueError, PySparkException)):
        read_districts(spark, f"{folder}/absent.json")
