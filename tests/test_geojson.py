"""Feature collections in blocks of a few bytes, against the json module."""

import json
import random

import pytest

from tessella.sources import geojson, raster


def collection(rng, n, crs):
    features = []
    for k in range(n):
        ring = [[rng.randint(0, 9), rng.random()] for _ in range(3)]
        kind = rng.choice(["Polygon", "MultiPolygon", "Point"])
        shape = {"Polygon": [ring], "MultiPolygon": [[ring], [ring, ring]], "Point": [1, 2]}[kind]
        odd = rng.choice(['a"b', "\\", '\\"}', '{"type":"Feature"}', "é🎵]", '"crs": {', "", {"a": [{"b": "]}"}]}])
        parts = [("type", "Feature"), ("properties", {"name": odd, 'k"\\': None}), ("geometry", {"type": kind, "coordinates": shape})]
        rng.shuffle(parts)
        features.append(dict(parts))
    out = [("type", "FeatureCollection"), ("features", features), ("bbox", [1, 2]), ("other", {"crs": {"properties": {"name": "no"}}})]
    if crs:
        out.append(("crs", {"type": "name", "properties": {"name": crs}}))
    rng.shuffle(out)
    return dict(out)


def wanted(doc):
    return sorted((f["geometry"]["type"], json.dumps(f["geometry"]["coordinates"])) for f in doc["features"])


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_blocks_of_any_size(spark, tmp_path, block):
    rng = random.Random(block)
    expected, systems = [], {}
    for k in range(6):
        doc = collection(rng, k * 3, rng.choice([None, "EPSG:3857"]))
        text = json.dumps(doc, indent=rng.choice([None, 1, 4]), ensure_ascii=rng.random() < 0.5)
        (tmp_path / f"f{k}.json").write_text(text, encoding="utf-8")
        expected += wanted(doc)
        systems[f"f{k}.json"] = doc.get("crs", {}).get("properties", {}).get("name")
    found = geojson.parts(spark, str(tmp_path), block)
    got = sorted((r.type, json.dumps(json.loads(r.coordinates))) for r in geojson.geometries(found).collect())
    assert got == sorted(expected)
    assert {r.file.rsplit("/", 1)[1]: r.name for r in geojson.crs_names(found).collect()} == {f: s for f, s in systems.items() if s}


def test_a_file_is_read_by_several_tasks_as_by_one(spark, tmp_path):
    rng = random.Random(1)
    (tmp_path / "big.json").write_text(json.dumps(collection(rng, 3_000, None)))
    key = lambda rings: sorted((r.ring, str(r.vertices)) for r in rings.collect())
    names, shapes = raster._whole_files(spark, str(tmp_path))
    pieces = raster.read_polygons(spark, str(tmp_path), 20_000)
    assert key(pieces) == key(raster._rings(shapes))
    assert pieces.select("pid").distinct().count() == pieces.filter("ring = 0").count()
    assert raster.polygons_system(spark, str(tmp_path), 20_000) == "EPSG:4326"


def test_lines_of_collections_and_empty_files(spark, tmp_path):
    docs = [collection(random.Random(s), 4, None) for s in range(5)]
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(d) for d in docs) + "\n")
    (tmp_path / "none.json").write_text("")
    got = geojson.geometries(geojson.parts(spark, str(tmp_path), 100)).collect()
    assert sorted((r.type, json.dumps(json.loads(r.coordinates))) for r in got) == sorted(x for d in docs for x in wanted(d))


def test_a_cut_file_raises(spark, tmp_path):
    (tmp_path / "cut.json").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type"')
    with pytest.raises(Exception, match="ends inside a feature"):
        geojson.parts(spark, str(tmp_path)).count()


def test_a_store_that_python_does_not_reach():
    assert not geojson.reachable("viewfs://store/in/a.json") and not geojson.reachable("/no/such/file.json")
