"""Raster operators against small dense arrays, and their edge cases."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import scalar
from tessella.operators import augment, clean, earlystop, focal, grid, metrics, model, mosaic, split, vector
from tessella.params import Clipping, Experiment, Grid, Split, Stopping, Windows
from tessella.plans import catalog
from tessella.sources import raster

TABLES = "/root/testdata/sf0.01"


def pixels(spark, values, name="b"):
    h, w = values.shape
    rows = [(r * w + c, r, c, float(values[r, c])) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, f"idx bigint, row bigint, col bigint, {name} double").coalesce(2)


def dense(rows, h, w, name):
    out = np.full((h, w), np.nan)
    for r in rows:
        out[r["row"], r["col"]] = r[name]
    return out


def test_windows_cover_as_slices(spark):
    a = np.arange(11 * 9, dtype=float).reshape(11, 9)
    w = Windows(4, 3)
    got = {r.wid: r.s for r in grid.explode_windows(pixels(spark, a), Grid(11, 9), w).groupBy("wid").agg(F.sum("b").alias("s")).collect()}
    cols = (9 - 4) // 3 + 1
    expected = {i * cols + j: a[i * 3 : i * 3 + 4, j * 3 : j * 3 + 4].sum() for i in range((11 - 4) // 3 + 1) for j in range(cols)}
    assert got == expected


def test_raster_shorter_than_a_window(spark):
    with pytest.raises(ValueError, match="shorter"):
        grid.explode_windows(pixels(spark, np.zeros((3, 9))), Grid(3, 9), Windows(4, 2))


@pytest.mark.parametrize("step", [4, 2, 3, 5])
def test_fraction_by_blocks_and_by_pixels(spark, step):
    rng = np.random.default_rng(step)
    a = (rng.random((13, 10)) < 0.3).astype(float)
    got = grid.window_fraction(pixels(spark, a), F.col("b") == 1, Grid(13, 10), Windows(4, step)).collect()
    assert len(got) == ((13 - 4) // step + 1) * ((10 - 4) // step + 1)
    for r in got:
        assert r.frac == a[r.wr * step : r.wr * step + 4, r.wc * step : r.wc * step + 4].mean()


@pytest.mark.parametrize("pad", [1, 4, 13])
def test_reflect_pad_and_crop(spark, pad):
    a = np.arange(20, dtype=float).reshape(5, 4)
    padded = grid.reflect_pad(pixels(spark, a), Grid(5, 4), pad)
    got = dense([{"row": r.prow, "col": r.pcol, "b": r.b} for r in padded.collect()], 5 + 2 * pad, 4 + 2 * pad, "b")
    assert np.array_equal(got, np.pad(a, pad, mode="reflect"))
    assert np.array_equal(dense(grid.crop(padded, Grid(5, 4), pad).collect(), 5, 4, "b"), a)


def test_reflected_axis_of_one(spark):
    assert grid.reflect_pad(pixels(spark, np.zeros((1, 3))), Grid(1, 3), 1).count() == 15


def test_window_pixels_match_windows(spark):
    w = Windows(3, 2)
    g = Grid(7, 5)
    table = grid.window_table(spark, g, w)
    assert table.count() == 3 * 2
    px = grid.window_pixels(table, g, w)
    assert px.count() == 6 * 9 and px.agg(F.max("idx")).first()[0] == 34


def sent_rows(df):
    """Rows of each table that the finished plan sends to all tasks."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan().finalPhysicalPlan(), []

    def walk(node):
        if node.nodeName() == "BroadcastExchange":
            found.append(node.metrics().apply("numOutputRows").value())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return found


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
def test_pixels_of_windows_are_not_sent_whole(spark):
    """Windows meet their pixels by number: what all tasks get has a row per window, not one per window and pixel."""
    w, g = Windows(16, 8), Grid(120, 80)
    px = pixels(spark, np.arange(9600.0).reshape(120, 80)).repartition(3)
    chosen = grid.window_table(spark, g, w).filter("wid % 3 = 0")
    old = grid.window_pixels(chosen, g, w).join(px.select("idx", "b"), "idx")
    new = grid.pixels_in(chosen.select("wid", "wr", "wc"), px, g, w)
    rows = lambda df: sorted(map(tuple, df.select("wid", "r", "c", "idx", "b").collect()))
    assert rows(new) == rows(old)
    at_scale = catalog._pixel_windows(spark, TABLES)
    n = at_scale.select("wid").distinct().count()
    assert at_scale.count() == n * 256 and all(sent <= max(n, 2_000) for sent in sent_rows(at_scale))


def test_clip_edge_cases(spark):
    flat = pixels(spark, np.full((4, 4), 0.123))
    t = clean.thresholds(flat, ["b"]).first()
    assert (t.lo, t.hi) == (0.13, 0.13)
    out = clean.clip_normalise(flat, ["b"]).select("n_b").distinct().collect()
    assert [r[0] for r in out] == [0.13]
    nan = pixels(spark, np.full((2, 2), np.nan))
    assert clean.clip_normalise(nan, ["b"]).select("n_b").distinct().first()[0] == 0.0


def test_thresholds_follow_the_histogram(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(50, 20, (40, 25)).round(3)
    how = Clipping(bins=1000, lower=0.05, upper=0.9)
    t = clean.thresholds(pixels(spark, a), ["b"], how).first()
    counts, edges = np.histogram(a, how.bins)
    share = counts.cumsum() / counts.sum()
    for got, p in ((t.lo, how.lower), (t.hi, how.upper)):
        assert abs(got - math.ceil(100 * edges[np.argmax(share >= p)]) / 100) <= 0.0100001
    masked = clean.thresholds(pixels(spark, a), ["b"], how, F.when(F.col("row") < 20, 2).otherwise(0)).first()
    assert masked.mx == a[20:].max()


def test_scan_lines_against_even_odd(spark):
    rng = np.random.default_rng(5)
    rings, g = [], Grid(20, 24)
    for pid in range(12):
        n = rng.integers(3, 7)
        rings.append((pid, [(float(x), float(y)) for x, y in zip(rng.uniform(-5, 30, n), rng.uniform(-5, 26, n))]))
    df = spark.createDataFrame(rings, "pid bigint, vertices array<struct<x: double, y: double>>")
    got = {r.idx for r in vector.burned(vector.edges(df), g).collect()}
    expected = set()
    for _, v in rings:
        for r in range(g.height):
            for c in range(g.width):
                x, y, inside = c + 0.5, r + 0.5, False
                for (x1, y1), (x2, y2) in zip(v, v[1:] + v[:1]):
                    if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                        inside = not inside
                if inside:
                    expected.add(r * g.width + c)
    assert got == expected


def test_hole_stays_open(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"type":"FeatureCollection","features":[{"geometry":{"type":"Polygon","coordinates":[[[0,0],[8,0],[8,8],[0,8],[0,0]],[[2,2],[6,2],[6,6],[2,6],[2,2]]]}}]}'
    )
    rings = raster.read_polygons(spark, str(tmp_path / "a.json"))
    assert vector.burned(vector.edges(rings), Grid(10, 10)).count() == 64 - 16
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        raster.read_polygons(spark, str(tmp_path / "none.json")).count()


def test_parts_of_multi_polygons_and_named_systems(spark, tmp_path):
    square = lambda x, y, n: f"[[[{x},{y}],[{x + n},{y}],[{x + n},{y + n}],[{x},{y + n}],[{x},{y}]]]"
    file = lambda crs, *g: '{"type":"FeatureCollection",%s"features":[%s]}' % (crs, ",".join('{"geometry":{"type":"%s","coordinates":%s}}' % x for x in g))
    both = ("MultiPolygon", f"[{square(0, 0, 3)},{square(5, 5, 2)}]")
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.json").write_text(file("", both, ("Polygon", square(0, 7, 2)), ("Point", "[1,1]")))
    (tmp_path / "a/2.json").write_text(file("", ("Polygon", square(8, 0, 1))))
    rings = raster.read_polygons(spark, str(tmp_path / "a"))
    assert rings.select("pid").distinct().count() == 4
    assert vector.burned(vector.edges(rings), Grid(10, 10)).count() == 9 + 4 + 4 + 1
    assert raster.polygons_system(spark, str(tmp_path / "a")) == "EPSG:4326"
    urn = '"crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::3857"}},'
    (tmp_path / "b.json").write_text(file(urn, ("Polygon", square(0, 0, 3))))
    assert raster.polygons_system(spark, str(tmp_path / "b.json")) == "EPSG:3857"
    moved = raster.polygons_on(spark, str(tmp_path / "b.json"), "EPSG:4326").first().vertices
    assert 0 < moved[2]["x"] < 1e-4
    with pytest.raises(ValueError):
        raster.polygons_on(spark, str(tmp_path / "b.json"), "EPSG:32723")


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-46.6, -23.5)], "x double, y double")
    x, y = vector.reproject(F.col("x"), F.col("y"), "EPSG:4326", "EPSG:3857")
    back = vector.reproject(F.col("mx"), F.col("my"), "EPSG:3857", "EPSG:4326")
    r = df.select("*", x.alias("mx"), y.alias("my")).select(back[0].alias("x"), back[1].alias("y")).first()
    assert abs(r.x + 46.6) < 1e-9 and abs(r.y + 23.5) < 1e-9
    with pytest.raises(ValueError):
        vector.reproject(F.col("x"), F.col("y"), "EPSG:4326", "EPSG:32723")


def test_split_sizes_and_disjointness(spark):
    windows = spark.range(137).select(F.col("id").alias("wid"), F.lit(0.5).alias("frac"))
    parts = split.split(windows, Split()).collect()
    n_test = int(0.2 * 137)
    n_val = int(0.2 * (137 - n_test))
    sizes = {s: sum(r.split == s for r in parts) for s in ("test", "val", "train")}
    assert sizes == {"test": n_test, "val": n_val, "train": 137 - n_test - n_val}
    assert sorted(r.rank for r in parts) == list(range(1, 138)) and len({r.wid for r in parts}) == 137
    separate = split.split(windows, Split(mode="separate"))
    assert {r.split: r.n for r in split.counts(separate).collect()} == {"val": 27, "train": 110}
    assert split.split(windows.limit(0), Split()).count() == 0


def test_mosaic_is_a_mean_of_means(spark):
    h, w, size = 10, 9, 4
    a = np.zeros((h, w))
    g = Grid(h, w)
    score = (F.col("wr") * 5 + F.col("wc") * 3) % 4 / 4
    got = mosaic.average(mosaic.window_votes(pixels(spark, a), g, size, (0.0, 0.25, 0.5), {"p1": score}), ["p1"], (0.0, 0.25, 0.5)).collect()
    total = np.zeros((h, w))
    for overlap in (0.0, 0.25, 0.5):
        s = int(size * (1 - overlap))
        sums, counts = np.zeros((h + 2 * size, w + 2 * size)), np.zeros((h + 2 * size, w + 2 * size))
        for i in range((h + 2 * size - size) // s + 1):
            for j in range((w + 2 * size - size) // s + 1):
                sums[i * s : i * s + size, j * s : j * s + size] += (i * 5 + j * 3) % 4 / 4
                counts[i * s : i * s + size, j * s : j * s + size] += 1
        inner = (slice(size, size + h), slice(size, size + w))
        assert counts[inner].min() >= 1
        total += sums[inner] / counts[inner]
    for r in got:
        assert abs(r.p1 - total[r.idx // w, r.idx % w] / 3) < 1e-12
    assert len(got) == h * w


def test_truncated_votes_and_ties(spark):
    df = spark.createDataFrame([(0.51,), (0.9999999,), (1.0,)], "p double")
    assert [r[0] for r in df.select(scalar.truncated(F.col("p"))).collect()] == [0.0, 0.0, 1.0]
    assert df.select(scalar.argmax(F.array(F.lit(0.5), F.lit(0.5)))).first()[0] == 0


@pytest.mark.parametrize("turns", range(4))
def test_quarter_turns(spark, turns):
    a = np.arange(25).reshape(5, 5)
    r, c = augment.turned(F.col("row"), F.col("col"), 5, F.lit(turns))
    rows = pixels(spark, a.astype(float)).select(r.alias("row"), c.alias("col"), "b").collect()
    assert np.array_equal(dense(rows, 5, 5, "b"), np.rot90(a, turns))


def test_augmentation_moves_every_pixel_once(spark):
    px = pixels(spark, np.arange(16.0).reshape(4, 4)).crossJoin(spark.range(20).withColumnRenamed("id", "wid"))
    px = px.select("wid", F.col("row").alias("r"), F.col("col").alias("c"), "b")
    out = augment.augment(px, 4, 42, 1)
    assert out.select("wid", "r", "c").distinct().count() == 320
    assert out.filter("r < 0 or r > 3 or c < 0 or c > 3").count() == 0


@pytest.mark.parametrize("edge,mode", [("reflect", "reflect"), ("zero", "constant")])
@pytest.mark.parametrize("stride", [1, 2])
def test_focal_filter(spark, edge, mode, stride):
    rng = np.random.default_rng(1)
    a, k = rng.random((6, 7)), rng.random((3, 3))
    out = focal.focal3x3(pixels(spark, a), Grid(6, 7), k.tolist(), "b", stride, edge).collect()
    p = np.pad(a, 1, mode=mode)
    full = np.array([[(p[r : r + 3, c : c + 3] * k).sum() for c in range(7)] for r in range(6)])[::stride, ::stride]
    assert len(out) == full.size
    assert np.allclose(dense(out, *full.shape, "value"), full)


def test_upsample(spark):
    a = np.arange(6.0).reshape(2, 3)
    out = focal.upsample2(pixels(spark, a), Grid(2, 3), ["b"]).collect()
    assert np.array_equal(dense(out, 4, 6, "b"), a.repeat(2, 0).repeat(2, 1))


def slow_early_stop(values, rule):
    best = best_epoch = None
    misses = 0
    for epoch, v in enumerate(values, 1):
        if epoch <= rule.min_epochs:
            continue
        if best is None:
            best, best_epoch, misses = v, epoch, 1
        elif best - v > rule.min_delta:
            best, best_epoch, misses = v, epoch, 0
        else:
            misses += 1
            if misses > rule.patience:
                return epoch, best_epoch, best
    return None, best_epoch, best


def test_early_stop_fold(spark):
    rng = np.random.default_rng(9)
    rule = Stopping(3, 4, 0.25)
    runs = {"short": [1.0, 2.0], "falling": [20.0 - i for i in range(12)], "ties": [1.0] * 4 + [0.75] * 8, "flat": [1.0] * 30}
    runs |= {f"r{i}": (rng.integers(0, 12, 40) / 4).tolist() for i in range(12)}
    rows = [(k, i, float(v)) for k, vs in runs.items() for i, v in enumerate(vs, 1)]
    log = spark.createDataFrame(rows, "run string, epoch bigint, val_loss double").repartition(3)
    got = {r.run: (r.stop_epoch, r.best_epoch, r.best_value) for r in earlystop.early_stop(log, "run", rule).collect()}
    assert got == {k: slow_early_stop(v, rule) for k, v in runs.items()}


def test_report_of_known_counts(spark):
    counts = spark.createDataFrame([(1, 85583, 16212, 10105, 1188100), (0, 1188100, 10105, 16212, 85583)], "k bigint, tp bigint, fp bigint, fn bigint, tn bigint")
    r = {x.k: x for x in metrics.scores(counts).collect()}
    assert [round(r[1][c], 6) for c in ("accuracy", "precision", "recall", "f1")] == [0.979756, 0.840739, 0.894396, 0.866738]
    assert [round(r[0][c], 6) for c in ("precision", "recall", "f1")] == [0.991567, 0.986538, 0.989046]


def test_report_without_valid_pairs(spark):
    none = spark.createDataFrame([(255, 1), (255, 0)], "y int, pred int")
    for r in metrics.report(none).collect():
        assert (r.precision, r.recall, r.f1, r.accuracy, r.n_valid, r.n_total) == (0.0, 0.0, 0.0, None, 0, 2)
    odd = spark.createDataFrame([(0, 7), (1, 1)], "y int, pred int")
    assert [tuple(r) for r in metrics.confusion_matrix(odd).collect()] == [(0, 0, 0), (1, 0, 1)]
    assert {r.k: r.fn for r in metrics.report(odd).collect()} == {0: 1, 1: 0}


def test_sources_round_trip(spark, tmp_path):
    a = pixels(spark, np.arange(6.0).reshape(2, 3), "b0")
    g = raster.grid_of(a)
    assert g == Grid(2, 3)
    raster.require_bands(a, ["b0"])
    with pytest.raises(ValueError):
        raster.require_bands(a, ["b9"])
    with pytest.raises(ValueError):
        raster.require_same_grid(g, Grid(3, 3))
    with pytest.raises(ValueError):
        raster.grid_of(a.limit(0))
    meta = raster.raster_meta(spark, [0.0, 1.0, 0.0, 0.0, 0.0, -1.0], "wkt", g)
    raster.write_georeferenced(a, ["b0"], meta, str(tmp_path / "geo"))
    assert spark.read.parquet(str(tmp_path / "geo/bands")).filter("band = 1").count() == 6
    raster.write_class_map(spark, {0: 0, 1: 1}, str(tmp_path / "map"))
    assert raster.read_class_map(spark, str(tmp_path / "map")) == {0: 0, 1: 1}
    raster.write_prediction(a.select("idx", F.lit(0.5).alias("p0"), F.lit(0.5).alias("p1"), F.lit(0).alias("cls")), str(tmp_path / "pred"))
    assert dict(spark.read.parquet(str(tmp_path / "pred")).dtypes)["p0"] == "float"
    raster.write_json(a, str(tmp_path / "json"))
    raster.append_report(meta.select("width"), str(tmp_path / "log"))
    raster.append_report(meta.select("width"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    raster.write_table(a, str(tmp_path / "px"))
    assert raster.read_pixels(spark, str(tmp_path / "px"), ["b0"]).columns == ["idx", "row", "col", "b0"]


def test_weighted_model_and_registry(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    rows = [(i, float(a), float(b), int(a + b > 0)) for i, (a, b) in enumerate(x)]
    px = spark.createDataFrame(rows, "idx bigint, b0 double, l0 double, y int")
    s = model.setting(Experiment("2", "early", (0,)), ["b0"], ["l0"])
    fitted = model.fit(px, s.features, estimator=s.estimator())
    raster.save_model(fitted, str(tmp_path / "model"))
    scored = mosaic.classify(model.score(raster.load_model(str(tmp_path / "model")), px), ["p0", "p1"])
    assert scored.filter("cls = y").count() > 380
    with pytest.raises(ValueError):
        model.setting(Experiment("x", "middle"))
    late = mosaic.classify(model.fit_late(px.withColumn("y", F.when(F.col("idx") < 9, 255).otherwise(F.col("y"))), ["b0"], ["l0"]).score(px), ["p0", "p1"])
    assert late.filter("cls = y").count() > 360
