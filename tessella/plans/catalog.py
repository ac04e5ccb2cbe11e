"""The registered queries of the raster workflow."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scalar
from tessella.operators import augment, clean, earlystop, focal, grid, metrics, model, mosaic, patches, split, training, vector
from tessella.params import Clipping, Experiment, Grid, Split, Stopping, Training, Windows
from tessella.sources import fixtures as fx
from tessella.sources import partials, raster, versions
from tessella.sources.scratch import folder, kept

Query = Callable[[SparkSession, str], DataFrame]

W16 = Windows(16, 8)
KEEP = Split(min_positive=0.2)
OVERLAPS = Training().prediction_overlaps
WEIGHTS = {0: [0.8, -0.6, 0.3, 0.1, -0.4, 0.2], 1: [-0.7, 0.9, -0.2, 0.4, 0.6, -0.3]}
BIAS = {0: 0.1, 1: -0.2}
KERNEL = [[1.0, 2.0, 1.0], [2.0, 4.0, 2.0], [1.0, 2.0, 1.0]]

_all: dict[str, Query] = {}


def query(f: Query) -> Query:
    _all[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_all)


def _rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# -- evaluation


@query
def eval_report(spark, sf):
    out = metrics.report(fx.evaluation_pairs(spark, sf))
    return _rounded(out, ["precision", "recall", "f1", "accuracy"])


@query
def report_text(spark, sf):
    return metrics.report_lines(fx.evaluation_pairs(spark, sf))


@query
def report_append(spark, sf):
    """Two appended reports, read back and counted."""
    path = folder(spark, "report")
    report = metrics.report(fx.evaluation_pairs(spark, sf))
    for name in ("a", "b", "b"):  # the second append of b replaces the first
        raster.append_report(report.withColumn("experiment", F.lit(name)), path, name)
    return spark.read.parquet(path).select("experiment", "k", "tp", "fp", "fn", "tn")


@query
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(fx.evaluation_pairs(spark, sf))


@query
def class_report(spark, sf):
    return metrics.class_report(fx.evaluation_pairs(spark, sf))


@query
def distinct_classes(spark, sf):
    return metrics.distinct_classes(fx.table(spark, sf, "labels"), "quality")


@query
def valid_pixels(spark, sf):
    pairs = fx.evaluation_pairs(spark, sf)
    return pairs.agg(F.count_if(F.col("y") != 255).alias("n_valid"), F.count(F.lit(1)).alias("n_total"))


@query
def class_remap(spark, sf):
    pairs = fx.evaluation_pairs(spark, sf)
    return pairs.select("doc_id", scalar.remapped(F.col("y"), {0: 10, 1: 20}).alias("dst"))


@query
def class_remap_table(spark, sf):
    mapping = raster.class_map(spark, {0: 0, 1: 1})
    pairs = fx.evaluation_pairs(spark, sf)
    return pairs.join(F.broadcast(mapping), F.col("y") == F.col("src")).select("doc_id", F.col("dst").alias("y"))  # a row per class


# -- sources and pixel tables


@query
def pixel_grid(spark, sf):
    px = fx.optical(spark, sf)
    back = grid.to_idx(F.col("row"), F.col("col"), fx.WIDTH)
    return px.select("idx", grid.row_of(F.col("idx"), fx.WIDTH).alias("row"), grid.col_of(F.col("idx"), fx.WIDTH).alias("col"), back.alias("back"))


@query
def pixel_to_map(spark, sf):
    px = fx.optical(spark, sf)
    meta = raster.raster_meta(spark, fx.TRANSFORM, "", Grid(0, fx.WIDTH))
    return raster.to_map(px.select("idx", "row", "col"), meta).select("idx", "x", "y")


@query
def align_sources(spark, sf):
    raster.require_on_grid(fx.lidar(spark, sf), fx.grid(spark, sf))
    return fx.aligned(spark, sf).select("idx", "b0", "l0", "l1")


@query
def align_stored(spark, sf):
    """Both sources stored in buckets of the pixel index, so that they join without a shuffle."""
    opt = raster.store_raster(fx.optical(spark, sf), folder(spark, "optical"))
    lid = raster.store_raster(fx.lidar(spark, sf), folder(spark, "lidar"))
    return raster.with_optional(opt, lid, ["l0", "l1"]).select("idx", "b0", "l0", "l1")


@query
def algebra_stored(spark, sf):
    px = raster.store_raster(fx.optical(spark, sf), folder(spark, "optical"))
    return focal.add(px, px.select("idx", F.col("b2").alias("b0"), F.col("b3").alias("b1")), ["b0", "b1"])


@query
def missing_source(spark, sf):
    return raster.with_optional(fx.optical(spark, sf), None, ["l0"]).select("idx", "b0", "l0")


@query
def raster_bands_long(spark, sf):
    return raster.bands_long(fx.optical(spark, sf), ["b0", "b2"])


@query
def nan_to_zero(spark, sf):
    px = fx.optical(spark, sf)
    holed = F.when(F.col("idx") % 97 == 0, F.lit(float("nan"))).when(F.col("idx") % 89 == 0, F.lit(None)).otherwise(F.col("b0"))
    return px.select("idx", scalar.no_nan(holed).alias("b0"))


@query
def json_dump(spark, sf):
    pairs = fx.evaluation_pairs(spark, sf)
    return pairs.select("doc_id", F.to_json(F.struct("doc_id", "y", "pred")).alias("json"))


@query
def constant_raster(spark, sf):
    g = fx.grid(spark, sf)
    return grid.constant(spark, g, 255, "y").select("idx", F.col("y").cast("bigint").alias("y"))


# -- files


@query
def prepared_scan(spark, sf):
    """The aligned raster as a prepared table; two bands of it are read."""
    path = folder(spark, "prepared")
    raster.write_table(fx.aligned(spark, sf), path)
    px = raster.read_pixels(spark, path, ["b0", "l0"])
    raster.require_bands(px, ["b0", "l0"])
    return px.select("idx", "b0", "l0")


@query
def prepared_version(spark, sf):
    """All prepared outputs of a run as one version, read back through its manifest; windows are stored by split."""
    px, windows, g = _split(spark, sf)
    windows, label = kept(windows, "windows"), kept(px.select("idx", "y"), "label")
    tables = {
        "optical": fx.optical(spark, sf),
        "lidar": fx.aligned(spark, sf).select("idx", "l0", "l1"),
        "label": label,
        "test_label": split.test_label(label, windows.filter(F.col("split") == "test"), g, W16),
        "windows": windows.filter(F.col("split") != "test").select("wid", "wr", "wc", "split"),
        "classes": raster.class_map(spark, {0: 0, 1: 1}),
    }
    root = folder(spark, "version")
    for _ in range(2):  # the second time the run is complete
        versions.write_version(spark, root, "r1", tables, {"windows": "split"})
    read = lambda name: versions.read_version(spark, root, name)
    sums = lambda df, name, c: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(c).cast("bigint").alias("total"))
    out = sums(read("optical"), "optical", "idx").unionByName(sums(read("lidar"), "lidar", "l0"))
    out = out.unionByName(sums(read("label"), "label", "y")).unionByName(sums(read("test_label"), "test_label", "y"))
    for part in ("train", "val"):
        out = out.unionByName(sums(read("windows").filter(F.col("split") == part), part, "wid"))
    return out


@query
def merged_statistics(spark, sf):
    """Extremes, counts and positive pixels from states per file: of the second half of the raster only its own files are read."""
    path, store = folder(spark, "added"), folder(spark, "states")
    px, g = _labelled(spark, sf, "b0", "b2")
    px = kept(px, "labelled")
    for half in (F.col("row") < g.height // 2, F.col("row") >= g.height // 2):
        px.filter(half).write.mode("append").parquet(path)
        partials.update(spark, path, store, ["b0", "b2"], (0.0, 600_000.0, 50), "y")
    counts = partials.histogram(spark, path, store).groupBy("band").agg(F.max("n").alias("fullest"))
    return partials.summary(spark, path, store).join(counts, "band")


@query
def label_scan(spark, sf):
    path, g = folder(spark, "label"), fx.grid(spark, sf)
    raster.write_table(fx.labelled(spark, sf, fx.optical(spark, sf).select("idx"), g), path)
    return raster.read_label(spark, path)


@query
def prediction_files(spark, sf):
    path = folder(spark, "prediction")
    raster.write_prediction(mosaic.classify(mosaic.average(_votes(spark, sf), ["p0", "p1"], OVERLAPS), ["p0", "p1"]), path)
    back = spark.read.parquet(path)
    return back.select("idx", *[F.round(F.col(p).cast("double"), 4).alias(p) for p in ("p0", "p1")])


@query
def georeferenced_files(spark, sf):
    """Two bands with their metadata, read back with the map place of each pixel."""
    path, g = folder(spark, "georeferenced"), fx.grid(spark, sf)
    px = fx.optical(spark, sf)
    raster.write_georeferenced(px, ["b1", "b3"], raster.raster_meta(spark, fx.TRANSFORM, "", g), path)
    bands = spark.read.parquet(f"{path}/bands")
    wide = bands.groupBy("idx").agg(*[F.max(F.when(F.col("band") == i, F.col("value"))).cast("double").alias(f"v{i}") for i in (1, 2)])
    placed = wide.select("idx", grid.row_of(F.col("idx"), fx.WIDTH).alias("row"), grid.col_of(F.col("idx"), fx.WIDTH).alias("col"), "v1", "v2")
    return raster.to_map(placed, spark.read.parquet(f"{path}/meta")).select("idx", "x", "y", "v1", "v2")


@query
def class_map_files(spark, sf):
    path = folder(spark, "classes")
    raster.write_class_map(spark, {0: 10, 1: 20}, path)
    pairs = fx.evaluation_pairs(spark, sf)
    return pairs.select("doc_id", scalar.remapped(F.col("y"), raster.read_class_map(spark, path)).alias("dst"))


@query
def polygon_files(spark, sf):
    """Polygons written as GeoJSON, read back and burned."""
    path, g = folder(spark, "polygons"), fx.grid(spark, sf)
    raster.write_polygons(fx.rings(spark, sf, g), path, "EPSG:3857")
    return vector.burned(vector.edges(raster.polygons_on(spark, path, "EPSG:3857")), g)


# -- cleaning


@query
def band_histogram(spark, sf):
    long = clean.long_bands(fx.optical(spark, sf), ["b0"])
    return clean.histogram(long, 100).select("bin", "n")


@query
def clip_thresholds(spark, sf):
    px = kept(fx.aligned(spark, sf), "aligned").withColumn("flat", F.lit(0.123))  # three passes read it
    return clean.thresholds(px, [*fx.BANDS, "flat"]).select("band", "lo", "hi")


@query
def masked_thresholds(spark, sf):
    mask = F.when(F.col("idx") % 3 == 0, 2).otherwise(0)
    return clean.thresholds(fx.optical(spark, sf), ["b0", "b2"], Clipping(), mask).select("band", "lo", "hi")


def _normal(spark, sf) -> DataFrame:
    # extremes, histogram and output each pass over the aligned raster, so it is joined once
    return clean.clip_normalise(kept(fx.aligned(spark, sf), "aligned"), fx.BANDS)


@query
def clip_normalise(spark, sf):
    names = [f"n_{b}" for b in fx.BANDS]
    return _rounded(_normal(spark, sf).select("idx", *names), names)


# -- polygons


@query
def rasterize_polygons(spark, sf):
    g = fx.grid(spark, sf)
    return vector.burned(vector.edges(fx.rings(spark, sf, g)), g)


@query
def label_stats(spark, sf):
    g = fx.grid(spark, sf)
    y = fx.labelled(spark, sf, fx.optical(spark, sf).select("idx"), g)
    hits, n = F.count_if(F.col("y") == 1), F.count(F.lit(1))
    return y.agg(hits.alias("n_positive"), n.alias("n_pixels"), F.round(100.0 * hits / n, 6).alias("percent"))


@query
def reproject_polygons(spark, sf):
    g = fx.grid(spark, sf)
    degrees = fx.rings(spark, sf, g).withColumn(
        "vertices", F.transform("vertices", lambda p: F.struct((p["x"] / 10).alias("x"), (p["y"] % 80).alias("y")))
    )
    moved = vector.reproject_rings(degrees, "EPSG:4326", "EPSG:3857").select("pid", F.posexplode("vertices").alias("nth", "v"))
    return moved.select("pid", F.col("nth").cast("bigint").alias("nth"), F.round("v.x", 3).alias("x"), F.round("v.y", 3).alias("y"))


# -- windows


def _labelled(spark, sf, *bands: str) -> tuple[DataFrame, Grid]:
    g = fx.grid(spark, sf)
    return fx.labelled(spark, sf, fx.optical(spark, sf).select("idx", "row", "col", *bands), g), g


def _windows(spark, sf) -> tuple[DataFrame, DataFrame, Grid]:
    px, g = _labelled(spark, sf, "b0")
    return px, grid.window_fraction(px, F.col("y") == 1, g, W16), g


@query
def sliding_windows(spark, sf):
    g = fx.grid(spark, sf)
    px = fx.optical(spark, sf).select("idx", "row", "col")
    return grid.explode_windows(px, g, W16).groupBy("wid", "wr", "wc").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("idx_sum"))


@query
def window_fraction(spark, sf):
    return _rounded(_windows(spark, sf)[1], ["frac"])


@query
def window_fraction_odd_step(spark, sf):
    px, g = _labelled(spark, sf)
    return _rounded(grid.window_fraction(px, F.col("y") == 1, g, Windows(16, 6)), ["frac"])


@query
def keep_windows(spark, sf):
    return _rounded(split.keep(_windows(spark, sf)[1], KEEP), ["frac"])


def _split(spark, sf, how: Split = KEEP) -> tuple[DataFrame, DataFrame, Grid]:
    px, windows, g = _windows(spark, sf)
    return px, split.split(split.keep(windows, how), how), g


@query
def window_counts(spark, sf):
    windows = _windows(spark, sf)[1]
    return windows.agg(F.count(F.lit(1)).alias("n_before"), F.count_if(F.col("frac") >= KEEP.min_positive).alias("n_after"))


@query
def split_windows(spark, sf):
    return _split(spark, sf)[1].select("wid", "rank", "split")


@query
def split_counts(spark, sf):
    return split.counts(_split(spark, sf)[1])


@query
def separate_split(spark, sf):
    return split.counts(_split(spark, sf, Split(min_positive=0.2, mode="separate"))[1])


@query
def test_label(spark, sf):
    px, windows, g = _split(spark, sf)
    return split.test_label(px, windows.filter(F.col("split") == "test"), g, W16)


def _gathered(spark, sf) -> DataFrame:
    px, windows, g = _split(spark, sf)
    chosen = windows.filter(F.col("split") == "train").select("wid")
    return grid.pixels_in(chosen, px.select("idx", "row", "col", "b0", "y"), g, W16)


@query
def gather_windows(spark, sf):
    return _gathered(spark, sf).select("wid", "r", "c", "idx", "b0", "y")


@query
def augment_windows(spark, sf):
    return augment.augment(_gathered(spark, sf), W16.size, 42, 1).select("wid", "r", "c", "idx", "y")


@query
def window_batches(spark, sf):
    windows = _split(spark, sf)[1].filter(F.col("split") == "train").select("wid")
    return split.shuffled_batches(windows, 42, 1, 8).select("wid", "rank", "batch")


@query
def first_batch_sample(spark, sf):
    """The first validation batch with a model's class of each pixel."""
    windows = _split(spark, sf)[1]
    first = split.batched(split.ranked(windows.filter(F.col("split") == "val").select("wid", "wr", "wc"), split.shuffle_key(42, F.col("wid"))), 8).filter(F.col("batch") == 0)
    corners = first.select("wid", (F.col("wr") * W16.step).alias("row0"), (F.col("wc") * W16.step).alias("col0"))
    px = fx.labelled(spark, sf, mosaic.classify(_scored(spark, sf), ["p0", "p1"]).select("idx", "cls"), fx.grid(spark, sf))
    return grid.window_pixels(corners, fx.grid(spark, sf), W16).join(px, "idx").select("wid", "idx", "y", "cls")


@query
def first_windows(spark, sf):
    """The first windows of the split, as for a trial run."""
    return split.first(_split(spark, sf)[1], 20).select("wid", "rank", "split")


@query
def window_transform(spark, sf):
    upside = lambda chip: chip[:, ::-1, :]
    return patches.transform_windows(_gathered(spark, sf), ["b0"], W16.size, upside)


# -- prediction


def _votes(spark, sf) -> DataFrame:
    g = fx.grid(spark, sf)
    v = (F.col("wr") * 31 + F.col("wc") * 17) % 7 / 7
    return mosaic.window_votes(fx.optical(spark, sf).select("idx", "row", "col"), g, 16, OVERLAPS, {"p0": 1 - v, "p1": v})


@query
def mosaic_prob(spark, sf):
    return _rounded(mosaic.average(_votes(spark, sf), ["p0", "p1"], OVERLAPS), ["p0", "p1"])


@query
def mosaic_truncate(spark, sf):
    return _rounded(mosaic.average(_votes(spark, sf), ["p0", "p1"], OVERLAPS, "truncate"), ["p0", "p1"])


@query
def mosaic_argmax(spark, sf):
    scores = _rounded(mosaic.average(_votes(spark, sf), ["p0", "p1"], OVERLAPS), ["p0", "p1"])
    return mosaic.classify(scores, ["p0", "p1"]).select("idx", "cls")


def _scored(spark, sf) -> DataFrame:
    return model.linear_scores(_normal(spark, sf), [f"n_{b}" for b in fx.BANDS], WEIGHTS, BIAS)


@query
def softmax_scores(spark, sf):
    return _rounded(_scored(spark, sf).select("idx", "p0", "p1"), ["p0", "p1"])


@query
def score_windows(spark, sf):
    names = [f"n_{b}" for b in fx.BANDS]
    w, bias = np.array([WEIGHTS[0], WEIGHTS[1]]).T, np.array([BIAS[0], BIAS[1]])

    def scorer(x: np.ndarray) -> np.ndarray:
        z = x @ w + bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    return _rounded(model.score_batches(_normal(spark, sf), names, scorer, ["idx"]), ["p0", "p1"])


def _mean3x3(x: np.ndarray) -> np.ndarray:
    """(windows, 2, size, size): each pixel's mean over its neighbours inside the patch as the second score."""
    p = np.pad(x[:, 0], ((0, 0), (1, 1), (1, 1)))
    ones = np.pad(np.ones(x.shape[2:]), 1)
    h, w = x.shape[2:]
    parts = [(p[:, i : i + h, j : j + w], ones[i : i + h, j : j + w]) for i in range(3) for j in range(3)]
    mean = sum(a for a, _ in parts) / sum(n for _, n in parts) / 599_999  # no multiple of it is a round number, so no vote lies halfway between two rounded ones
    return np.stack((1 - mean, mean), axis=1)


@query
def patch_mosaic(spark, sf):
    """A scorer that looks at neighbours, over whole patches of the padded raster at three overlaps."""
    out = patches.patch_mosaic(fx.optical(spark, sf), fx.grid(spark, sf), ["b0"], 16, OVERLAPS, _mean3x3)
    return _rounded(out.select("idx", "p0", "p1"), ["p0", "p1"])


@query
def patch_mosaic_truncate(spark, sf):
    """Votes cut to whole numbers: here the rare mean above the scale's end counts one."""
    out = patches.patch_mosaic(fx.optical(spark, sf), fx.grid(spark, sf), ["b0"], 16, OVERLAPS, lambda x: 2 * _mean3x3(x), vote="truncate")
    return _rounded(out.select("idx", "p0", "p1"), ["p0", "p1"])


@query
def early_fusion(spark, sf):
    both = focal.stack(fx.optical(spark, sf), raster.with_optional(fx.optical(spark, sf).select("idx"), fx.lidar(spark, sf), ["l0", "l1"]), ["b0", "b1"], ["l0", "l1"])
    return both.select("idx", F.concat(F.array("b0", "b1"), F.array("l0", "l1")).alias("bands")).select("idx", *[F.get("bands", F.lit(i)).alias(f"f{i}") for i in range(4)])


@query
def late_fusion(spark, sf):
    px = _normal(spark, sf)
    a = model.linear_scores(px, ["n_b0", "n_b1"], {0: [0.8, -0.6], 1: [-0.7, 0.9]}, BIAS, "a").select("idx", "a0", "a1")
    b = model.linear_scores(px, ["n_l0", "n_l1"], {0: [-0.4, 0.2], 1: [0.6, -0.3]}, BIAS, "b").select("idx", "b0", "b1")

    def stacker(names: list[str]) -> Column:
        return model.logits(names, {0: [1.0, -1.0, 0.5, -0.5], 1: [-1.0, 1.0, -0.5, 0.5]}, {0: 0.0, 1: 0.1})

    p = model.late_fusion(a, b, stacker)
    return p.select("idx", F.round(F.get("p", F.lit(0)), 6).alias("p0"), F.round(F.get("p", F.lit(1)), 6).alias("p1"))


@query
def segmentation_report(spark, sf):
    """The whole workflow: clean, burn labels, score windows, average overlaps, classify, evaluate."""
    g = fx.grid(spark, sf)
    px = fx.labelled(spark, sf, _scored(spark, sf).select("idx", "row", "col", "p0", "p1"), g)
    votes = mosaic.window_votes(px, g, 16, OVERLAPS, {"p0": F.col("p0"), "p1": F.col("p1")})
    scores = _rounded(mosaic.average(votes, ["p0", "p1"], OVERLAPS), ["p0", "p1"])
    pred = mosaic.classify(scores, ["p0", "p1"]).select("idx", F.col("cls").alias("pred"))
    out = metrics.report(pred.join(px.select("idx", "y"), "idx"))
    return _rounded(out, ["precision", "recall", "f1", "accuracy"])


@query
def train_weighted_lr(spark, sf):
    """Weighted classifiers of the three fusion settings, judged on the pixels of held-out rows."""
    g = fx.grid(spark, sf)
    px = kept(fx.labelled(spark, sf, fx.aligned(spark, sf), g), "labelled")  # every iteration of every model reads it
    test = F.floor(F.col("row") / 16) % 5 == 0
    train, held = px.filter(~test), px.filter(test)
    scored = {}
    for e in (Experiment("1"), Experiment("2", "early", (0, 1))):
        s = model.setting(e)
        scored[e.name] = model.score(model.fit(train, s.features, estimator=s.estimator()), held)
    scored["3"] = model.fit_late(train, model.OPTICAL, model.LIDAR).score(held)
    out = None
    for name, rows in scored.items():
        pairs = mosaic.classify(rows, ["p0", "p1"]).select("y", F.col("cls").alias("pred"))
        report = metrics.report(pairs).select(F.lit(name).alias("experiment"), "k", "precision", "recall", "f1", "accuracy", "support")
        out = report if out is None else out.unionByName(report)
    return out


#: Three epochs of two updates each; the fold counts from the second epoch.
LOOP, LOOP_STOP, LOOP_ROUNDS = Training(learning_rate=2.0, gamma=0.9, max_epochs=3), Stopping(min_epochs=1, patience=2, min_delta=1e-4), 2


def _pixel_windows(spark, sf) -> DataFrame:
    """Scaled pixels and labels of the training and validation windows: wid, split, y, n_b0, ..."""
    _, windows, g = _split(spark, sf)
    chosen = windows.filter(F.col("split") != "test").select("wid", "split")
    px = fx.labelled(spark, sf, _normal(spark, sf), g)
    return grid.pixels_in(chosen, px.select("idx", "row", "col", "y", *[f"n_{b}" for b in fx.BANDS]), g, W16)


@query
def train_epochs(spark, sf):
    """The training loop: a row per epoch, with the best epoch and its weights."""
    rows = kept(_pixel_windows(spark, sf), "loop-pixels")
    bands = [f"n_{b}" for b in fx.BANDS]
    done = training.train_epochs(rows.filter("split = 'train'"), rows.filter("split = 'val'"), bands, LOOP, LOOP_STOP, 42, LOOP_ROUNDS)
    weights = [F.lit(w).alias(f"w{j}") for j, w in enumerate(done.model.weights[1])]
    out = done.log.select("*", F.lit(done.best_epoch).cast("bigint").alias("best_epoch"), *weights, F.lit(done.model.bias[1]).alias("bias"))
    return _rounded(out, [c for c in out.columns if c not in ("epoch", "best_epoch")])


# -- training logs


@query
def early_stop(spark, sf):
    return earlystop.early_stop(fx.epochs(spark, sf), "experiment")


@query
def epoch_loss(spark, sf):
    log = fx.epochs(spark, sf).withColumn("epoch_group", F.floor(F.col("batch") / 5))
    return _rounded(metrics.epoch_mean(log, "val_loss", ["experiment"]), ["mean"])


@query
def batch_f1(spark, sf):
    return _rounded(metrics.batch_f1(fx.epochs(spark, sf), ["experiment"]), ["f1"])


@query
def running_loss(spark, sf):
    log = metrics.running_mean(fx.epochs(spark, sf), "val_loss", ["experiment", "batch"], "epoch")
    return _rounded(log.select("experiment", "epoch", "running"), ["running"])


@query
def lr_schedule(spark, sf):
    rows = fx.epochs(spark, sf).select("experiment", "epoch")
    t = Training()
    return _rounded(metrics.learning_rates(rows, t.learning_rate, t.gamma), ["lr"], 12)


@query
def weighted_ce(spark, sf):
    z = (F.col("val_loss") - 100) / 50
    out = metrics.weighted_cross_entropy(fx.epochs(spark, sf), F.array(F.lit(0.0), z), Training().class_weights, ["experiment"])
    return _rounded(out, ["loss"])


@query
def weighted_ce_probs(spark, sf):
    z = (F.col("val_loss") - 100) / 50
    probs = scalar.softmax(F.array(F.lit(0.0), z))
    out = metrics.weighted_cross_entropy(fx.epochs(spark, sf).withColumn("p", probs), F.col("p"), Training().class_weights, ["experiment"])
    return _rounded(out, ["loss"])


# -- filters and resampling


@query
def reflect_pad(spark, sf):
    g = fx.grid(spark, sf)
    return grid.reflect_pad(fx.optical(spark, sf).select("idx", "row", "col"), g, 16).select("prow", "pcol", "idx")


@query
def crop_padding(spark, sf):
    g = fx.grid(spark, sf)
    padded = grid.reflect_pad(fx.optical(spark, sf).select("idx", "row", "col", "b0"), g, 16)
    return grid.crop(padded, g, 16).select("idx", "row", "col", "b0")


@query
def focal3x3(spark, sf):
    return _rounded(focal.focal3x3(fx.optical(spark, sf), fx.grid(spark, sf), KERNEL, "b0"), ["value"], 3)


@query
def focal3x3_stride2(spark, sf):
    return _rounded(focal.focal3x3(fx.optical(spark, sf), fx.grid(spark, sf), KERNEL, "b0", 2, "zero"), ["value"], 3)


@query
def upsample2(spark, sf):
    return focal.upsample2(fx.optical(spark, sf), fx.grid(spark, sf), ["b0"])


@query
def band_algebra(spark, sf):
    px = fx.optical(spark, sf)
    return focal.add(px, px.select("idx", F.col("b2").alias("b0"), F.col("b3").alias("b1")), ["b0", "b1"])


# -- tensor columns


@query
def tensor_explode(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("pos", "value"))
    return rows.select("row", F.floor(F.col("pos") / 16).alias("band"), (F.col("pos") % 16).cast("bigint").alias("col"), F.round(F.col("value").cast("double"), 6).alias("value"))


@query
def band_select(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("bands"))
    first, some = scalar.first_bands(F.col("bands"), 4), scalar.listed_bands(F.col("bands"), (1, 3))
    take = lambda a, i: F.round(F.get(a, F.lit(i)), 6)
    return rows.select("vec_id", F.size(first).cast("bigint").alias("n_first"), take(first, 3).alias("b3"), take(some, 0).alias("s0"), take(some, 1).alias("s1"))
