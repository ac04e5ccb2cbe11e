"""Scoring of whole patches and the training loop against dense arrays."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import earlystop, patches, training
from tessella.params import Grid, Stopping, Training, Windows


def raster(spark, *bands):
    h, w = bands[0].shape
    rows = [(r * w + c, r, c, *[float(b[r, c]) for b in bands]) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "idx bigint, row bigint, col bigint, " + ", ".join(f"b{i} double" for i in range(len(bands)))).repartition(3)


def edges():
    """A scorer of three classes that depends on neighbours, on both bands and on the place inside the patch; made here, so that it goes to workers by value."""

    def scorer(x):
        down = np.zeros_like(x)
        down[:, :, 1:] = x[:, :, :-1]
        place = np.arange(x.shape[2])[:, None] * np.ones(x.shape[3])
        return np.stack((x[:, 0] - down[:, 1], down[:, 0] * place, x.sum(1)), axis=1)

    return scorer


def dense_mosaic(bands, size, overlaps, scorer, cut=lambda s: s):
    h, w = bands[0].shape
    padded = np.stack([np.pad(b, size, mode="reflect") for b in bands])
    total = 0
    for o in overlaps:
        s = Windows.at_overlap(size, o).step
        sums, n = 0, np.zeros((h + 2 * size, w + 2 * size))
        sums = np.zeros((3, *n.shape))
        for i in range((h + size) // s + 1):
            for j in range((w + size) // s + 1):
                at = (slice(i * s, i * s + size), slice(j * s, j * s + size))
                sums[(slice(None), *at)] += cut(scorer(padded[(slice(None), *at)][None])[0])
                n[at] += 1
        total = total + (sums / np.maximum(n, 1))[:, size : size + h, size : size + w]
    return total / len(overlaps)


@pytest.mark.parametrize("h,w,size", [(13, 10, 8), (8, 8, 4), (3, 9, 4)])
def test_patch_mosaic_against_dense_arrays(spark, h, w, size):
    rng = np.random.default_rng(h)
    bands = [rng.random((h, w)) for _ in range(2)]
    overlaps = (0.0, 0.25, 0.5)
    for vote, cut in (("prob", lambda s: s), ("truncate", np.floor)):
        out = patches.patch_mosaic(raster(spark, *bands), Grid(h, w), ["b0", "b1"], size, overlaps, edges(), 3, batch=3, vote=vote).collect()
        assert len(out) == h * w
        got = np.zeros((3, h, w))
        for r in out:
            got[:, r.row, r.col] = r.p0, r.p1, r.p2
            assert r.idx == r.row * w + r.col
        assert np.allclose(got, dense_mosaic(bands, size, overlaps, edges(), cut))


def test_pixels_that_are_missing_count_as_zero(spark):
    a = np.arange(36.0).reshape(6, 6) + 1
    holed = raster(spark, a).filter("idx <> 14")
    a[2, 2] = 0
    out = patches.patch_mosaic(holed, Grid(6, 6), ["b0"], 2, (0.0,), lambda x: np.concatenate((x, x), axis=1))
    assert {r.idx: r.p1 for r in out.collect()} == dict(enumerate(a.ravel()))


def test_scorer_of_another_shape_raises(spark):
    with pytest.raises(Exception, match="the scorer returned"):
        patches.patch_mosaic(raster(spark, np.ones((4, 4))), Grid(4, 4), ["b0"], 2, (0.0,), lambda x: x).collect()


def test_transform_windows(spark):
    rng = np.random.default_rng(4)
    chips = rng.random((5, 2, 3, 3))
    rows = [(wid, r, c, float(chips[wid, 0, r, c]), float(chips[wid, 1, r, c])) for wid in range(5) for r in range(3) for c in range(3)]
    df = spark.createDataFrame(rows, "wid bigint, r bigint, c bigint, a double, b double").repartition(2)
    out = patches.transform_windows(df, ["a", "b"], 3, lambda chip: chip[::-1, ::-1, :]).collect()
    assert len(out) == 45
    for r in out:
        assert (r.a, r.b) == (chips[r.wid, 1, 2 - r.r, r.c], chips[r.wid, 0, 2 - r.r, r.c])


def window_rows(rng, n, size=6):
    rows = []
    for wid in range(n):
        for x, y in zip(rng.normal(size=(size, 2)), rng.random(size)):
            rows.append((wid, 255 if y < 0.1 else int(x[0] - 0.5 * x[1] + rng.normal() * 0.3 > 0), *map(float, x)))
    return rows


def order(wids, seed):
    return sorted(wids, key=lambda w: (hashlib.md5(f"{seed}:{w}".encode()).hexdigest(), w))


def dense_training(train, held, how, rule, seed, rounds):
    weight = np.array([how.class_weights[0], how.class_weights[1]])
    w, b = np.zeros((2, 2)), np.zeros(2)

    def one(rows):
        x, y = np.array([r[2:] for r in rows if r[1] != 255]), np.array([r[1] for r in rows if r[1] != 255])
        z = x @ w.T + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        wrong = (p - np.eye(2)[y]) * weight[y][:, None]
        loss = -(weight[y] * np.log(p[np.arange(len(y)), y])).sum() / weight[y].sum()
        f1 = []
        for k in (0, 1):
            tp, fp, fn = ((z.argmax(1) == k) & (y == k)).sum(), ((z.argmax(1) == k) & (y != k)).sum(), ((z.argmax(1) != k) & (y == k)).sum()
            f1.append(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)
        return loss, wrong.T @ x / weight[y].sum(), wrong.sum(0) / weight[y].sum(), np.mean(f1)

    def batches(rows, name):
        wids = order({r[0] for r in rows}, name)
        return [[r for r in rows if r[0] in wids[i : i + how.batch_size]] for i in range(0, len(wids), how.batch_size)]

    log, kept = [], {}
    for epoch in range(1, how.max_epochs + 1):
        all_batches, losses = batches(train, f"{seed}:{epoch}"), []
        n = len(all_batches)
        for r in range(rounds):
            found = [one(rows) for i, rows in enumerate(all_batches) if i * rounds // n == r]
            if found:
                rate = how.learning_rate * how.gamma ** (epoch - 1)
                losses += [f[0] for f in found]
                w, b = w - rate * np.mean([f[1] for f in found], axis=0), b - rate * np.mean([f[2] for f in found], axis=0)
        judged = [one(rows) for rows in batches(held, seed)]
        log.append((np.mean(losses), np.mean([j[0] for j in judged]), np.mean([j[3] for j in judged])))
        kept[epoch] = (w, b)
    return log, kept


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_training_loop_against_dense_descent(spark, rounds):
    rng = np.random.default_rng(rounds)
    train, held = window_rows(rng, 9), window_rows(rng, 5)
    how, rule = Training(learning_rate=0.8, gamma=0.9, max_epochs=3, batch_size=2), Stopping(min_epochs=1, patience=5, min_delta=0.0)
    schema = "wid bigint, y int, a double, b double"
    done = training.train_epochs(spark.createDataFrame(train, schema), spark.createDataFrame(held, schema), ["a", "b"], how, rule, 7, rounds)
    log, models = dense_training(train, held, how, rule, 7, rounds)
    got = [(r.train_loss, r.val_loss, r.val_f1) for r in done.log.orderBy("epoch").collect()]
    assert np.allclose(got, log)
    assert [r.lr for r in done.log.orderBy("epoch").collect()] == pytest.approx([0.8, 0.72, 0.648])
    w, b = models[done.best_epoch]
    assert np.allclose(done.model.weights, w) and np.allclose(done.model.bias, b)


def test_training_ends_and_keeps_the_best(spark):
    """Rates far too high make the validation loss jump, so the fold stops the loop."""
    rng = np.random.default_rng(1)
    schema = "wid bigint, y int, a double, b double"
    train, held = (spark.createDataFrame(window_rows(rng, n), schema) for n in (6, 4))
    how, rule = Training(learning_rate=60.0, gamma=1.0, max_epochs=12, batch_size=3), Stopping(min_epochs=1, patience=1, min_delta=5.0)
    done = training.train_epochs(train, held, ["a", "b"], how, rule, 7)
    rows = done.log.selectExpr("'x' AS experiment", "epoch", "val_loss")
    end = earlystop.early_stop(rows, "experiment", rule).first()
    assert (end.stop_epoch, end.best_epoch) == (done.stop_epoch, done.best_epoch) == (rows.count(), done.best_epoch)
    assert done.stop_epoch < 12
    shown = done.model.score(held.filter("y <> 255")).withColumn("right", (F.col("p1") > F.col("p0")).cast("int") == F.col("y"))
    assert shown.filter("right").count() > 0
    with pytest.raises(ValueError):
        training.train_epochs(train, held.withColumn("y", F.lit(255)), ["a", "b"], how, rule)
