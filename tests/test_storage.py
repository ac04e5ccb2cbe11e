"""Ranks in ranges, versions with manifests, stored rasters, runs of pixels, thresholds by refinement."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import clean, focal, ranks, split, vector
from tessella.params import Clipping, Grid, Windows
from tessella.sources import partials, raster, versions


@pytest.mark.parametrize("range_rows", [7, 64, 10_000])
def test_ranks_in_ranges(spark, range_rows):
    rng = np.random.default_rng(1)
    rows = [(str(g) if g else None, int(t) if t else None, i) for i, (g, t) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(0, 4, 300) ** 5))]
    df = spark.createDataFrame(rows, "g string, t bigint, i bigint").repartition(3)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    whole = {r.i: (r.rank, r.total) for r in ranks.ranked(df, ["t", "i"], range_rows=range_rows).collect()}
    assert whole == {r[2]: (k, 300) for k, r in enumerate(sorted(rows, key=key), 1)}
    per = {r.i: (r.rank, r.total) for r in ranks.ranked(df, ["t", "i"], ["g"], range_rows).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=key)
        assert {i: v for i, v in per.items() if i in {r[2] for r in mine}} == {r[2]: (k, len(mine)) for k, r in enumerate(mine, 1)}
    assert ranks.ranked(df.limit(0), ["i"]).count() == 0
    assert [r["rank"] for r in split.first(ranks.ranked(df, ["i"]), 5).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_a_run_that_ends_half_way_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "out")
    with pytest.raises(ValueError):
        versions.latest(spark, root)
    one, two = spark.range(3), spark.range(10)
    versions.write_version(spark, root, "first", {"a": one, "b": one})
    broken = spark.range(10).withColumn("x", F.expr("if(id = 7, raise_error('lost'), 1)"))
    with pytest.raises(Exception, match="lost"):
        versions.write_version(spark, root, "second", {"a": two, "b": broken})
    assert versions.latest(spark, root) == "first" and versions.read_version(spark, root, "a").count() == 3
    with pytest.raises(ValueError):
        versions.read_version(spark, root, "a", "second")
    versions.write_version(spark, root, "second", {"a": two, "b": two.withColumn("part", F.col("id") % 2)}, {"b": "part"})
    versions.write_version(spark, root, "second", {"a": one, "b": one})  # complete already: nothing changes
    assert versions.latest(spark, root) == "second" and versions.read_version(spark, root, "a").count() == 10
    assert versions.read_version(spark, root, "b").filter("part = 1").count() == 5 and versions.read_version(spark, root, "b", "first").count() == 3


def test_a_repeated_append_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    for run, n in (("x", 2), ("y", 3), ("y", 3)):
        raster.append_report(spark.range(n), path, run)
    assert {r.run: r["count"] for r in spark.read.parquet(path).groupBy("run").count().collect()} == {"x": 2, "y": 3}


def test_stored_rasters_join_without_a_shuffle(spark, tmp_path):
    px = spark.range(400).select(F.col("id").alias("idx"), F.rand(1).alias("b0"))
    a, b = (raster.store_raster(px, str(tmp_path / n), 4) for n in ("a", "b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = focal.add(a, b, ["b0"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sources_off_the_grid_raise(spark):
    g = Grid(2, 3)
    raster.require_on_grid(spark.range(6).withColumnRenamed("id", "idx"), g)
    raster.require_on_grid(spark.range(0).withColumnRenamed("id", "idx"), g)
    with pytest.raises(ValueError):
        raster.require_on_grid(spark.range(7).withColumnRenamed("id", "idx"), g)
    with pytest.raises(ValueError):
        raster.require_on_grid(spark.createDataFrame([(0, 0, 0)], "idx bigint, row bigint, col bigint"), g)


def test_runs_are_united_and_met(spark, monkeypatch):
    monkeypatch.setattr(vector, "STRIP", 5)
    rng = np.random.default_rng(3)
    g, mask = Grid(6, 23), np.zeros((6, 23), dtype=bool)
    spans = []
    for _ in range(25):
        r, lo = int(rng.integers(0, 6)), int(rng.integers(0, 23))
        hi = min(22, lo + int(rng.integers(0, 9)))
        spans.append((r, lo, hi))
        mask[r, lo : hi + 1] = True
    runs = vector.united(spark.createDataFrame(spans, "row bigint, lo bigint, hi bigint"))
    found = runs.collect()
    assert sum(r.hi - r.lo + 1 for r in found) == mask.sum() and all(r.lo // 5 == r.hi // 5 == r.tile for r in found)
    px = spark.range(6 * 23).select(F.col("id").alias("idx"), F.lit("x").alias("lo"))
    got = {r.idx for r in vector.covered(px, runs, g, "hit").filter("hit").collect()}
    assert got == set(np.flatnonzero(mask.ravel()).tolist()) and vector.covered(px, runs, g, "hit").count() == 6 * 23


def test_test_label_by_runs(spark):
    g, w = Grid(7, 9), Windows(4, 2)
    label = spark.range(63).select(F.col("id").alias("idx"), (F.col("id") % 2).cast("int").alias("y"))
    chosen = spark.createDataFrame([(0, 0, 0), (4, 1, 1)], "wid bigint, wr bigint, wc bigint")
    mask = np.zeros((7, 9), dtype=bool)
    mask[0:4, 0:4] = mask[2:6, 2:6] = True
    got = {r.idx: r.y for r in split.test_label(label, chosen, g, w).collect()}
    assert got == {i: (i % 2 if mask.ravel()[i] else 255) for i in range(63)}


@pytest.mark.parametrize("bins", [10, 1000, 1_000_000])
def test_refined_thresholds_equal_a_whole_histogram(spark, bins):
    rng = np.random.default_rng(bins)
    a = rng.gamma(2.0, 50.0, 3_000).round(2)
    df = spark.createDataFrame([(float(x), None if i % 50 == 0 else float("nan") if i % 50 == 1 else -float(x)) for i, x in enumerate(a)], "a double, b double")
    for lower, upper in ((0.001, 0.999), (0.3, 0.3), (0.0, 1.0)):
        got = {r.band: (r.lo, r.hi) for r in clean.thresholds(df, ["a", "b"], Clipping(bins, lower, upper)).collect()}
        for band, x in (("a", a), ("b", np.where(np.arange(len(a)) % 50 < 2, 0.0, -a))):
            mn, mx = x.min(), x.max()
            place = np.minimum(bins - 1, np.floor((x - mn) / (mx - mn) * bins)).astype(int)
            share = np.cumsum(np.bincount(place, minlength=bins)) / len(x)
            edge = lambda p: math.ceil((mn + int(np.flatnonzero((share >= p) & (np.bincount(place, minlength=bins) > 0))[0]) * (mx - mn) / bins) * 100) / 100.0
            assert got[band] == (edge(lower), edge(upper))
    assert clean.thresholds(df.limit(0), ["a"]).count() == 0


def test_added_files_are_the_only_ones_read(spark, tmp_path):
    path, store = str(tmp_path / "px"), str(tmp_path / "states")
    rng = np.random.default_rng(2)
    values = rng.normal(0.5, 0.3, 900)

    def add(lo, hi, files):
        rows = [(float(values[i]), None if i % 7 == 0 else float(i), i % 3) for i in range(lo, hi)]
        spark.createDataFrame(rows, "a double, b double, y int").repartition(files).write.mode("append").parquet(path)

    add(0, 300, 2)
    assert partials.update(spark, path, store, ["a", "b"], (0.0, 1.0, 10), "y") == 2
    add(300, 900, 3)
    assert partials.update(spark, path, store, ["a", "b"], (0.0, 1.0, 10), "y") == 3
    assert partials.update(spark, path, store, ["a", "b"], (0.0, 1.0, 10), "y") == 0
    got = {r.band: r for r in partials.summary(spark, path, store).collect()}
    assert (got["a"].n, got["a"].mn, got["a"].mx, got["a"].positive) == (900, values.min(), values.max(), 300) and got["b"].mn == 0.0
    bins = {r.bin: r.n for r in partials.histogram(spark, path, store).filter("band = 'a'").collect()}
    place = np.clip(np.floor(values * 10), 0, 9).astype(int)
    assert bins == {k: int(n) for k, n in enumerate(np.bincount(place, minlength=10)) if n}
