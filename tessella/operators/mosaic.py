"""Overlapping window scores to one prediction per pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalar import argmax, truncated
from tessella.operators.grid import covering
from tessella.params import Grid, Windows


def window_votes(pixels: DataFrame, grid: Grid, size: int, overlaps: tuple[float, ...], score: dict[str, Column]) -> DataFrame:
    """(overlap, wid, idx, scores): windows over the raster padded by one window, at each overlap.

    One scan serves all overlaps: a pixel first becomes a row per overlap with the ranges
    of its windows, then a row per window. ``score`` may use wr, wc and all columns.
    """
    kinds = []
    for overlap in overlaps:
        w = Windows.at_overlap(size, overlap)
        rows, cols = covering(F.col("row") + size, w, grid.height + 2 * size), covering(F.col("col") + size, w, grid.width + 2 * size)
        n = F.lit(w.count(grid.width + 2 * size)).cast("bigint")
        kinds.append(F.struct(F.lit(float(overlap)).alias("overlap"), rows.alias("rows__"), cols.alias("cols__"), n.alias("n__")))
    out = pixels.select("*", F.inline(F.array(*kinds)))
    out = out.withColumn("wr", F.explode("rows__")).withColumn("wc", F.explode("cols__"))
    return out.select("overlap", (F.col("wr") * F.col("n__") + F.col("wc")).alias("wid"), "idx", *[c.alias(n) for n, c in score.items()])


def average(votes: DataFrame, scores: list[str], overlaps: tuple[float, ...], vote: str = "prob") -> DataFrame:
    """(idx, scores): the mean over overlaps of each overlap's mean vote.

    Not a pooled mean: an overlap counts the same however many windows it has. All
    overlaps are averaged side by side in one aggregation by pixel. With
    ``vote="truncate"``, scores are cut to whole numbers first.
    """
    cut = truncated if vote == "truncate" else lambda s: s
    per = {s: [F.avg(F.when(F.col("overlap") == float(o), cut(F.col(s)))) for o in overlaps] for s in scores}
    rows = votes.groupBy("idx").agg(*[F.array_compact(F.array(*means)).alias(s) for s, means in per.items()])
    mean = lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s)
    return rows.select("idx", *[mean(F.col(s)).alias(s) for s in scores])


def classify(prediction: DataFrame, scores: list[str]) -> DataFrame:
    """Adds ``cls``, the class of the largest score; ties go to the first class."""
    return prediction.withColumn("cls", argmax(F.array(*scores)))
