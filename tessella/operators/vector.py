"""Polygons to pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.params import Grid

#: Columns of a strip in which runs are united and met by pixels.
STRIP = 1024
_EARTH = 6378137.0
_KNOWN = {("EPSG:4326", "EPSG:3857"), ("EPSG:3857", "EPSG:4326")}


def reproject(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Between geographic degrees and spherical Mercator metres; other pairs raise."""
    if source == target:
        return x, y
    if (source, target) not in _KNOWN:
        raise ValueError(f"no projection from {source} to {target}")
    if source == "EPSG:4326":
        return F.radians(x) * _EARTH, F.log(F.tan(math.pi / 4 + F.radians(y) / 2)) * _EARTH
    return F.degrees(x / _EARTH), F.degrees(2 * F.atan(F.exp(y / _EARTH)) - math.pi / 2)


def reproject_rings(rings: DataFrame, source: str, target: str) -> DataFrame:
    def moved(p: Column) -> Column:
        x, y = reproject(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return rings.withColumn("vertices", F.transform("vertices", moved))


def to_grid(rings: DataFrame, transform: list[float]) -> DataFrame:
    """Vertices from map coordinates to pixel coordinates of a north-up raster."""
    gx, dx, _, gy, _, dy = transform
    return rings.withColumn("vertices", F.transform("vertices", lambda p: F.struct(((p["x"] - gx) / dx).alias("x"), ((p["y"] - gy) / dy).alias("y"))))


def edges(rings: DataFrame) -> DataFrame:
    """(pid, x1, y1, x2, y2) of each ring's sides, closed; rings of one polygon share its pid, so holes stay open."""
    v, n = F.col("vertices"), F.size("vertices")
    sides = F.transform(v, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get(v, (i + 1) % n)["x"].alias("x2"), F.get(v, (i + 1) % n)["y"].alias("y2")))
    return rings.select("pid", F.inline(sides))


def _edge_pixel(v: Column) -> Column:
    """First pixel whose centre is not before v."""
    return F.ceil(v - 0.5)


def crossing_spans(edge_table: DataFrame, grid: Grid) -> DataFrame:
    """(row, lo, hi): the runs of pixels whose centre lies in a polygon (even-odd); runs of several polygons may overlap, parts off the grid are cut.

    By scan lines: each side gives its crossing with every pixel row that it spans, the
    crossings of a polygon and row pair up in order, and each pair gives a run.
    """
    y1, y2 = F.col("y1"), F.col("y2")
    top = F.greatest(_edge_pixel(F.least(y1, y2)), F.lit(0).cast("bigint"))
    bottom = F.least(_edge_pixel(F.greatest(y1, y2)) - 1, F.lit(grid.height - 1).cast("bigint"))
    lines = edge_table.withColumn("row", F.explode(F.when(bottom >= top, F.sequence(top, bottom))))
    x = (F.col("x2") - F.col("x1")) * (F.col("row") + 0.5 - y1) / (y2 - y1) + F.col("x1")
    order = Window.partitionBy("pid", "row").orderBy("x")
    spans = lines.select("pid", "row", x.alias("x")).withColumns({"nth": F.row_number().over(order), "end": F.lead("x").over(order)})
    left = F.greatest(_edge_pixel(F.col("x")), F.lit(0).cast("bigint"))
    right = F.least(_edge_pixel(F.col("end")) - 1, F.lit(grid.width - 1).cast("bigint"))
    return spans.filter(F.col("nth") % 2 == 1).select("row", left.alias("lo"), right.alias("hi")).filter("hi >= lo")


def united(spans: DataFrame) -> DataFrame:
    """(row, tile, lo, hi): the same pixels as disjoint runs, cut at every STRIP columns.

    A sweep over the runs of a strip of a row: a run that begins beyond all before it opens
    a new one. The shuffle has a row per run and strip, so it grows with the outlines.
    """
    first, last = F.floor(F.col("lo") / STRIP), F.floor(F.col("hi") / STRIP)
    cut = spans.withColumn("tile", F.explode(F.sequence(first, last)))
    cut = cut.select("row", "tile", F.greatest("lo", F.col("tile") * STRIP).alias("lo"), F.least("hi", (F.col("tile") + 1) * STRIP - 1).alias("hi"))
    cut = cut.groupBy("row", "tile", "lo").agg(F.max("hi").alias("hi"))
    order = Window.partitionBy("row", "tile").orderBy("lo")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    swept = cut.withColumn("opens", (reach.isNull() | (F.col("lo") > reach + 1)).cast("int"))
    swept = swept.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return swept.groupBy("row", "tile", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def covered(pixels: DataFrame, runs: DataFrame, grid: Grid, name: str) -> DataFrame:
    """Adds ``name``: true where a run of ``united`` covers the pixel (idx), else null. A range join by row and strip; runs are disjoint, so no pixel is doubled."""
    row, col = F.floor(F.col("idx") / grid.width), F.pmod(F.col("idx"), F.lit(grid.width))
    spots = pixels.withColumns({"row__": row, "col__": col, "tile__": F.floor(col / STRIP)})
    runs = runs.select(F.col("row").alias("row__"), F.col("tile").alias("tile__"), "lo", "hi")
    same = (spots["row__"] == runs["row__"]) & (spots["tile__"] == runs["tile__"]) & spots["col__"].between(runs["lo"], runs["hi"])
    out = spots.join(runs, same, "left")
    return out.select(*[spots[c] for c in pixels.columns], F.when(runs["lo"].isNotNull(), True).alias(name))


def burned(edge_table: DataFrame, grid: Grid) -> DataFrame:
    """idx of the pixels whose centre lies in a polygon, each once."""
    runs = united(crossing_spans(edge_table, grid))
    return runs.withColumn("col", F.explode(F.sequence("lo", "hi"))).select((F.col("row") * grid.width + F.col("col")).alias("idx"))


def rasterize(pixels: DataFrame, edge_table: DataFrame, grid: Grid, burn: int = 1, fill: int = 0) -> DataFrame:
    """All pixels with ``y``: burn inside polygons, fill elsewhere."""
    hit = covered(pixels, united(crossing_spans(edge_table, grid)), grid, "hit__")
    return hit.withColumn("y", F.when(F.col("hit__"), burn).otherwise(fill)).drop("hit__")
