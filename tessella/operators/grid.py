"""Linear indices, sliding windows and padding, as arithmetic on pixel rows.

Windows are never stored as pixel lists: a pixel's windows follow from its row
and column, and the rows for them are generated where they are needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalar import reflected
from tessella.params import Grid, Windows


def to_idx(row: Column, col: Column, width: int) -> Column:
    return row.cast("bigint") * width + col


def row_of(idx: Column, width: int) -> Column:
    return F.floor(idx / width)


def col_of(idx: Column, width: int) -> Column:
    return F.pmod(idx, F.lit(width)).cast("bigint")


def covering(at: Column, w: Windows, length: int) -> Column:
    """The windows of an axis that cover a place, as an array; null where none does."""
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((at - (w.size - 1)) / float(w.step)))
    last = F.least(F.floor(at / float(w.step)), F.lit(w.count(length) - 1).cast("bigint"))
    return F.when(last >= first, F.sequence(first, last))


def explode_windows(pixels: DataFrame, grid: Grid, w: Windows, pad: int = 0) -> DataFrame:
    """Each pixel once per window (wid, wr, wc) that covers it.

    With ``pad``, windows lie over the raster padded on all sides, and padded pixels
    themselves are never made: every pixel of the raster is still covered.
    """
    out = pixels.withColumn("wr", F.explode(covering(F.col("row") + pad, w, grid.height + 2 * pad)))
    out = out.withColumn("wc", F.explode(covering(F.col("col") + pad, w, grid.width + 2 * pad)))
    return out.withColumn("wid", F.col("wr") * w.count(grid.width + 2 * pad) + F.col("wc"))


def window_table(spark: SparkSession, grid: Grid, w: Windows) -> DataFrame:
    """(wid, wr, wc, row0, col0) of all whole windows."""
    cols = w.count(grid.width)
    ids = spark.range(w.count(grid.height) * cols).withColumnRenamed("id", "wid")
    ids = ids.withColumns({"wr": F.floor(F.col("wid") / cols), "wc": F.col("wid") % cols})
    return ids.withColumns({"row0": F.col("wr") * w.step, "col0": F.col("wc") * w.step})


def window_pixels(windows: DataFrame, grid: Grid, w: Windows) -> DataFrame:
    """(wid, r, c, idx): the pixels of given windows, generated from their corners."""
    side = F.sequence(F.lit(0).cast("bigint"), F.lit(w.size - 1).cast("bigint"))
    rows = windows.withColumn("r", F.explode(side)).withColumn("c", F.explode(side))
    return rows.withColumn("idx", (F.col("row0") + F.col("r")) * grid.width + F.col("col0") + F.col("c")).drop("row0", "col0", "wr", "wc")


def pixels_in(windows: DataFrame, pixels: DataFrame, grid: Grid, w: Windows) -> DataFrame:
    """The pixels of given windows: all columns of the pixel, r, c and those of its window but wr and wc.

    Each pixel names its windows and meets them by number. The rows that the numbers multiply are
    the pixels, so a table of windows that Spark sends to all tasks has a row per window; pixels
    generated from windows (``window_pixels``) would be sent as a row per window and pixel.
    """
    at = explode_windows(pixels, grid, w)
    at = at.withColumns({"r": F.col("row") - F.col("wr") * w.step, "c": F.col("col") - F.col("wc") * w.step})
    return at.drop("wr", "wc").join(windows.drop("wr", "wc"), "wid")


def window_fraction(pixels: DataFrame, positive: Column, grid: Grid, w: Windows) -> DataFrame:
    """(wid, wr, wc, frac): share of positive pixels in each window.

    Pixels are summed to blocks of the largest side that divides size and step. Blocks
    are dealt to the columns of windows first and summed, and only then to their
    rows: size / step rows per block and sum, not its square, and no pixel is
    repeated unless size and step have no common divisor.
    """
    side = math.gcd(w.size, w.step)
    blocks = pixels.select(F.floor(F.col("row") / side).alias("br"), F.floor(F.col("col") / side).alias("bc"), positive.cast("int").alias("hit"))
    blocks = blocks.groupBy("br", "bc").agg(F.sum("hit").alias("hit"))
    per = Windows(w.size // side, w.step // side)
    w.count(grid.height)  # raises for a raster shorter than a window
    strips = blocks.withColumn("wc", F.explode(covering(F.col("bc"), per, grid.width // side))).groupBy("br", "wc").agg(F.sum("hit").alias("hit"))
    sums = strips.withColumn("wr", F.explode(covering(F.col("br"), per, grid.height // side))).groupBy("wr", "wc").agg(F.sum("hit").alias("hits"))
    wid = F.col("wr") * w.count(grid.width) + F.col("wc")
    return sums.select(wid.alias("wid"), "wr", "wc", (F.col("hits") / float(w.size * w.size)).alias("frac"))


def reflect_pad(pixels: DataFrame, grid: Grid, pad: int) -> DataFrame:
    """The raster with ``pad`` mirrored pixels on each side: prow, pcol and all columns of the source pixel."""
    spark = pixels.sparkSession

    def axis(length: int, name: str, source: str) -> DataFrame:
        ids = spark.range(length + 2 * pad)
        return ids.select(F.col("id").alias(name), reflected(F.col("id") - pad, length).alias(source))

    # one row per row and per column of the padded raster
    rows, cols = axis(grid.height, "prow", "row"), axis(grid.width, "pcol", "col")
    return pixels.join(rows, "row").join(cols, "col")


def crop(pixels: DataFrame, grid: Grid, pad: int) -> DataFrame:
    """The inner part of a padded raster, with its own rows and columns again."""
    inside = F.col("prow").between(pad, pad + grid.height - 1) & F.col("pcol").between(pad, pad + grid.width - 1)
    return pixels.filter(inside).withColumns({"row": F.col("prow") - pad, "col": F.col("pcol") - pad})


def constant(spark: SparkSession, grid: Grid, value: float, name: str = "value") -> DataFrame:
    ids = spark.range(grid.height * grid.width).withColumnRenamed("id", "idx")
    return ids.withColumns({"row": F.floor(F.col("idx") / grid.width), "col": F.col("idx") % grid.width, name: F.lit(value)})
