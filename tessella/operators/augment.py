"""Quarter turns and flips of windows, as maps of coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(seed: int, epoch: int, wid: Column) -> tuple[Column, Column, Column]:
    """Quarter turns 0 to 3, horizontal and vertical flip: one hex digit of a hash per window and epoch."""
    digit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), wid.cast("string"))), 1, 1), 16, 10).cast("bigint")
    return digit % 4, F.floor(digit / 4) % 2, F.floor(digit / 8)


def turned(r: Column, c: Column, size: int, turns: Column) -> tuple[Column, Column]:
    last = size - 1
    row = F.when(turns == 1, last - c).when(turns == 2, last - r).when(turns == 3, c).otherwise(r)
    col = F.when(turns == 1, r).when(turns == 2, last - c).when(turns == 3, last - r).otherwise(c)
    return row, col


def augment(pixels: DataFrame, size: int, seed: int, epoch: int) -> DataFrame:
    """Moves the pixels (wid, r, c, ...) of each window: turns first, then the flips. All bands and the label move alike."""
    turns, across, down = draw(seed, epoch, F.col("wid"))
    row, col = turned(F.col("r"), F.col("c"), size, turns)
    last = size - 1
    col = F.when(across == 1, last - col).otherwise(col)
    row = F.when(down == 1, last - row).otherwise(row)
    return pixels.withColumns({"r": row, "c": col})
