"""Neighbourhood filters, resampling and arithmetic of rasters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.patches import as_lists, assembled, bounded_batches, images
from tessella.params import Grid

#: Pixels along the side of a tile.
TILE = 64


def focal3x3(pixels: DataFrame, grid: Grid, kernel: list[list[float]], band: str, stride: int = 1, edge: str = "reflect", tile: int = TILE) -> DataFrame:
    """(idx, row, col, value): weighted sum over each pixel's 3 x 3 neighbourhood.

    Pixels are dealt to square tiles with a border of one pixel, about 1 + 4 / tile rows
    each, and filtered as arrays. Beyond the edge, rows and columns are mirrored, or
    zero; missing pixels count as zero. With a stride, only every n-th row and column is
    kept, numbered anew.
    """
    bounded_batches(pixels.sparkSession)
    shown = (lambda c, n: F.explode(F.transform(images(F.col(c), n, 1), lambda i: i - 1))) if edge == "reflect" else (lambda c, n: F.col(c))
    rows = pixels.select(shown("row", grid.height).alias("r"), "col", F.col(band).cast("double").alias("x")).select("r", shown("col", grid.width).alias("c"), "x")
    for at, of, n in (("r", "tr", grid.height), ("c", "tc", grid.width)):
        first, last = F.greatest(F.floor((F.col(at) - 1) / tile), F.lit(0)), F.least(F.floor((F.col(at) + 1) / tile), F.lit((n - 1) // tile))
        rows = rows.withColumn(of, F.explode(F.when(last >= first, F.sequence(first, last))))
    side = tile + 2
    place = ((F.col("r") - F.col("tr") * tile + 1) * side + F.col("c") - F.col("tc") * tile + 1).cast("int")
    tiles = rows.groupBy("tr", "tc").agg(F.collect_list(F.struct(place.alias("place"), "x")).alias("items"))
    cell = F.struct(F.lit(0).alias("r"), F.lit(0).alias("c"), F.col("items.place").alias("places"), F.col("items.x").alias("values"))
    weights = np.asarray(kernel, dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = assembled(b.column(2), 1, side, side)[:, 0]
            out = sum(weights[i, j] * x[:, i : i + tile, j : j + tile] for i in range(3) for j in range(3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), as_lists(out.reshape(len(x), -1))], names=["tr", "tc", "out"])

    done = tiles.select("tr", "tc", F.array(cell).alias("cells")).mapInArrow(run, "tr bigint, tc bigint, out array<double>")
    done = done.select("tr", "tc", F.posexplode("out").alias("place", "value"))
    row, col = F.col("tr") * tile + F.floor(F.col("place") / tile), F.col("tc") * tile + F.col("place") % tile
    done = done.select(row.alias("row"), col.alias("col"), "value")
    done = done.filter((F.col("row") < grid.height) & (F.col("col") < grid.width) & (F.col("row") % stride == 0) & (F.col("col") % stride == 0))
    done = done.select(F.expr(f"row div {stride}").alias("row"), F.expr(f"col div {stride}").alias("col"), "value")
    return done.select((F.col("row") * -(-grid.width // stride) + F.col("col")).alias("idx"), "row", "col", "value")


def upsample2(pixels: DataFrame, grid: Grid, bands: list[str]) -> DataFrame:
    """Each pixel becomes four of twice the resolution."""
    cells = F.array(*[F.struct((2 * F.col("row") + i).alias("nr"), (2 * F.col("col") + j).alias("nc")) for i in (0, 1) for j in (0, 1)])
    out = pixels.select(*bands, F.inline(cells))
    return out.select((F.col("nr") * 2 * grid.width + F.col("nc")).alias("idx"), F.col("nr").alias("row"), F.col("nc").alias("col"), *bands)


def add(a: DataFrame, b: DataFrame, bands: list[str]) -> DataFrame:
    """Bandwise sum of two rasters on one grid."""
    right = b.select("idx", *[F.col(x).alias(f"{x}__") for x in bands])
    return a.join(right, "idx").select("idx", *[(F.col(x) + F.col(f"{x}__")).alias(x) for x in bands])


def stack(a: DataFrame, b: DataFrame, a_bands: list[str], b_bands: list[str]) -> DataFrame:
    """All bands of both rasters side by side."""
    return a.select("idx", *a_bands).join(b.select("idx", *b_bands), "idx")
