"""Scoring of whole patches: chips as one row per window, and votes that come back as cells.

The padded raster is cut into square cells whose side divides the window size and all
steps, so every window of every overlap is a block of whole cells. Pixels are gathered
into cells once; cells, packed as arrays, are dealt to the windows that cover them, and a
scorer sees arrays (windows, bands, size, size). Its scores go back as cells too, so no
row per pixel and vote is ever shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.grid import covering
from tessella.params import Grid, Windows

Scorer = Callable[[np.ndarray], np.ndarray]

#: Rows and bytes of one Arrow batch of chips.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20
_CELLS = "array<struct<r: int, c: int, places: array<int>, values: array<double>>>"


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bounds the rows and bytes of an Arrow batch in this session; bounds are only ever lowered."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = (spark.conf.get(key, None) or "").lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def images(at: Column, length: int, pad: int) -> Column:
    """Where an axis padded by ``pad`` mirrored pixels on each side shows the pixel ``at``: an array of places from the padded edge."""
    if length == 1:
        return F.sequence(F.lit(0).cast("bigint"), F.lit(2 * pad).cast("bigint"))
    period = 2 * (length - 1)
    turns = range(-((pad + length) // period) - 1, (pad + length) // period + 2)
    places = F.array(*[x.cast("bigint") for k in turns for x in (at + k * period, k * period - at)])
    inside = F.filter(F.array_distinct(places), lambda i: i.between(-pad, length - 1 + pad))
    return F.transform(inside, lambda i: i + pad)


def cell_side(size: int, overlaps: tuple[float, ...]) -> int:
    """The largest cell that all windows are made of."""
    return math.gcd(size, *[Windows.at_overlap(size, o).step for o in overlaps])


def _packed(items: Column, bands: int) -> tuple[Column, Column]:
    """places, and values band by band, of an array of (place, x) in the order of places."""
    ordered = F.array_sort(items)
    band = lambda i: F.transform(ordered, lambda e: e["x"][i])
    values = F.flatten(F.array(*map(band, range(bands))))
    return F.transform(ordered, lambda e: e["place"]), values


def cells(pixels: DataFrame, grid: Grid, bands: list[str], side: int, pad: int = 0) -> DataFrame:
    """(tr, tc, places, values): the cells of the raster padded by ``pad`` mirrored pixels on each side."""
    rows = pixels.withColumn("pr__", F.explode(images(F.col("row"), grid.height, pad))).withColumn("pc__", F.explode(images(F.col("col"), grid.width, pad)))
    pr, pc = F.col("pr__"), F.col("pc__")
    place = ((pr % side) * side + pc % side).cast("int")
    item = F.struct(place.alias("place"), F.array(*[F.col(b).cast("double") for b in bands]).alias("x"))
    grouped = rows.groupBy(F.floor(pr / side).alias("tr"), F.floor(pc / side).alias("tc")).agg(F.collect_list(item).alias("items"))
    places, values = _packed(F.col("items"), len(bands))
    return grouped.select("tr", "tc", places.alias("places"), values.alias("values"))


def chips(cell_table: DataFrame, grid: Grid, size: int, overlaps: tuple[float, ...], side: int, pad: int = 0) -> DataFrame:
    """(overlap, wid, wr, wc, cells): a row per window, with the cells that it covers."""
    kinds = []
    for o in overlaps:
        step = Windows.at_overlap(size, o).step
        w = Windows(size // side, step // side)
        rows, cols = (covering(F.col(c), w, (n + 2 * pad) // side) for c, n in (("tr", grid.height), ("tc", grid.width)))
        n = F.lit(w.count((grid.width + 2 * pad) // side)).cast("bigint")
        kinds.append(F.struct(F.lit(float(o)).alias("overlap"), rows.alias("rows__"), cols.alias("cols__"), n.alias("n__"), F.lit(step // side).alias("step__")))
    out = cell_table.select("*", F.inline(F.array(*kinds))).withColumn("wr", F.explode("rows__")).withColumn("wc", F.explode("cols__"))
    r, c = F.col("tr") - F.col("wr") * F.col("step__"), F.col("tc") - F.col("wc") * F.col("step__")
    cell = F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"), "places", "values")
    wid = (F.col("wr") * F.col("n__") + F.col("wc")).alias("wid")
    return out.groupBy("overlap", wid, "wr", "wc").agg(F.collect_list(cell).cast(_CELLS).alias("cells"))


def assembled(column: pa.Array, bands: int, size: int, side: int) -> np.ndarray:
    """(windows, bands, size, size) from a column of cells; pixels that no cell holds are 0."""
    found = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    per_window = np.diff(found.offsets.to_numpy())
    r, c, places, values = found.flatten().flatten()
    lengths = places.value_lengths().to_numpy()
    starts = np.concatenate(([0], np.cumsum(lengths * bands)))[:-1]
    cell = np.repeat(np.arange(len(lengths)), lengths)
    nth = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    window = np.repeat(np.arange(len(per_window)), per_window)[cell]
    at = places.flatten().to_numpy()
    row, col = r.to_numpy()[cell] * side + at // side, c.to_numpy()[cell] * side + at % side
    x = values.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(per_window), bands, size, size))
    for k in range(bands):
        out[window, k, row, col] = x[starts[cell] + k * lengths[cell] + nth]
    return out


def as_lists(rows: np.ndarray) -> pa.Array:
    """A list per row of a two-dimensional array."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(rows, dtype=np.float64).ravel()))


def score_patches(
    chip_table: DataFrame, grid: Grid, bands: int, size: int, overlaps: tuple[float, ...], side: int, pad: int, scorer: Scorer, classes: int, batch: int = 128
) -> DataFrame:
    """(overlap, tr, tc, scores): the scores of each window cell by cell, cells of the padding left out.

    ``scorer`` takes (windows, bands, size, size), at most ``batch`` windows at a time,
    and returns (windows, classes, size, size).
    """
    bounded_batches(chip_table.sparkSession)
    steps = {float(o): Windows.at_overlap(size, o).step // side for o in overlaps}
    k, low = size // side, pad // side
    high_r, high_c = -(-(pad + grid.height) // side), -(-(pad + grid.width) // side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                scores = np.asarray(scorer(assembled(b.column(3), bands, size, side)))
                if scores.shape != (b.num_rows, classes, size, size):
                    raise ValueError(f"the scorer returned {scores.shape}")
                overlap = b.column(0).to_numpy()
                step = np.array([steps[o] for o in overlap.tolist()], dtype=np.int64)
                rows = (b.column(1).to_numpy() * step)[:, None, None] + np.arange(k)[:, None]
                cols = (b.column(2).to_numpy() * step)[:, None, None] + np.arange(k)[None, :]
                rows, cols = (np.broadcast_to(x, (b.num_rows, k, k)).ravel() for x in (rows, cols))
                cut = scores.reshape(b.num_rows, classes, k, side, k, side).transpose(0, 2, 4, 1, 3, 5).reshape(-1, classes * side * side)
                use = np.flatnonzero((rows >= low) & (rows < high_r) & (cols >= low) & (cols < high_c))
                columns = [pa.array(np.repeat(overlap, k * k)[use]), pa.array(rows[use]), pa.array(cols[use]), as_lists(cut[use])]
                yield pa.RecordBatch.from_arrays(columns, names=["overlap", "tr", "tc", "scores"])

    return chip_table.select("overlap", "wr", "wc", "cells").mapInArrow(run, "overlap double, tr bigint, tc bigint, scores array<double>")


def average_cells(scored: DataFrame, grid: Grid, overlaps: tuple[float, ...], side: int, pad: int, classes: int, vote: str = "prob") -> DataFrame:
    """(idx, row, col, p0, p1, ...): the mean over overlaps of each overlap's mean vote, pixel by pixel.

    A cell has as many votes as windows cover it, (size / step)^2 for each overlap.
    """
    n = side * side
    cut = (lambda s: F.transform(s, lambda x: F.floor(x).cast("double"))) if vote == "truncate" else (lambda s: s)
    rows = scored.groupBy("tr", "tc").agg(F.collect_list(F.struct("overlap", cut(F.col("scores")).alias("s"))).alias("votes"))
    zeros = F.array_repeat(F.lit(0.0), classes * n)
    total = lambda votes: F.aggregate(votes, zeros, lambda acc, v: F.zip_with(acc, v["s"], lambda x, y: x + y))

    def mean(o: float) -> Column:
        mine = F.filter("votes", lambda v: v["overlap"] == o)
        return F.when(F.size(mine) > 0, F.struct(F.transform(total(mine), lambda x: x / F.size(mine)).alias("s")))

    rows = rows.select("tr", "tc", F.array_compact(F.array(*[mean(float(o)) for o in overlaps])).alias("means"))
    rows = rows.select("tr", "tc", F.size("means").alias("n"), total(F.col("means")).alias("sums"))
    pixel = lambda i: F.struct(i.alias("place"), *[(F.get("sums", (i + k * n).cast("int")) / F.col("n")).alias(f"p{k}") for k in range(classes)])
    out = rows.select("tr", "tc", F.inline(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), pixel)))
    row, col = F.col("tr") * side + F.floor(F.col("place") / side) - pad, F.col("tc") * side + F.col("place") % side - pad
    out = out.select(row.alias("row"), col.alias("col"), *[f"p{k}" for k in range(classes)])
    out = out.filter(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))
    return out.select((F.col("row") * grid.width + F.col("col")).alias("idx"), "row", "col", *[f"p{k}" for k in range(classes)])


def patch_mosaic(
    pixels: DataFrame, grid: Grid, bands: list[str], size: int, overlaps: tuple[float, ...], scorer: Scorer, classes: int = 2, batch: int = 128, vote: str = "prob"
) -> DataFrame:
    """One prediction per pixel by a scorer of whole patches, over the raster padded by one mirrored patch on each side, at each overlap."""
    side = cell_side(size, overlaps)
    table = chips(cells(pixels, grid, bands, side, size), grid, size, overlaps, side, size)
    scored = score_patches(table, grid, len(bands), size, overlaps, side, size, scorer, classes, batch)
    return average_cells(scored, grid, overlaps, side, size, classes, vote)


def transform_windows(rows: DataFrame, bands: list[str], size: int, transform: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A function over whole windows: rows (wid, r, c, bands) as an array (bands, size, size), and back."""
    bounded_batches(rows.sparkSession)
    place = (F.col("r") * size + F.col("c")).cast("int")
    item = F.struct(place.alias("place"), F.array(*[F.col(b).cast("double") for b in bands]).alias("x"))
    places, values = _packed(F.col("items"), len(bands))
    cell = F.struct(F.lit(0).alias("r"), F.lit(0).alias("c"), places.alias("places"), values.alias("values"))
    grouped = rows.groupBy("wid").agg(F.collect_list(item).alias("items")).select("wid", F.array(cell).cast(_CELLS).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.asarray(transform(chip), dtype=np.float64).ravel() for chip in assembled(b.column(1), len(bands), size, size)]
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), as_lists(np.stack(out))], names=["wid", "values"])

    n = size * size
    pixel = lambda i: F.struct(F.floor(i / size).alias("r"), (i % size).cast("bigint").alias("c"), *[F.get("values", i + k * n).alias(b) for k, b in enumerate(bands)])
    done = grouped.mapInArrow(run, f"wid {rows.schema['wid'].dataType.simpleString()}, values array<double>")
    return done.select("wid", F.inline(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), pixel)))
