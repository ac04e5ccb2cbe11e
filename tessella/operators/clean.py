"""Outlier clipping and scaling of bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.scalar import ceil_cents, clip, min_max, no_nan
from tessella.params import Clipping

#: Groups of neighbouring bins that a histogram is counted in before it is refined.
COARSE = 1024


def long_bands(pixels: DataFrame, bands: list[str], mask: Column | None = None) -> DataFrame:
    """(band, x) of the pixels that enter statistics; NaN and null count as 0."""
    rows = pixels if mask is None else pixels.filter(mask != 2)
    pairs = [F.struct(F.lit(b).alias("band"), no_nan(F.col(b)).alias("x")) for b in bands]
    return rows.select(F.inline(F.array(*pairs)))


def extremes(long: DataFrame) -> DataFrame:
    return long.groupBy("band").agg(F.min("x").alias("mn"), F.max("x").alias("mx"))


def histogram(long: DataFrame, bins: int) -> DataFrame:
    """(band, bin, n, mn, mx) with ``bins`` bins of equal width from the least to the largest value."""
    x, mn, mx = F.col("x"), F.col("mn"), F.col("mx")
    placed = F.when(mx > mn, F.least(F.lit(bins - 1), F.floor((x - mn) / (mx - mn) * bins))).otherwise(F.lit(0))
    rows = long.join(F.broadcast(extremes(long)), "band")  # one row per band
    return rows.withColumn("bin", placed.cast("bigint")).groupBy("band", "bin", "mn", "mx").agg(F.count(F.lit(1)).alias("n"))


def _ends(pixels: DataFrame, bands: list[str]) -> dict[str, tuple[float, float]]:
    """Least and largest value of each band, all in one aggregation; none for a raster without pixels."""
    x = {b: no_nan(F.col(b)) for b in bands}
    row = pixels.agg(*[F.min(v).alias(f"mn_{b}") for b, v in x.items()], *[F.max(v).alias(f"mx_{b}") for b, v in x.items()]).first()
    return {b: (row[f"mn_{b}"], row[f"mx_{b}"]) for b in bands if row[f"mn_{b}"] is not None}


def _by_band(values: dict[str, object]) -> Column:
    """The value of the row's band."""
    case = F
    for band, value in values.items():
        case = case.when(F.col("band") == band, value)
    return case


def thresholds(pixels: DataFrame, bands: list[str], how: Clipping = Clipping(), mask: Column | None = None) -> DataFrame:
    """(band, lo, hi, mn, mx): left edges of the bins where the cumulative share reaches the limits, rounded up to cents.

    By refinement: bins are counted in about COARSE groups of neighbours, and only the two
    groups that hold a limit are counted bin by bin. So at most 3 * COARSE counts a
    band are shuffled by a task, whatever the number of bins. Three passes over the pixels:
    extremes, groups, bins; of the first two a row per band reaches the driver.
    """
    rows = pixels if mask is None else pixels.filter(mask != 2)
    ends = _ends(rows, bands)
    if not ends:
        return rows.sparkSession.createDataFrame([], "band string, lo double, hi double, mn double, mx double")
    pairs = []
    for b, (mn, mx) in ends.items():
        place = F.least(F.lit(how.bins - 1), F.floor((no_nan(F.col(b)) - mn) / (F.lit(mx) - F.lit(mn)) * how.bins)) if mx > mn else F.lit(0)
        pairs.append(F.struct(F.lit(b).alias("band"), place.cast("bigint").alias("bin")))
    placed = rows.select(F.inline(F.array(*pairs)))
    width = -(-how.bins // COARSE)
    group = F.floor(F.col("bin") / width)
    counts = placed.groupBy("band", group.alias("group")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("band").orderBy("group").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumns({"reach": F.sum("n").over(order), "total": F.sum("n").over(Window.partitionBy("band"))})
    limits = (("lower", how.lower), ("upper", how.upper))
    first = lambda p: F.min(F.when(F.col("reach") / F.col("total") >= p, F.struct("group", (F.col("reach") - F.col("n")).alias("before"))))
    held = {r["band"]: r for r in counts.groupBy("band").agg(F.first("total").alias("total"), *[first(p).alias(n) for n, p in limits]).collect()}

    at = {n: _by_band({b: F.lit(r[n]["group"]) for b, r in held.items()}) for n, _ in limits}
    fine = placed.filter((group == at["lower"]) | (group == at["upper"])).groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n"))
    of_group = Window.partitionBy("band", group).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fine = fine.withColumn("running", F.sum("n").over(of_group))
    before = {n: _by_band({b: F.lit(r[n]["before"]) for b, r in held.items()}) for n, _ in limits}
    total = _by_band({b: F.lit(r["total"]) for b, r in held.items()})
    bin_of = lambda n, p: F.min(F.when((group == at[n]) & ((before[n] + F.col("running")) / total >= p), F.col("bin")))
    found = fine.groupBy("band").agg(*[bin_of(n, p).alias(n) for n, p in limits])
    mn, mx = (_by_band({b: F.lit(e[i]) for b, e in ends.items()}) for i in (0, 1))
    edge = lambda n: ceil_cents(mn + F.col(n) * (mx - mn) / how.bins)
    return found.select("band", edge("lower").alias("lo"), edge("upper").alias("hi"), mn.alias("mn"), mx.alias("mx"))


def clip_normalise(pixels: DataFrame, bands: list[str], how: Clipping = Clipping(), mask: Column | None = None, prefix: str = "n_") -> DataFrame:
    """Adds each band clipped and scaled as ``prefix`` + name.

    Clipping is monotone, so the extremes after it are the clipped extremes. With a
    mask, the extremes of all pixels are taken in a pass of their own, and without any
    pixel that counts bands stay as they are. A row per band reaches the driver.
    """
    stats = {r["band"]: r for r in thresholds(pixels, bands, how, mask).collect()}
    ends = {b: (r["mn"], r["mx"]) for b, r in stats.items()} if mask is None else _ends(pixels, bands)
    scaled = {}
    for b in bands:
        x = no_nan(F.col(b))
        if b in stats:
            inside = lambda v, lo=stats[b]["lo"], hi=stats[b]["hi"]: clip(v, F.lit(lo), F.lit(hi))
            x = min_max(inside(x), inside(F.lit(ends[b][0])), inside(F.lit(ends[b][1])))
        scaled[prefix + b] = x
    return pixels.withColumns(scaled)
