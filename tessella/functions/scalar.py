"""Column functions for bands, scores and indices; all run as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ceil_cents(x: Column) -> Column:
    """Rounded up to two decimals."""
    return F.ceil(x * 100) / F.lit(100.0)


def no_nan(x: Column) -> Column:
    """NaN and null become 0."""
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def clip(x: Column, lo: Column, hi: Column) -> Column:
    """The upper bound first, then the lower one."""
    return F.greatest(F.least(x, hi), lo)


def min_max(x: Column, lo: Column, hi: Column) -> Column:
    """Scaled to [0, 1]; a constant band stays as it is."""
    return F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(x)


def softmax(z: Column) -> Column:
    """Of an array of scores; the largest is subtracted first."""
    e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))


def argmax(p: Column) -> Column:
    """Index of the largest value, the first one among ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def truncated(p: Column) -> Column:
    """Towards zero, as a cast to an unsigned byte does for scores in [0, 1]."""
    return F.floor(p).cast("double")


def first_bands(bands: Column, n: int) -> Column:
    return F.slice(bands, 1, n)


def listed_bands(bands: Column, which: tuple[int, ...] | None) -> Column:
    """The bands at these places; all of them for None."""
    return bands if which is None else F.array(*[F.get(bands, F.lit(i)) for i in which])


def remapped(value: Column, mapping: dict[int, int]) -> Column:
    """Mapped classes, null for those that the mapping lacks."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), value)


def reflected(i: Column, length: int) -> Column:
    """Source index of a padded index: mirrored without repeating the edge."""
    if length == 1:
        return F.lit(0).cast("bigint")
    m = F.pmod(i, F.lit(2 * (length - 1)))
    return F.when(m < length, m).otherwise(2 * (length - 1) - m)


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))
