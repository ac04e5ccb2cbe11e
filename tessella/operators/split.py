"""Choice of windows, and their division into training, validation and test sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import ranks
from tessella.operators.vector import covered, united
from tessella.params import IGNORE, Grid, Split, Windows


def keep(windows: DataFrame, how: Split) -> DataFrame:
    """Windows with at least the least positive share."""
    return windows.filter(F.col("frac") >= how.min_positive)


def shuffle_key(seed: object, wid: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), wid.cast("string")))


def ranked(windows: DataFrame, key: Column) -> DataFrame:
    """Adds ``rank`` from 1 in the order of key, wid, and the ``total`` number of rows."""
    return ranks.ranked(windows.withColumn("key", key), ["key", "wid"]).drop("key")


def first(ranked_windows: DataFrame, n: int) -> DataFrame:
    """The first n windows by rank, for trial runs."""
    return ranked_windows.filter(F.col("rank") <= n)


def split(windows: DataFrame, how: Split) -> DataFrame:
    """Adds ``rank`` and ``split``; test first, then validation, then training."""
    rank, n = F.col("rank"), F.col("total")
    n_test = F.lit(0) if how.mode == "separate" else F.floor(F.lit(how.test) * n)
    n_val = F.floor(F.lit(how.validation) * (n - n_test))
    name = F.when(rank <= n_test, "test").when(rank <= n_test + n_val, "val").otherwise("train")
    return ranked(windows, shuffle_key(how.seed, F.col("wid"))).withColumn("split", name).drop("total")


def counts(windows: DataFrame) -> DataFrame:
    return windows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def test_label(label: DataFrame, test_windows: DataFrame, grid: Grid, w: Windows) -> DataFrame:
    """Pixels in any test window keep their label, all others get the ignored one. Windows are runs of pixels, one per row, and runs are united."""
    side = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(w.size - 1).cast("bigint")))
    runs = test_windows.select((F.col("wr") * w.step).alias("row0"), (F.col("wc") * w.step).alias("lo"), side.alias("r"))
    runs = runs.select((F.col("row0") + F.col("r")).alias("row"), "lo", (F.col("lo") + (w.size - 1)).alias("hi"))
    hit = covered(label.select("idx", "y"), united(runs), grid, "hit")
    return hit.select("idx", F.when(F.col("hit"), F.col("y")).otherwise(IGNORE).alias("y"))


def batched(ranked_windows: DataFrame, batch_size: int) -> DataFrame:
    """Adds ``batch`` to windows with a rank; the last batch may be short."""
    return ranked_windows.withColumn("batch", F.floor((F.col("rank") - 1) / batch_size))


def shuffled_batches(windows: DataFrame, seed: int, epoch: int, batch_size: int) -> DataFrame:
    """Adds ``rank`` and ``batch`` in an order of its own for each epoch."""
    return batched(ranked(windows, shuffle_key(f"{seed}:{epoch}", F.col("wid"))).drop("total"), batch_size)
