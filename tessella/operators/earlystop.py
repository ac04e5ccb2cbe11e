"""Early stopping as a fold over an experiment's epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.params import Stopping


def early_stop(log: DataFrame, by: str, rule: Stopping = Stopping()) -> DataFrame:
    """(by, stop_epoch, best_epoch, best_value) from rows (by, epoch, val_loss).

    Up to ``min_epochs`` nothing is kept. The first epoch after is the best so far and
    counts one miss; later ones reset the count if they are better by more than
    ``min_delta``, and add a miss otherwise; more misses than ``patience`` stop. The
    best value moves only by more than the delta, so this is no running minimum. One
    group holds its epochs, a few hundred.
    """
    none = F.lit(None)
    start = F.struct(
        none.cast("bigint").alias("stop"), none.cast("bigint").alias("best_epoch"), none.cast("double").alias("best"), F.lit(0).cast("bigint").alias("misses")
    )

    def step(s, e):
        waiting = s["stop"].isNotNull() | (e["epoch"] <= rule.min_epochs)
        first = s["best"].isNull()
        better = ~first & (s["best"] - e["val"] > rule.min_delta)
        misses = F.when(better, 0).when(first, 1).otherwise(s["misses"] + 1).cast("bigint")
        moved = F.struct(
            F.when(misses > rule.patience, e["epoch"]).alias("stop"),
            F.when(first | better, e["epoch"]).otherwise(s["best_epoch"]).alias("best_epoch"),
            F.when(first | better, e["val"]).otherwise(s["best"]).alias("best"),
            misses.alias("misses"),
        )
        return F.when(waiting, s).otherwise(moved)

    item = F.struct(F.col("epoch").cast("bigint").alias("epoch"), F.col("val_loss").alias("val"))
    folded = log.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("epochs")).withColumn("end", F.aggregate("epochs", start, step))
    return folded.select(by, F.col("end.stop").alias("stop_epoch"), F.col("end.best_epoch").alias("best_epoch"), F.col("end.best").alias("best_value"))
