"""Ranks over a whole table without a task that sees the whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.sources.scratch import kept

#: Rows that one task ranks, about.
RANGE_ROWS = 65_536


def ranked(rows: DataFrame, order: list[str], by: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``rank`` from 1 in the order of ``order``, nulls first, and the ``total`` number of rows; within each group of ``by`` if given.

    Spark samples the keys and deals the rows to ranges, as many as the table needs for
    about ``range_rows`` each, so a burst of close keys is several ranges. Ranges are written
    with their number, counted, ranked by themselves and offset by the ranges before:
    a row per range and group.
    """
    by, columns = by or [], rows.columns
    rows = kept(rows, "to-rank")
    n = max(1, -(-rows.count() // range_rows))
    dealt = rows.repartitionByRange(n, *by, *order).withColumn("range__", F.spark_partition_id())
    if n > 1:
        dealt = kept(dealt, "ranges")
    sizes = dealt.groupBy(*by, "range__").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.partitionBy(*by))
    names = [F.col(c).alias(f"{c}__of") for c in by]
    offsets = sizes.select(*names, F.col("range__").alias("range__of"), F.coalesce(before, F.lit(0)).alias("offset__"), total.alias("total"))
    inside = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "range__").orderBy(*order)))
    same = reduce(lambda a, b: a & b, [inside[c].eqNullSafe(offsets[f"{c}__of"]) for c in by], inside["range__"] == offsets["range__of"])
    joined = inside.join(offsets, same)
    return joined.select(*columns, (F.col("rank") + F.col("offset__")).cast("bigint").alias("rank"), "total")
