"""Rasters, polygons and logs derived from the relational tables.

``o_orderkey`` is dense and unique, so it serves as the row-major pixel index of an
optical raster WIDTH pixels wide; line items give the LiDAR bands of their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import ranks, vector
from tessella.params import Grid
from tessella.sources.raster import from_wide, grid_of, with_optional

WIDTH = 50
OPTICAL = {
    "b0": "o_totalprice",
    "b1": "datediff(o_orderdate, date'1990-01-01')",
    "b2": "o_custkey",
    "b3": "substr(o_orderpriority, 1, 1)",
}
BANDS = [*OPTICAL, "l0", "l1"]
TRANSFORM = [300000.0, 0.25, 0.0, 7500000.0, 0.0, -0.25]
#: Epochs of a run.
MAX_EPOCHS = 300


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def optical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_wide(table(spark, sf_dir, "orders"), "o_orderkey", WIDTH, OPTICAL)


def lidar(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("idx"))
    return lines.agg(F.max("l_quantity").alias("l0"), F.max("l_tax").alias("l1"))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_optional(optical(spark, sf_dir), lidar(spark, sf_dir), ["l0", "l1"])


def grid(spark: SparkSession, sf_dir: str) -> Grid:
    return grid_of(optical(spark, sf_dir), WIDTH)


def rings(spark: SparkSession, sf_dir: str, g: Grid) -> DataFrame:
    """A triangle per supplier; some run off the grid, some overlap."""
    x, y = F.col("s_suppkey") * 13 % WIDTH, F.col("s_suppkey") * 37 % g.height
    point = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pid"), F.array(point(0, 0), point(9, 2), point(3, 11)).alias("vertices"))


def labelled(spark: SparkSession, sf_dir: str, pixels: DataFrame, g: Grid) -> DataFrame:
    return vector.rasterize(pixels, vector.edges(rings(spark, sf_dir, g)), g)


def evaluation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels against a prediction by length; unlabelled documents are ignored ones."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    pairs = docs.select("doc_id", "n_chars").join(labels.select("doc_id", "quality"), "doc_id", "left")
    y, pred = F.coalesce("quality", F.lit(255)), (F.col("n_chars") >= 1000).cast("int")
    return pairs.select("doc_id", y.alias("y"), pred.alias("pred"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training logs: each type's events in order, cut into consecutive runs of MAX_EPOCHS.

    A run is an experiment of its own. The first has the name of the type, the n-th
    the type, # and n. All events are used, and no experiment is longer than MAX_EPOCHS.
    """
    run = F.floor((F.col("rank") - 1) / MAX_EPOCHS)
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    rows = ranks.ranked(events, ["ts", "event_id"], ["event_type"]).withColumn("run", run).withColumn("epoch", F.col("rank") - F.col("run") * MAX_EPOCHS)
    y = F.when(F.col("event_id") % 11 == 0, 255).otherwise(F.col("event_id") % 2).cast("int")
    return rows.select(
        F.when(F.col("run") == 0, F.col("event_type")).otherwise(F.concat_ws("#", "event_type", F.col("run") + 1)).alias("experiment"),
        F.col("epoch").cast("bigint").alias("epoch"),
        F.col("value").alias("val_loss"),
        F.floor((F.col("epoch") - 1) / 8).alias("batch"),
        y.alias("y"),
        (F.col("value") >= 100).cast("int").alias("pred"),
    )
