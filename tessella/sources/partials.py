"""Statistics that merge: a state per file, made once, so that an added raster is the only one that is read.

A state holds, per band, the number of values, their extremes and counts in bins of fixed
edges; and for a label the numbers of pixels and of positive ones. States of files add up
to those of all, so what is derived from them equals a full pass.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalar import no_nan

_STATE = "file string, size bigint, changed timestamp, band string, n bigint, mn double, mx double, bins map<bigint, bigint>, positive bigint"


def _states(spark: SparkSession, store: str) -> DataFrame:
    try:
        return spark.read.schema(_STATE).parquet(store)
    except AnalysisException:  # no state yet
        return spark.createDataFrame([], _STATE)


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def update(spark: SparkSession, path: str, store: str, bands: list[str], edges: tuple[float, float, int] = (0.0, 1.0, 100), label: str | None = None) -> int:
    """Adds the states of those Parquet files at ``path`` that have none yet, or have changed since; returns how many were read.

    ``edges``: least edge, greatest edge and number of bins; values beyond fall into
    the outermost. Files' names, not their rows, reach the driver.
    """
    known = _states(spark, store).select("file", "size", "changed").distinct()
    new = [r["file"] for r in _files(spark, path).join(known, ["file", "size", "changed"], "left_anti").collect()]
    if not new:
        return 0
    low, high, bins = edges
    rows = spark.read.parquet(*new)
    place = lambda x: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((x - low) / (high - low) * bins))).cast("bigint")
    hit = (F.col(label) == 1).cast("bigint") if label else F.lit(None).cast("bigint")
    values = [F.struct(F.lit(b).alias("band"), no_nan(F.col(b).cast("double")).alias("x"), hit.alias("hit")) for b in bands]
    long = rows.select(F.col("_metadata.file_path").alias("file"), F.inline(F.array(*values)))
    counts = long.groupBy("file", "band", place(F.col("x")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx"), F.sum("hit").alias("positive")
    )
    per_file = counts.groupBy("file", "band").agg(
        F.sum("n").alias("n"), F.min("mn").alias("mn"), F.max("mx").alias("mx"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("positive").alias("positive")
    )
    listed = _files(spark, path)
    same = F.regexp_replace(per_file["file"], "^file:/+", "/") == F.regexp_replace(listed["file"], "^file:/+", "/")
    out = per_file.join(listed, same).select(listed["file"], "size", "changed", "band", "n", "mn", "mx", "bins", "positive")
    out.write.mode("append").parquet(store)
    return len(new)


def _current(spark: SparkSession, path: str, store: str) -> DataFrame:
    """The states of the files that are there now, as they are now; each once."""
    return _states(spark, store).join(_files(spark, path), ["file", "size", "changed"], "left_semi").dropDuplicates(["file", "band"])


def summary(spark: SparkSession, path: str, store: str) -> DataFrame:
    """(band, n, mn, mx, positive) over all files."""
    total = _current(spark, path, store).groupBy("band")
    return total.agg(F.sum("n").alias("n"), F.min("mn").alias("mn"), F.max("mx").alias("mx"), F.sum("positive").alias("positive"))


def histogram(spark: SparkSession, path: str, store: str) -> DataFrame:
    """(band, bin, n) over all files."""
    rows = _current(spark, path, store).select("band", F.explode("bins").alias("bin", "n"))
    return rows.groupBy("band", "bin").agg(F.sum("n").alias("n"))
