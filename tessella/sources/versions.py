"""Outputs that appear together: a folder per run, and a manifest that is written last.

Readers follow the latest manifest, so a run that ends half-way changes nothing for
them, and a run that is repeated after it was complete writes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "run string, nth bigint, tables array<string>"


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(run, nth, tables): a row per complete run."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{root}/manifests/*")
    except AnalysisException:  # no manifest yet
        return spark.createDataFrame([], _MANIFEST)


def write_version(spark: SparkSession, root: str, run: str, tables: dict[str, DataFrame], partition_by: dict[str, str] | None = None) -> None:
    """Writes all tables of a run and then its manifest; nothing if the run is complete already. One writer at a time."""
    done = manifests(spark, root)
    if not done.filter(F.col("run") == run).isEmpty():
        return
    nth = (done.agg(F.max("nth")).first()[0] or 0) + 1
    for name, df in tables.items():
        writer = df.write.mode("overwrite")  # what a run that ended half-way left is overwritten
        if column := (partition_by or {}).get(name):
            writer = writer.partitionBy(column)
        writer.parquet(f"{root}/runs/{run}/{name}")
    spark.createDataFrame([(run, nth, sorted(tables))], _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/manifests/{run}")


def latest(spark: SparkSession, root: str) -> str:
    found = manifests(spark, root).orderBy(F.col("nth").desc()).first()
    if found is None:
        raise ValueError(f"no complete run at {root}")
    return found["run"]


def read_version(spark: SparkSession, root: str, name: str, run: str | None = None) -> DataFrame:
    """A table of a complete run, by default of the latest."""
    run = run or latest(spark, root)
    if manifests(spark, root).filter((F.col("run") == run) & F.array_contains("tables", name)).isEmpty():
        raise ValueError(f"no complete run {run} with a table {name}")
    return spark.read.parquet(f"{root}/runs/{run}/{name}")
