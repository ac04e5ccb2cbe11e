"""Pieces shared by the training-data operators: tables, scratch space, text constants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.scratch import folder as scratch  # noqa: F401
from tessella.sources.scratch import kept as written  # noqa: F401

#: A word is a run of characters other than the six ASCII white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch. Documents may be megabytes long, so batches end by bytes.
BATCH_ROWS, BATCH_BYTES = 1024, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer file splits than the cluster has cores (a small one) is dealt over them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound the rows and bytes of an Arrow batch, so that long texts can't add up in a worker.

    Frames are lazy, so the session keeps these bounds; they are only ever lowered.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = (spark.conf.get(key, None) or "").lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, and only where the result is needed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; a text without words gives an empty array."""
    return F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't use yet, whatever extra columns it has."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name
