"""Folders for intermediate and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can reach.

    The setting is read from the session. Only in a session on one machine may it be
    unset: a local folder is then made and set. Elsewhere that raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        master = spark.sparkContext.master
        if jvm_dir.isDefined():
            root = jvm_dir.get()
        elif not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """Written once to the shared folder and read back, for frames that several passes use: lineage ends here."""
    path, schema = folder(df.sparkSession, label), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
