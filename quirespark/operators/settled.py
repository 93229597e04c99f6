"""Cuts the lineage of tables that several later steps read, so that plans stay small."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where that is unset in a session of one process, as in tests, a temporary folder is taken; on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quirespark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The rows from a checkpoint in the shared folder, from which any executor can read them again."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
