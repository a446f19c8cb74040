"""Cutting lineage where a plan would grow from round to round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, before work that a row costs much: a small file of many rows is read by one or two tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def cut(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the checkpoint folder that executors share and read again: a lost executor costs no more than the step at hand.

    A written table has the size that it has, where a checkpoint keeps the estimate of its plan, which joins of joins square from round to round.  The folder is
    that of spark.checkpoint.dir.  Where it is unset and the master is local (tests), a temporary folder of this machine becomes it; on any other master that is an
    error.  The tables are the caller's to delete, with the folder.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="basketry-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/basketry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
