"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch: texts may be long, so a batch must hold few of them.
ARROW_ROWS = 400
#: Bytes of an Arrow batch, but for a single row that is longer.
ARROW_BYTES = 8 << 20
#: Bytes of text that one hash bucket of an exchange is meant to hold.
BUCKET_BYTES = 20_000_000
#: Spark's setting to remove a query's shuffle files as soon as it ends, not when the driver happens to collect its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that long texts don't fill a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see.

    Where that setting is absent and the master is local (tests), a temporary folder of this machine becomes
    the checkpoint folder; on any other master that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="basketry-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/basketry-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts the lineage durably.

    What was shuffled for it goes when it is written: disk holds one step's exchanges, not those of all steps before.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def content_key(text: Column) -> Column:
    """32 bytes that stand for a text's content."""
    return F.unhex(F.sha2(text, 256))


def buckets_for(df: DataFrame, text: Column) -> int:
    """Hash buckets for an exchange that is proportional to the text: one native pass sums its size."""
    size = df.agg(F.sum(F.octet_length(text)).alias("s")).first()["s"] or 0
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(parts, int(size // BUCKET_BYTES) + 1)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name
