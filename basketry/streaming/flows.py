"""Streams: suppression of repeated scans, idempotent import, and the latest state of a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from basketry.operators.relational import top_rows


def accepted_scans(scans: DataFrame, key: str = "code", at: str = "at", gap_ms: int = 1500, forget_ms: int | None = None) -> DataFrame:
    """The scans (key string, at long in ms) of a stream that are accepted: those gap_ms or more after the last accepted one of their key.

    A scan that isn't accepted doesn't extend the gap.  Scans of a micro-batch count in order of time; the state is one
    number a key.  With forget_ms it is let go when a key hasn't been seen for so long (by the clock: such a stream runs on and on, so that a trigger
    of what is available now doesn't end).  Null and empty keys, and scans without a time, are never accepted.
    """

    def judge(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = np.sort(np.concatenate([f[at].to_numpy(np.int64) for f in frames]))
        last = state.get[0] if state.exists else None
        taken, i = [], 0 if last is None else int(np.searchsorted(times, last + gap_ms))
        while i < len(times):
            last = int(times[i])
            taken.append(last)
            i = int(np.searchsorted(times, last + gap_ms))
        if last is not None:
            state.update((last,))
            if forget_ms is not None:
                state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame({key: [group[0]] * len(taken), at: taken})

    rows = scans.filter(F.col(key).isNotNull() & (F.col(key) != "") & F.col(at).isNotNull()).select(key, at)
    return rows.groupBy(key).applyInPandasWithState(judge, f"`{key}` string, `{at}` long", "last long", "append", GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def imported_once(rows: DataFrame, keys: list[str], at: str = "ts", lookback: str = "48 hours") -> DataFrame:
    """Rows of a stream without those that repeat the keys and the time within the lookback; state older than that is dropped."""
    return rows.withWatermark(at, lookback).dropDuplicates([*keys, at])


def keep_latest(spark: SparkSession, path: str, keys: list[str], at: str, compact: int = 20):
    """A foreachBatch function that keeps the latest row of each key below path; latest reads it.

    Rows may come out of order; of equal times the batch that came last counts.  A batch writes its own latest rows only, and a batch that is
    run again writes the same; every so many batches the rows up to then are merged into a new base.
    """

    def merge(batch: DataFrame, number: int) -> None:
        order = [F.col(at).desc(), *[F.col(c).desc() for c in batch.columns if c not in (*keys, at)]]
        top_rows(batch, keys, order).withColumn("__batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch-{number:012d}")
        if (number + 1) % compact == 0:
            _latest(spark, path, keys, at).write.mode("overwrite").parquet(f"{path}/base-{number:012d}")

    return merge


def _latest(spark: SparkSession, path: str, keys: list[str], at: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in fs.listStatus(folder))
    whole = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    base = max((n for n in whole if n.startswith("base-")), default="base-")
    later = [n for n in whole if n.startswith("batch-") and n[6:] > base[5:]]
    rows = spark.read.parquet(*[f"{path}/{n}" for n in ([base] if base in whole else []) + later])
    return top_rows(rows, keys, [F.col(at).desc(), F.col("__batch").desc()])


def latest(spark: SparkSession, path: str, keys: list[str], at: str) -> DataFrame:
    """The latest row of each key that keep_latest has kept below path: its newest base and the batches since."""
    return _latest(spark, path, keys, at).drop("__batch")
