"""Steps over ordered rows of a key: what a state machine carries from row to row, as running values of windows.

All windows of a step have one partitioning and one order, so rows are dealt and sorted once, and running frames hold one row at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(df: DataFrame, keys: list[str], order: list[Column], value: Column, closes: Callable[[Column], Column], out: str) -> DataFrame:
    """df with out: the value that is open before each row, or null.

    A row whose value isn't null opens it, in place of one that is open; closes(open value) says whether the row, which uses it, closes it.  Rows are numbered by
    the closings before them: a value is open as long as that number is what it was where the value came up.
    """
    running = Window.partitionBy(*keys).orderBy(*order)
    before = running.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__value", value).withColumn("__last", F.last(F.when(F.col("__value").isNotNull(), F.struct("__value")), ignorenulls=True).over(before)["__value"])
    shut = F.when(F.col("__value").isNull() & F.col("__last").isNotNull() & closes(F.col("__last")), 1).otherwise(0)
    df = df.withColumn("__shut", shut).withColumn("__closings", F.coalesce(F.sum("__shut").over(before), F.lit(0)))
    since = F.last(F.when(F.col("__value").isNotNull(), F.col("__closings")), ignorenulls=True).over(before)
    return df.withColumn("__since", since).withColumn(out, F.when(F.col("__closings") == F.col("__since"), F.col("__last"))).drop("__value", "__last", "__shut", "__closings", "__since")


def section(df: DataFrame, keys: list[str], order: list[Column], begins: Column, ends: Column) -> DataFrame:
    """The rows of each key behind the first that begins, before the first after it that ends."""
    running = Window.partitionBy(*keys).orderBy(*order)
    before = running.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.max(F.when(begins, 1).otherwise(0)).over(before), F.lit(0))
    df = df.withColumn("__in", inside)
    over = F.max(F.when((F.col("__in") == 1) & ends, 1).otherwise(0)).over(running)
    return df.withColumn("__over", over).filter("__in = 1 and __over = 0").drop("__in", "__over")


def followed(df: DataFrame, keys: list[str], order: list[Column], marks: Column, follows: Column, ahead: int, belongs: Column, behind: int, *told: Column) -> DataFrame:
    """Per key: first, the number of the first row that marks and within so many rows ahead has one that follows; and start, from which
    rows that belong lead up to it without a gap, so many at most.  Rows are numbered from 0; a key without such a row has none,
    unless aggregates are told besides: then each key has a row, with these.

    A row looks at a few others whatever the key holds.
    """
    running = Window.partitionBy(*keys).orderBy(*order)
    mark = lambda x: F.coalesce(x, F.lit(False))
    df = df.withColumns({"__marks": mark(marks), "__follows": mark(follows), "__belongs": mark(belongs)})
    near = reduce(or_, [F.lead("__follows", i, False).over(running) for i in range(1, ahead + 1)])
    run = F.coalesce(*[F.when(~F.lag("__belongs", i, False).over(running), i - 1) for i in range(1, behind + 1)], F.lit(behind))
    df = df.withColumns({"__number": F.row_number().over(running) - 1, "__hit": F.col("__marks") & near, "__run": run})
    hit = F.min(F.when(F.col("__hit"), F.struct("__number", "__run")))
    found = df.groupBy(*keys).agg(hit.alias("__first"), *told)
    found = found if told else found.filter("__first is not null")
    return found.select(*[c for c in found.columns if c != "__first"], F.col("__first.__number").alias("first"), (F.col("__first.__number") - F.col("__first.__run")).cast("int").alias("start"))


def last_before(df: DataFrame, key: str, at: str, value: Column, out: str, blocks: int = 1) -> DataFrame:
    """df with out: the value of the last earlier row of its key (by at, a whole number) that has one, else null.

    A key may hold most rows: a key's rows are dealt by blocks of at, and each block begins with what the blocks before it end with.
    """
    low, high = df.agg(F.min(at), F.max(at)).first() if blocks > 1 else (None, None)
    block = F.floor((F.col(at) - low) / F.lit(max(1, -(-(high - low + 1) // blocks)))) if low is not None else F.lit(0)
    rows = df.withColumns({"__block": block, "__value": value})
    running = Window.partitionBy(key, "__block").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    ends = rows.filter("__value is not null").groupBy(key, "__block").agg(F.max_by("__value", at).alias("__end"))
    rows = rows.withColumn(out, F.last("__value", ignorenulls=True).over(running))
    if low is None:
        return rows.drop("__block", "__value")
    # one row for each key and block
    places = rows.select(key, "__block").distinct().join(ends, [key, "__block"], "left")
    carry = places.withColumn("__carry", F.last("__end", ignorenulls=True).over(Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))).drop("__end")
    return rows.join(carry.filter("__carry is not null"), [key, "__block"], "left").withColumn(out, F.coalesce(out, "__carry")).drop("__block", "__value", "__carry")
