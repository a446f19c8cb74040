"""Changes that name the value that they expect: which are accepted, as if one after the other, replayed key by key, or for keys of many changes found by doubling pointers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.sequence import last_before

Write = Callable[[DataFrame], DataFrame]


def guarded(changes: DataFrame, states: DataFrame, write: Write, most: int = 50, blocks: int = 1, replayed: int = 100_000) -> DataFrame:
    """changes with previous, next and accepted.

    changes: key, at (a whole number, unique: the order), expected and value, both null for an undoing one, which names another change in undoes.  states: key and value, at first.
    A change is accepted if its key has the expected value then, and gives it its own.  An undoing one expects the value of the change that it undoes, and gives
    what that one expected; that must have been accepted before, and may be an undoing one itself.  A change of a key without a state, one that expects null, and one that undoes what
    isn't an earlier change of its key, is refused.

    Keys of so many changes at most (replayed) are replayed: their changes are dealt by key once, sorted, and read one after the other; what is held is one key's.  A key of
    more has its changes dealt over all tasks, by pointers.
    """
    held = changes.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > replayed).select(F.col("key").alias("__key"))
    large = F.col("key").eqNullSafe(F.col("__key"))
    if held.isEmpty():
        return _replayed(changes, states)
    return _replayed(changes.join(held, large, "left_anti"), states).unionByName(_pointed(changes.join(held, large, "left_semi"), states, write, most, blocks))


def _replayed(changes: DataFrame, states: DataFrame) -> DataFrame:
    """The changes of each key, read in their order."""
    c = F.col
    opening = states.filter("value is not null").select("key", c("value").alias("__first"))
    rows = changes.select("key", "at", "expected", "value", "undoes").join(opening, "key", "left").repartition("key").sortWithinPartitions("key", "at")
    of = {f.name: f.dataType.simpleString() for f in changes.schema.fields}
    schema = f"key {of['key']}, at {of['at']}, undoes {of['undoes']}, previous {of['expected']}, next {of['value']}, accepted boolean"

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, started, now, told = None, False, None, {}
        for batch in batches:
            keys, ats, expected, values, undoes, firsts = (batch.column(i).to_pylist() for i in range(6))
            previous, following, accepted = [], [], []
            for key, at, p, n, undone, first in zip(keys, ats, expected, values, undoes, firsts, strict=True):
                if not started or key != last:
                    last, started, now, told = key, True, first, {}
                good = True
                if undone is not None:
                    # a null key has no changes that another could name
                    gave, took, good = told.get(undone, (None, None, False)) if key is not None else (None, None, False)
                    p, n = took, gave
                good = good and now is not None and p is not None and n is not None and p == now
                told[at] = (p, n, good)
                if good:
                    now = n
                previous.append(p), following.append(n), accepted.append(good)
            columns = [batch.column(0), batch.column(1), batch.column(4), pa.array(previous, batch.column(2).type), pa.array(following, batch.column(3).type), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "at", "undoes", "previous", "next", "accepted"])

    return rows.mapInArrow(replay, schema)


def _pointed(changes: DataFrame, states: DataFrame, write: Write, most: int, blocks: int) -> DataFrame:
    """The same by pointers, in rounds, for keys that hold more changes than one task should.

    After an accepted change the next accepted one is the first later change that expects its value, so changes point to one another, and those that the first one of a key leads to
    are accepted.  With pointers doubled, that takes as many rounds as the logarithm of the longest chain.  Whether what an undoing change names was accepted is found likewise, in
    rounds until nothing changes: it depends on earlier changes only.
    """
    c = F.col
    plain = changes.select("key", "at", "expected", "value", "undoes")
    # what an undoing change expects and gives, through as many of them as there are
    full = write(plain.withColumns({"previous": F.when(c("undoes").isNull(), c("expected")), "next": F.when(c("undoes").isNull(), c("value")), "known": c("undoes").isNull()}))
    while True:
        target = full.filter("known").select(c("key").alias("__key"), c("at").alias("__at"), c("next").alias("__expects"), c("previous").alias("__gives"))
        step = full.join(target, (c("key") == c("__key")) & (c("undoes") == c("__at")) & (c("at") > c("__at")), "left")
        fresh = ~c("known") & c("__at").isNotNull()
        step = write(step.select("key", "at", "expected", "value", "undoes", F.when(fresh, c("__expects")).otherwise(c("previous")).alias("previous"), F.when(fresh, c("__gives")).otherwise(c("next")).alias("next"), (c("known") | fresh).alias("known"), fresh.alias("fresh")))
        full = step.drop("fresh")
        if step.filter("fresh").isEmpty():
            break
    full = write(full.withColumn("may", c("known") & c("previous").isNotNull() & c("next").isNotNull()))
    for _ in range(most):
        told = _accepted(full.filter("may"), states, write, blocks)
        marked = write(full.join(told.withColumn("accepted", F.lit(True)), "at", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False))))
        done = marked.filter("accepted").select(c("at").alias("undoes"), F.lit(True).alias("__done"))
        able = marked.join(done, "undoes", "left").withColumn("now", c("known") & c("previous").isNotNull() & c("next").isNotNull() & (c("undoes").isNull() | c("__done").isNotNull()))
        able = write(able.select("key", "at", "expected", "value", "undoes", "previous", "next", "known", c("now").alias("may"), (c("now") != c("may")).alias("moved")))
        full = able.drop("moved")
        if able.filter("moved").isEmpty():
            return marked.select("key", "at", "undoes", "previous", "next", "accepted")
    raise RuntimeError(f"changes still differ after {most} rounds")


def _accepted(changes: DataFrame, states: DataFrame, write: Write, blocks: int) -> DataFrame:
    """at of the changes that are accepted: those that the first ones lead to."""
    c = F.col
    waiting = changes.select(F.struct("key", c("previous").alias("v")).alias("k"), (-c("at")).alias("back"), c("at").alias("is"), F.lit(None).cast("long").alias("asks"))
    # what a change asks for comes later only, so its own place doesn't count even if it gives what it expects
    asking = changes.select(F.struct("key", c("next").alias("v")).alias("k"), (-c("at")).alias("back"), F.lit(None).cast("long").alias("is"), c("at").alias("asks"))
    found = last_before(waiting.unionByName(asking), "k", "back", c("is"), "then", blocks)
    jumps = write(found.filter("asks is not null and then is not null").select(c("asks").alias("at"), "then"))
    opening = states.filter("value is not null").select("key", c("value").alias("previous"))
    seen = write(changes.join(opening, ["key", "previous"]).groupBy("key").agg(F.min("at").alias("at")).select("at"))
    held = seen.count()
    while True:
        more = seen.join(jumps, "at").select(c("then").alias("at")).join(seen, "at", "left_anti").distinct()
        seen = write(seen.unionByName(more))
        before, held = held, seen.count()
        if held == before:
            return seen
        jumps = write(jumps.alias("a").join(jumps.alias("b"), c("a.then") == c("b.at")).select(c("a.at"), c("b.then")))
