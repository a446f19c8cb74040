"""General relational steps that the queries share: latest rows, top rows, merges, cascades, components of records.

Steps that pick rows by rank filter on row_number, which Spark turns into a limit for each group before the shuffle; a key
that holds many rows is cut down where they are read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key by order, with their rank if a name is given."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def ordered(keys: list[str], order: list[Column]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have a key, each column is the new value unless that is null, or an empty list."""

    def pick(c: str) -> Column:
        fresh = F.col(f"n.{c}")
        if old.schema[c].dataType.typeName() == "array":
            fresh = F.when(F.size(fresh) > 0, fresh)
        return F.coalesce(fresh, F.col(f"o.{c}")).alias(c)

    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(*[pick(c) for c in old.columns])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and those rows of new whose keys old doesn't have; of rows that repeat a key in new, the least stays."""
    fresh = top_rows(new.join(old.select(*keys).distinct(), keys, "left_anti"), keys, [F.col(c) for c in new.columns if c not in keys])
    return old.unionByName(fresh.select(*old.columns))


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Last write wins: old without the keys that new has, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def relink(child: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """child with its foreign key moved from a merged parent (old) to the one that stays (new)."""
    moved = child.join(mapping.select(F.col("old").alias(key), "new"), key, "left")
    return moved.withColumn(key, F.coalesce("new", key)).drop("new").select(*child.columns)


def cascade(df: DataFrame, steps: list[tuple[str, str, DataFrame]], target: str) -> DataFrame:
    """df with target and matched_by: the first step (name, key column, lookup of key and target) that knows the row.

    One equality join a step, instead of one join with alternatives.  A lookup with several targets for a key gives the least.
    """
    out = df
    for i, (_, key, lookup) in enumerate(steps):
        known = lookup.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(target).alias(f"__t{i}"))
        out = out.join(known, key, "left")
    hits = [F.col(f"__t{i}") for i in range(len(steps))]
    by = reduce(lambda a, i: a.when(hits[i].isNotNull(), steps[i][0]), range(1, len(steps)), F.when(hits[0].isNotNull(), steps[0][0]))
    return out.withColumn(target, F.coalesce(*hits)).withColumn("matched_by", F.coalesce(by, F.lit("create"))).drop(*[f"__t{i}" for i in range(len(steps))])


def issues(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that hold."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def penalty_score(found: Column, weights: dict[str, int]) -> Column:
    """100 less the weights of the issues found, not below 0."""
    worth = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.greatest(F.lit(0), 100 - F.aggregate(found, F.lit(0), lambda a, x: a + F.coalesce(worth[x], F.lit(0))))


def best_match(left: DataFrame, right: DataFrame, name: str, other: str, score) -> DataFrame:
    """Pairs of distinct names (name of left, other of right) whose score is above 0, without comparing all pairs.

    Names are equal, or one holds the other, or half of the longer's words are common.  A name that another holds
    has its rarest run of three letters in common with it; names with half of their words in common share one of
    the rarest words of each (prefix filter).  Either way gives equality joins; every pair found is scored.
    """
    from basketry.functions import text as T

    a = left.select(F.col(name).alias("a")).distinct().withColumns({"x": T.normalise(F.col("a"), False, False), "s": T.name_tokens(F.col("a"))}).filter("x <> ''")
    b = right.select(F.col(other).alias("b")).distinct().withColumns({"y": T.normalise(F.col("b"), False, False), "t": T.name_tokens(F.col("b"))}).filter("y <> ''")

    def pieces(c: Column) -> Column:
        """The runs of three letters of a name, or the name, if it is shorter."""
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: c.substr(i, F.lit(3)))
        return F.array_distinct(runs)

    def every(c: Column) -> Column:
        """All runs of one to three letters."""
        at = F.sequence(F.lit(1), F.length(c))
        return F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*[c.substr(i, F.lit(n)) for n in (1, 2, 3)]))))

    def held(short: DataFrame, key: str, c: str, long: DataFrame, d: str) -> DataFrame:
        whole = long.withColumn("g", F.explode(every(F.col(d))))
        known = whole.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        own = short.withColumn("g", F.explode(pieces(F.col(c)))).join(known, "g", "left")
        # the rarest piece of a name; where a piece is nowhere, no name holds it
        rarest = own.groupBy(key, c).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("m")).filter("m.n > 0").select(key, c, F.col("m.g").alias("g"))
        return rarest.join(whole, "g").filter(F.col(d).contains(F.col(c))).select("a", "b")

    counts = a.select(F.explode("s").alias("w")).unionByName(b.select(F.explode("t").alias("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("n"))

    def rare(df: DataFrame, key: str, tokens: str) -> DataFrame:
        each = df.select(key, F.size(tokens).alias("m"), F.explode(tokens).alias("w")).join(counts, "w")
        place = F.row_number().over(Window.partitionBy(key).orderBy("n", "w"))
        return each.withColumn("p", place).filter(F.col("p") <= F.col("m") - F.ceil(F.col("m") / 2) + 1).select(key, "w")

    shared = rare(a, "a", "s").join(rare(b, "b", "t"), "w").select("a", "b")
    pairs = held(a, "a", "x", b, "y").unionByName(held(b, "b", "y", a, "x")).unionByName(shared).distinct()
    return pairs.withColumn("score", score(F.col("a"), F.col("b"))).filter("score > 0").select(F.col("a").alias(name), F.col("b").alias(other), "score")


def stored_observations(df: DataFrame, key: str, at: str, values: list[str], gap_seconds: int = 6 * 3600) -> DataFrame:
    """The observations of each key that are stored: those whose values differ from the last stored one's, or that come gap_seconds or more after it.

    An observation that isn't stored doesn't move the last stored one.  A run of equal values begins with a stored one, and so does what comes gap_seconds
    or more after the observation before it; each piece between these is judged by itself: by one pass over its times.
    """
    w = Window.partitionBy(key).orderBy(at, *values)
    seconds = F.unix_seconds(F.col(at).cast("timestamp"))
    same = F.coalesce(reduce(lambda a, b: a & b, [F.col(v).eqNullSafe(F.lag(v).over(w)) for v in values]), F.lit(False)) & F.coalesce(seconds - F.lag(seconds).over(w) < gap_seconds, F.lit(False))
    runs = df.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    times = F.sort_array(F.collect_list(F.struct(seconds.alias("s"), F.col(at).alias("at"))))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(f"array<{df.schema[at].dataType.simpleString()}>").alias("kept"))
    taken = F.aggregate(F.col("t"), start, lambda a, x: F.when(a["last"].isNull() | (x["s"] - a["last"] >= gap_seconds), F.struct(x["s"].alias("last"), F.array_append(a["kept"], x["at"]).alias("kept"))).otherwise(a))
    grouped = runs.groupBy(key, "__run").agg(times.alias("t"), *[F.first(v).alias(v) for v in values])
    return grouped.select(key, F.explode(taken["kept"]).alias(at), *values)


def until_stable(df: DataFrame, step: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], DataFrame], most: int = 5) -> DataFrame:
    """step applied again and again, most times at most, until it changes nothing.  write cuts the lineage after each (a checkpoint or a table);
    only a count and a checksum come to the driver."""
    mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*x.columns).cast("decimal(38,0)"))).first())
    now = mark(df)
    for _ in range(most):
        df = write(step(df))
        before, now = now, mark(df)
        if now == before:
            break
    return df


def contained_phrases(df: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str = "phrase", rank: str = "rank") -> DataFrame:
    """Per row of df whose normalised text has one of the phrases as whole words: key and the longest phrase; of equal lengths
    that of the least rank.  All runs of words of a text, as long as the longest phrase, meet the phrases in an equality join.

    The runs are many times the rows that Spark judges their size by, so it would send them to every task: phrases of 4 MB at most are sent instead, and more are shuffled."""
    longest, letters = phrases.agg(F.max(F.size(F.split(phrase, " "))), F.sum(F.octet_length(phrase) + 32)).first()
    longest, phrases = longest or 1, F.broadcast(phrases) if (letters or 0) <= 4_000_000 else phrases.hint("shuffle_hash")
    w = F.filter(F.split(text, " "), lambda x: x != "")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.array_join(F.slice(w, i, n), " "))))
    found = df.select(key, F.explode(F.array_distinct(runs)).alias(phrase)).join(phrases, phrase)
    return top_rows(found, [key], [F.length(phrase).desc(), F.col(rank)]).select(key, phrase)
