"""Words within an edit distance, and lines against names by such words, as equality joins that lose no pair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.durable import cut, spread


def alike(a: Column, b: Column) -> Column:
    """1 for equal words; 0.8 if one of four letters or more begins the other; else 1 - edit distance / longer length."""
    prefix = (F.least(F.length(a), F.length(b)) >= 4) & (a.startswith(b) | b.startswith(a))
    return F.when(a == b, 1.0).when(prefix, 0.8).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def _letters(word: Column) -> Column:
    """The letters of a word as bits: an edit takes one of them and brings one at most."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda has, x: has.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.crc32(x.cast("binary")), F.lit(64)).cast("int"))))


def alike_words(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """All pairs (a of left, b of right) of distinct words with alike(a, b) >= least, and s.

    Words within k edits: of k + 1 pieces of b, one (number j from 0) is in a as it is, with j edits before it and k - j behind it at most, so it stands no
    more than j places from where it stands in b, and no more than k - j counted from the end.  k follows from both lengths.  Beginnings meet
    by equality.  Words are compared where they meet only, and only if neither has more than k letters that the other doesn't have; nulls and empty words meet nothing.
    """
    c = F.col
    side = lambda df, o: cut(spread(df.select(c(o)).filter(f"{o} <> ''").distinct()).withColumns({"n": F.length(o), f"{o}_has": _letters(c(o))}))
    both = (side(left, "a"), side(right, "b"))
    a, b = both[0].select("a"), both[1].select("b")
    shortest, longest = both[1].agg(F.coalesce(F.min("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    least_of, most_of = F.ceil(least * c("n") - 1e-9).cast("int"), F.floor(c("n") / least + 1e-9).cast("int")
    edits = lambda n: F.floor((1 - least) * n + 1e-9).cast("int")
    at = lambda j: F.floor(j * c("nb") / (c("k") + 1)).cast("int")
    j, by, start = c("j"), c("n") - c("nb"), at(c("j"))
    low, high = F.greatest(least_of, F.lit(shortest)), F.least(most_of, F.lit(longest))
    asks = both[0].filter(low <= high).select("a", "a_has", "n", F.explode(F.sequence(low, high)).alias("nb")).withColumn("k", edits(F.greatest("n", "nb"))).withColumn("j", F.explode(F.sequence(F.lit(0), c("k"))))
    asks = asks.withColumns({"size": at(j + 1) - start, "low": F.greatest(start + F.greatest(-j, by - c("k") + j), F.lit(0)), "high": start + F.least(j, by + c("k") - j)})
    asks = asks.withColumn("high", F.least("high", c("n") - c("size"))).filter("low <= high").withColumn("at", F.explode(F.sequence("low", "high")))
    asks = asks.select("a", "a_has", "nb", "k", "j", c("a").substr(c("at") + 1, c("size")).alias("piece"))
    gives = both[1].select("b", "b_has", c("n").alias("nb"), F.explode(F.array_distinct(F.transform(F.sequence(least_of, most_of), lambda n: edits(F.greatest(n, c("n")))))).alias("k")).withColumn("j", F.explode(F.sequence(F.lit(0), c("k"))))
    gives = gives.select("b", "b_has", "nb", "k", "j", c("b").substr(start + 1, at(j + 1) - start).alias("piece"))
    more = lambda x, y: F.bit_count(c(x).bitwiseAND(F.bitwise_not(c(y)))) <= c("k")
    met = asks.join(gives, ["nb", "k", "j", "piece"]).filter(more("a_has", "b_has") & more("b_has", "a_has")).select("a", "b")
    begins = lambda df, c, o: df.select(c, F.explode(F.transform(F.sequence(F.lit(4), F.greatest(F.length(c), F.lit(4))), lambda i: F.col(c).substr(F.lit(1), i))).alias(o))
    shorter = begins(a, "a", "b").filter("length(b) >= 4").join(b, "b").select("a", "b").unionByName(begins(b, "b", "a").filter("length(a) >= 4").join(a, "a").select("a", "b")) if least <= 0.8 else met.limit(0)
    # words may meet by several pieces: those that are alike are few
    return met.unionByName(shorter).withColumn("s", alike(F.col("a"), F.col("b"))).filter(F.col("s") >= least).distinct()


def supported(lines: DataFrame, line: str, words: str, sought: DataFrame, least: float) -> DataFrame:
    """The words (b of sought) that a word of a line is alike to (least), and how much by the best of these: line, b, s.  Written, as it is looked at in several ways."""
    u = lines.select(line, F.explode(F.array_distinct(words)).alias("a"))
    close = cut(alike_words(u, sought, least))
    return cut(u.join(close, "a").groupBy(line, "b").agg(F.max("s").alias("s")))


def supported_pairs(lines: DataFrame, products: DataFrame, line: str, words: str, product: str, required: str, called: str, least: float, weak: float, supports: DataFrame | None = None) -> DataFrame:
    """Pairs of line and product such that each of the product's required words is alike (least) to one of the line's words; a product without required words comes
    with the lines that have a word alike (weak) to one of those it is called by.

    A product looks for its lines by the required word, or the two of them together, that fewest lines have, and the other words are then looked up
    in what the line supports; so a word that all lines have brings no pairs by itself.  What lines support (weak) may be given.
    """
    c = F.col
    v = products.select(product, F.explode(F.array_distinct(required)).alias("b"))
    w = products.filter(F.size(required) == 0).select(product, F.explode(F.array_distinct(called)).alias("b"))
    if supports is None:
        supports = supported(lines, line, words, v.select("b").unionByName(w.select("b")), weak)
    loose = supports.join(w, "b").select(line, product).distinct()
    sure = supports.filter(F.col("s") >= least).select(line, "b")
    of_line = sure.groupBy(line).agg(F.sort_array(F.collect_set("b")).alias("has"))
    how_many = sure.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    ranked = v.join(how_many, "b", "left").groupBy(product).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "b"))).alias("x"))
    possible = ranked.filter(~F.exists("x", lambda x: x["n"] == 0))
    # a key stands for one word or two; of what meets by it the words themselves are looked at
    key = lambda x, y=None: F.xxhash64(x) if y is None else F.xxhash64(x, y)
    rarest = F.sort_array(F.transform(F.slice("x", 1, 2), lambda x: x["b"]))
    asked = cut(possible.select(product, F.transform("x", lambda x: x["b"]).alias("needs"), rarest.alias("rarest")).select(product, "needs", F.when(F.size("rarest") == 1, key(F.get("rarest", F.lit(0)))).otherwise(key(F.get("rarest", F.lit(0)), F.get("rarest", F.lit(1)))).alias("key")))
    # only the keys that some product asks for are kept of a line's; its words don't go with each of them
    has = cut(spread(of_line))
    one = has.select(line, F.explode("has").alias("x"), "has")
    offers = one.select(line, key(c("x")).alias("key")).unionByName(one.select(line, "x", F.explode("has").alias("y")).filter("x < y").select(line, key(c("x"), c("y")).alias("key")))
    offers = offers.join(asked.select("key").distinct(), "key", "left_semi")
    met = offers.join(asked, "key").join(has, line).filter(F.size(F.array_except("needs", "has")) == 0).select(line, product)
    return loose.unionByName(met).distinct()


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, v: t + v)


def clear_best(scored: DataFrame, keys: list[str], entry: str, identity: str, score: str, margin: float, good: Callable[[], Column]) -> DataFrame:
    """Per key the entry with the best score, ties to the least entry, if it is good and no entry of another identity comes within the margin."""
    c = F.col
    w = Window.partitionBy(*keys).orderBy(c(score).desc(), c(entry))
    best = scored.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    # the best of each identity, and of these the second
    each = scored.groupBy(*keys, identity).agg(F.max(score).alias("__s"))
    rival = each.alias("e").join(best.select(*keys, c(identity).alias("__own")), keys).filter(c(identity) != c("__own")).groupBy(*keys).agg(F.max("__s").alias("__next"))
    return best.join(rival, keys, "left").filter(good() & (c("__next").isNull() | (c(score) - c("__next") >= margin))).drop("__next")
