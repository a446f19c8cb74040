"""Connected components of a graph given by its edges, as joins and aggregations that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import written


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Per node of edges (x, y: long): node and label, the smallest node of its component.

    Alternating large-star and small-star rounds: every node's neighbours are linked to its least neighbour, until
    every component is a star.  Each round is written to the shared folder, so that a lost executor costs no
    more than one round; only a count and a checksum come to the driver.
    """
    state = written(edges.filter("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    mark = None
    for _ in range(rounds):
        now = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("s")).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
        both = state.unionByName(state.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x != y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.*")
        state = written(small.filter("x != y").distinct())
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return state.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("label")).unionByName(state.select(F.col("y").alias("node"), F.col("y").alias("label")).distinct())
