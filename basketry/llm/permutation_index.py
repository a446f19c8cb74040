"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots of a fixed set, in order.  The pivot inverted file holds, for each pivot, the
vectors that have it among their nearest, by the position that it has there.  A query reads the lists of its own nearest
pivots, and of these the part whose positions are near its own; what the positions differ by there, and the greatest
difference for pivots that only one of the two has, is the footrule distance that ranks the vectors read.  The best are
ranked again by the true distance.

How far down to go is a bound on the footrule distance, which each query takes from a bounded sample of the vectors: the
share of these that shall be ranked again.  The bound holds for all vectors alike, however they are spread over the
index: there is no limit to how many are within it, and with a share of 1 the search is exact.

Equal vectors are posted once, with their smallest ids: all that a list of k neighbours can hold of them.  The index is
written in pages of some vectors with the pages' lists; tasks answer blocks of queries on them.  A block has a bounded
number of queries, which is all that is broadcast besides the pivots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm import textscan as ts
from basketry.llm.common import shared_dir, small_batches, written

#: Pivots: so many for each square root of the number of vectors, within these limits.
PIVOTS_PER_ROOT, LEAST_PIVOTS, MOST_PIVOTS = 5, 128, 4096
#: Distinct vectors (those with the smallest hashes) that pivots are chosen from, and that queries take their bounds from.
SAMPLE = 4096
#: Nearest pivots that a vector is posted under, and whose lists a query reads.
NEAREST = 64
#: Positions that a query reads on either side of its own.
REACH = 40
#: The share of vectors that is ranked again, and the least number.
SHARE, LEAST = 0.1, 400
PAGE = 512
#: Distinct queries in a block.
BLOCK = 8192


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("e"))
    return rows.filter(F.col("id").isNotNull() & usable(F.col("e"))).withColumns({"h": F.xxhash64("e"), "g": F.xxhash64(F.lit(1), "e")})


def matrix(array: pa.ListArray, dtype=np.float64) -> np.ndarray:
    """The rows of a list column, which have one length."""
    flat = array.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(array), -1).astype(dtype)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each vector its nearest pivots, nearest first; ties go to the pivot that comes first."""
    out = np.empty((len(vectors), min(NEAREST, len(pivots))), np.uint16)
    for low in range(0, len(vectors), 256):
        part = vectors[low : low + 256]
        out[low : low + 256] = np.argsort((pivots**2).sum(1)[None] - 2 * part @ pivots.T, axis=1, kind="stable")[:, : out.shape[1]]
    return out


def spread(sample: np.ndarray, count: int) -> np.ndarray:
    """count distinct vectors of the sample at most, each the farthest from those chosen before it.

    So a dense group of near copies doesn't take many pivots.
    """
    if not len(sample):
        return sample
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < count and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def sampled(rows: DataFrame) -> np.ndarray:
    """SAMPLE distinct vectors at most, of the length that most of them have."""
    found = [r["e"] for r in rows.groupBy("h", "g").agg(F.first("e").alias("e")).orderBy("h", "g").limit(SAMPLE).collect()]
    if not found:
        return np.zeros((0, 0))
    usual = np.bincount([len(x) for x in found]).argmax()
    return np.array([x for x in found if len(x) == usual], np.float64)


class Lists:
    """The pivot inverted file of some vectors: by pivot and position, the vectors (by number) posted there."""

    def __init__(self, near: np.ndarray, pivots: int):
        place = near.astype(np.int64) * near.shape[1] + np.arange(near.shape[1])
        self.members = np.argsort(place.ravel(), kind="stable").astype(np.int64) // near.shape[1]
        self.edge = np.searchsorted(np.sort(place.ravel()), np.arange(pivots * near.shape[1] + 1))
        self.size, self.nearest = len(near), near.shape[1]

    def footrule(self, query: np.ndarray, reach: int) -> np.ndarray:
        """What each vector's footrule distance to the query (its nearest pivots) is less than the greatest one."""
        total = np.zeros(self.size, np.int64)
        m = self.nearest
        at = np.arange(m)
        low, high = np.maximum(at - reach, 0), np.minimum(at + reach, m - 1)
        first = query.astype(np.int64) * m
        # positions of the parts of lists that are read, laid end to end
        place = np.repeat(first + low, high - low + 1) + _steps(high - low + 1)
        gain = m - np.abs(place % m - np.repeat(at, high - low + 1))
        count = self.edge[place + 1] - self.edge[place]
        some = count > 0
        start, count, gain = self.edge[place][some], count[some], gain[some]
        hit = np.repeat(start, count) + _steps(count)
        total += np.bincount(self.members[hit], np.repeat(gain, count), self.size).astype(np.int64)
        return total


def _steps(counts: np.ndarray) -> np.ndarray:
    """0 .. counts[i] - 1 of all i, laid end to end."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> tuple[DataFrame, np.ndarray, np.ndarray, int]:
    """The index, its pivots, a sample of the vectors and the number of distinct ones.  Index rows are pages: ids (the k + 1
    smallest of each vector), vectors (doubles), and the page's pivot inverted file (members, edge).

    Every usable row is indexed; rows that repeat both key and vector count once, and vectors of another length than the
    pivots' take no part.
    """
    small_batches(vectors.sparkSession)
    rows = _rows(vectors, key, vector)
    sample = sampled(rows)
    rows = rows.filter(F.size("e") == sample.shape[1]).dropDuplicates(["h", "g", "id"])
    order = Window.partitionBy("h", "g").orderBy("id")
    kept = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    distinct = written(kept.groupBy("h", "g").agg(F.first("e").alias("e"), F.sort_array(F.collect_list("id")).alias("ids")).select("e", "ids"))
    size = distinct.count()
    pivots = spread(sample, min(max(int(PIVOTS_PER_ROOT * size**0.5), LEAST_PIVOTS), MOST_PIVOTS))
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, PAGE):
                page = batch.slice(low, PAGE)
                body = matrix(page.column(0))
                lists = Lists(nearest_pivots(body, shared.value), len(shared.value))
                raw = [body.tobytes(), lists.members.astype("<u2").tobytes(), np.diff(lists.edge, prepend=0).astype("<u2").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([page.column(1).to_pylist()], pa.list_(pa.list_(pa.int64()))), *(pa.array([x], pa.binary()) for x in raw)], ["ids", "vectors", "members", "edge"])

    return written(distinct.mapInArrow(ts.thrifty(run), "ids array<array<long>>, vectors binary, members binary, edge binary")), pivots, sample, size


class Answers:
    """The nearest rows found so far for each query of a block."""

    def __init__(self, queries: np.ndarray, near: np.ndarray, bounds: np.ndarray, k: int):
        self.queries, self.near, self.bounds, self.k = queries, near, bounds, k
        self.distance = np.full((len(queries), k), np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def see(self, ids: list[list[int]], body: np.ndarray, lists: Lists, reach: int) -> None:
        """Rank a page for each query: by true distance those whose footrule distance is within the query's bound."""
        least = np.array([x[0] for x in ids])
        for q in range(len(self.queries)):
            best = np.flatnonzero(lists.footrule(self.near[q], reach) >= self.bounds[q])
            if not len(best):
                continue
            true = np.sqrt(((body[best] - self.queries[q]) ** 2).sum(1))
            first = np.lexsort((least[best], true))[: self.k]
            if true[first[0]] > self.distance[q, -1]:
                continue
            of = [(true[i], x) for i in first for x in ids[best[i]]]
            d = np.concatenate([self.distance[q], [x[0] for x in of]])
            who = np.concatenate([self.ids[q], [x[1] for x in of]])
            keep = np.lexsort((who, d))[: self.k]
            self.distance[q], self.ids[q] = d[keep], who[keep]


def _bounded(queries: DataFrame, pivots: np.ndarray, sample: np.ndarray, size: int, share: float, reach: int) -> DataFrame:
    """Distinct queries (h, g, e) with their nearest pivots and their bound: what the share of the sample reaches."""
    shared = queries.sparkSession.sparkContext.broadcast((pivots, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, sample = shared.value
        lists = Lists(nearest_pivots(sample, pivots), len(pivots)) if len(sample) else None
        take = min(len(sample), int(np.ceil(len(sample) * max(share, LEAST / max(size, 1)))))
        for batch in batches:
            near = nearest_pivots(matrix(batch.column(2)), pivots)
            bound = [0 if take == len(sample) else int(np.partition(lists.footrule(n, reach), len(sample) - take)[len(sample) - take]) for n in near]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([n.astype("<u2").tobytes() for n in near], pa.binary()), pa.array(bound, pa.int64())], ["h", "g", "e", "near", "bound"])

    return queries.select("h", "g", "e").mapInArrow(ts.thrifty(run), "h long, g long, e array<double>, near binary, bound long")


def _block(index: DataFrame, block: DataFrame, k: int, reach: int) -> DataFrame:
    """Per query of the block and task: h, g and the nearest rows found there (id, d)."""
    rows = block.orderBy("h", "g").toArrow().combine_chunks()
    names = np.stack([rows.column("h").to_numpy(), rows.column("g").to_numpy()], 1)
    queries = matrix(rows.column("e").combine_chunks()) if rows.num_rows else np.zeros((0, 0))
    near = [np.frombuffer(x, "<u2") for x in rows.column("near").to_pylist()]
    shared = index.sparkSession.sparkContext.broadcast((names, queries, near, rows.column("bound").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries, near, bounds = shared.value
        answers = Answers(queries, near, bounds, k + 1)
        for batch in batches:
            for ids, body, members, edge in zip(*batch.columns, strict=True):
                ids = ids.as_py()
                lists = Lists.__new__(Lists)
                lists.members = np.frombuffer(members.as_buffer(), "<u2").astype(np.int64)
                lists.edge = np.cumsum(np.frombuffer(edge.as_buffer(), "<u2").astype(np.int64))
                lists.size, lists.nearest = len(ids), len(lists.members) // len(ids)
                answers.see(ids, np.frombuffer(body.as_buffer(), np.float64).reshape(len(ids), -1), lists, reach)
        q, slot = np.nonzero(np.isfinite(answers.distance))
        yield pa.RecordBatch.from_arrays([pa.array(names[q, 0]), pa.array(names[q, 1]), pa.array(answers.ids[q, slot]), pa.array(answers.distance[q, slot])], ["h", "g", "id", "d"])

    return index.mapInArrow(ts.thrifty(run), "h long, g long, id long, d double")


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, share: float = SHARE, reach: int = REACH) -> DataFrame:
    """Per query row and rank: query_id, rank (int, from 1), vec_id, score (Euclidean distance in double precision).

    The k rows of vectors nearest to each row of queries that the index finds, but for those with the query's own id; ties
    go to the smaller id.  Vectors that are null, zero, or hold null or non-finite components take no part on
    either side, nor do null ids; an empty table gives no rows.  Repeated query rows count once.  share: of the vectors,
    those that are ranked by true distance; 1 makes the search exact.
    """
    spark = vectors.sparkSession
    index, pivots, sample, size = build(vectors, key, vector, k)
    asked = _rows(queries, key, vector).filter(F.size("e") == sample.shape[1])
    distinct = asked.groupBy("h", "g").agg(F.first("e").cast("array<double>").alias("e"))
    distinct = written(_bounded(distinct, pivots, sample, size, share, reach))
    blocks = max(1, -(-distinct.count() // BLOCK))
    path = shared_dir(spark)
    for b in range(blocks):
        block = distinct.filter(F.pmod(F.col("h"), F.lit(blocks)) == b)
        _block(index, block, k, reach).write.mode("append").parquet(path)
    found = spark.read.schema("h long, g long, id long, d double").parquet(path)
    order = Window.partitionBy("h", "g").orderBy("d", "id")
    best = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    listed = best.groupBy("h", "g").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("near"))
    own = asked.select("id", "h", "g").distinct().withColumnRenamed("id", "query_id")
    joined = own.join(listed, ["h", "g"]).select("query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k).alias("near"))
    return joined.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"))
