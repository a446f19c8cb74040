"""Exact k-means over whole numbers, with centroids screened by the norms of blocks.

A vector is cut into segments.  Of each, its mean and the norm of what is left without it are precomputed: the compressed vector.
As the mean's direction and the rest are orthogonal, and by Cauchy-Schwarz the rests of two segments are no nearer than their norms, the distance
of two compressed vectors never exceeds that of the vectors.  A vector gets an exact distance from the centroid whose bound is least, and then only from
those whose bound doesn't exceed it.  Distances and sums are whole numbers, so results don't depend on partitions or on
tasks that run again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import small_batches, written

#: Segments of a vector; each is compressed to two numbers.
SEGMENTS = 8
#: Share of a bound's terms that rounding may have added to it.
SLACK = 1e-9
#: Pairs of vectors and centroids whose exact distances are taken in one go.
PAIRS = 1 << 15
#: Sums of larger numbers are added in pieces of so many bits.
PIECE = 40
LONG = (1 << 63) - 1


def small_size(dimensions: int) -> int:
    """Whole numbers below this size are held in 32 bits, and their squared distances in 64."""
    return min(1 << 30, math.isqrt((1 << 62) // max(dimensions, 1)) // 2)


QUANTISED = "id {}, small binary, large binary, bounds binary"


def quantised(rows: DataFrame, key: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """Rows with exactly so many components, none null or not finite, as whole numbers floor(scale * x).

    id; small (32-bit numbers) or, where one doesn't fit, large (doubles); bounds (the compressed vector).  Components whose product with the
    scale isn't finite leave the row out, like those that aren't finite themselves.
    """
    small_batches(rows.sparkSession)
    x = F.transform(vector, lambda c: c.cast("double") * float(scale))
    whole = F.filter(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.filter(F.size(vector) == dimensions).select(F.col(key).alias("id"), x.alias("x")).filter(F.size(whole) == dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.floor(np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, dimensions))
            fits = (np.abs(values) < small_size(dimensions)).all(axis=1)
            low = compressed(values)
            small = [v.astype("<i4").tobytes() if f else None for v, f in zip(values, fits, strict=True)]
            large = [None if f else v.astype("<f8").tobytes() for v, f in zip(values, fits, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(small, pa.binary()), pa.array(large, pa.binary()), pa.array([b.astype("<f8").tobytes() for b in low], pa.binary())], ["id", "small", "large", "bounds"])

    return kept.mapInArrow(run, QUANTISED.format(kept.schema["id"].dataType.simpleString()))


def compressed(values: np.ndarray) -> np.ndarray:
    """Per vector and segment: the mean times the root of the length, and the norm of the rest."""
    out = []
    for part in np.array_split(np.asarray(values, np.float64), SEGMENTS, axis=1):
        n = max(part.shape[1], 1)
        mean = part.sum(axis=1) / n
        out += [mean * np.sqrt(n), np.sqrt(np.square(part - mean[:, None]).sum(axis=1))]
    return np.stack(out, 1)


@dataclass
class Screen:
    """Centroids (whole numbers of any size) with their compressed forms."""

    centroids: list[list[int]]

    def __post_init__(self) -> None:
        limit = small_size(len(self.centroids[0]))
        self.small = all(abs(c) < limit for row in self.centroids for c in row)
        self.exact = np.array(self.centroids, np.int64 if self.small else object)
        self.low = compressed(np.array([[float(c) for c in row] for row in self.centroids]))

    def nearest(self, values: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Centroid and squared distance of each vector, ties to the smaller number, and how many exact distances that took."""
        exact = self.exact
        if values.dtype == object or not self.small:
            values, exact = values.astype(object), exact.astype(object)
        with np.errstate(all="ignore"):
            square, centre = np.square(low).sum(axis=1), np.square(self.low).sum(axis=1)
            scale = square[:, None] + centre
            bound = scale - 2.0 * (low @ self.low.T) - SLACK * scale
        bound = np.where(np.isfinite(bound), bound, -1.0)
        first = np.argmin(bound, axis=1)
        roof = _distances(values, exact, np.arange(len(values)), first)
        roof = (roof if roof.dtype != object else np.array([float(d) if d < 10**300 else math.inf for d in roof])) * (1 + SLACK)
        # by row and then by centroid: the first least distance of a row is the choice
        row, number = np.nonzero((bound <= roof[:, None]) | (np.arange(len(self.low)) == first[:, None]))
        distance = _distances(values, exact, row, number)
        start = np.searchsorted(row, np.arange(len(values)))
        best = np.minimum.reduceat(distance, start) if len(start) else distance
        hit = np.flatnonzero(distance == best[row])
        at = number[hit[np.searchsorted(row[hit], np.arange(len(values)))]]
        return at, best, len(values) + len(row)


def _distances(values: np.ndarray, centroids: np.ndarray, rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), values.dtype)
    for a in range(0, len(rows), PAIRS):
        gap = values[rows[a : a + PAIRS]] - centroids[numbers[a : a + PAIRS]]
        out[a : a + PAIRS] = (gap * gap).sum(axis=1)
    return out


def _values(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in the batch, whole numbers and compressed vectors: first those of 32 bits, then the others."""
    small, large, bounds = (batch.column(batch.schema.get_field_index(c)) for c in ("small", "large", "bounds"))
    low = np.frombuffer(b"".join(bounds.to_pylist()), "<f8").reshape(batch.num_rows, -1)
    held = np.asarray(small.is_valid())
    for some, column in ((np.flatnonzero(held), small), (np.flatnonzero(~held), large)):
        if len(some):
            raw = b"".join(x for x in column.to_pylist() if x is not None)
            if column is small:
                yield some, np.frombuffer(raw, "<i4").reshape(-1, dimensions).astype(np.int64), low[some]
            else:
                yield some, np.array([int(v) for v in np.frombuffer(raw, "<f8")], object).reshape(-1, dimensions), low[some]


def _pieces(value: int) -> Iterator[tuple[int, int]]:
    """value as sums of piece times 2 ** (PIECE * number)."""
    number = 0
    while abs(value) >= 1 << 62:
        yield number, value & ((1 << PIECE) - 1)
        value >>= PIECE
        number += 1
    yield number, value


def _moved(vectors: DataFrame, screen: Screen, dimensions: int) -> list[list[int]]:
    """The centroids after one round: at most centroids times dimensions sums, and the counts, come to the driver."""
    k = len(screen.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = {}, np.zeros(k, np.int64)
        for batch in batches:
            for _, values, low in _values(batch, dimensions):
                at, _, _ = screen.nearest(values, low)
                counts += np.bincount(at, minlength=k)
                for c in np.unique(at).tolist():
                    sums[c] = sums.get(c, 0) + values[at == c].sum(axis=0).astype(object)
        rows = [(c, -1, 0, int(counts[c])) for c in sums]
        rows += [(c, d, number, piece) for c, total in sums.items() for d, value in enumerate(total.tolist()) for number, piece in _pieces(value)]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "dimension", "piece", "value"])

    added = vectors.mapInArrow(run, "cluster int, dimension int, piece int, value long").groupBy("cluster", "dimension", "piece").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s"))
    totals: dict[tuple[int, int], int] = {}
    for r in added.collect():
        at = (r["cluster"], r["dimension"])
        totals[at] = totals.get(at, 0) + (int(r["s"]) << (PIECE * r["piece"]))
    return [[totals[c, d] // totals[c, -1] for d in range(dimensions)] if totals.get((c, -1)) else old for c, old in enumerate(screen.centroids)]


def seeds(vectors: DataFrame, k: int, dimensions: int, prefix: str) -> list[list[int]]:
    """Whole numbers of the k vectors whose ``<prefix><id>`` has the smallest SHA-256, in its order; equal ids in the order of their numbers."""
    name = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = vectors.withColumn("h", name).orderBy("h", "small", "large").limit(k).collect()
    return [[int(v) for v in (np.frombuffer(r["small"], "<i4") if r["small"] is not None else np.frombuffer(r["large"], "<f8"))] for r in first]


def cluster(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, prefix: str = "2:") -> DataFrame:
    """Per vector: key, cluster, distance (squared, to its centroid), cluster_inertia, inertia and centroid_sha256.

    Vectors with another number of components, or one that is null or not finite, take no part; an empty table has no rows and fewer
    vectors than k are as many centroids.  Equal rows count as different vectors.  A null key is an empty text where seeds are chosen.
    An empty cluster keeps its centroid.  Distances and sums beyond a long are given as the largest long.
    """
    vectors = written(quantised(rows, key, vector, dimensions, scale))
    centroids = seeds(vectors, k, dimensions, prefix)
    if not centroids:
        return vectors.select(F.col("id").alias(key), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = _moved(vectors, Screen(centroids), dimensions)
    screen = Screen(centroids)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    id_type = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for some, values, low in _values(batch, dimensions):
                at, best, _ = screen.nearest(values, low)
                number[some] = at
                distance[some] = best if best.dtype != object else [min(d, LONG) for d in best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number), pa.array(distance), pa.array([digests[i] for i in number])], ["id", "cluster", "distance", "centroid_sha256"])

    assigned = written(vectors.mapInArrow(run, f"id {id_type}, cluster int, distance long, centroid_sha256 string"))
    # one row for each centroid
    each = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    long = lambda n: F.lit(min(n, LONG)).cast("long")

    own = F.create_map(*[x for c, n in sorted(each.items()) for x in (F.lit(c), long(n))])[F.col("cluster")]
    return assigned.select(F.col("id").alias(key), "cluster", "distance", own.alias("cluster_inertia"), long(sum(each.values())).alias("inertia"), "centroid_sha256")
