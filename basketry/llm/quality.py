"""Quality classifier with supervised subword embeddings.

A text is the mean of the learned vectors of its words, word pairs and character n-grams (hashed into a
fixed number of buckets), and a softmax layer gives its class.  The model is trained by numpy stochastic
gradient descent on a bounded sample of labelled texts.  Because mean and layer are linear, scoring needs one
number for each bucket: the model that executors get is a vector of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import textscan as ts
from basketry.llm.common import small_batches

#: Buckets of the hashed features, as a power of two.
BITS = 17
#: Length of a vector.
DIMENSION = 8
#: Character n-grams, counted in bytes of UTF-8; a word's edges count as one.
GRAMS = (3, 4, 5)
#: Distances at which a repeated word counts as a word n-gram.
REPEATS = (1, 2, 3)
#: Most labelled texts that the model is fitted on: those with the smallest hash of doc_id.
SAMPLE = 3000
EPOCHS = 6
RATE = 2.0
BATCH = 8


@dataclass
class Model:
    """weight: each bucket's part in the logit of class 1 against class 0; bias: of an empty text too."""

    weight: np.ndarray
    bias: float


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (((hashes + np.uint64(kind)) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - BITS)).astype(np.int32)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: buckets, in the texts' order, and the offsets of each text's in them."""
    n = len(offsets) - 1
    # texts with a blank before, between and after them, all white space as blanks
    spread = np.full(len(data) + n + 1, 0x20, np.uint8)
    spread[ts.ragged(offsets[:-1] + np.arange(1, n + 1), np.diff(offsets))] = np.where(ts.SPACE[data], np.uint8(0x20), data)
    low, high = offsets[:-1] + np.arange(1, n + 1), offsets[1:] + np.arange(1, n + 1)
    starts, ends, _ = ts.words(spread, np.array([0, len(spread)]))
    if not len(starts):
        for _ in range(2 + len(REPEATS) + len(GRAMS)):
            yield np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        return
    words = ts.span_hashes(spread, starts, ends)
    first = np.searchsorted(starts, np.append(low, len(spread)))
    yield _bucket(words, 1), first
    doc = np.searchsorted(high, starts, "right")
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    yield _bucket(words[pair] * np.uint64(3) + words[pair + 1], 2), np.searchsorted(pair, first)
    # a word that comes again one, two or three words on is an n-gram of its own, whatever the word
    for lag in REPEATS:
        again = np.flatnonzero((words[lag:] == words[:-lag]) & (doc[lag:] == doc[:-lag]))
        yield np.full(len(again), _bucket(np.array([lag], np.uint64), 9)[0]), np.searchsorted(again, first)
    blank = np.concatenate([[0], np.cumsum(spread == 0x20)])
    values = spread.astype(np.uint64) + np.uint64(1)
    for k in GRAMS:
        if len(spread) < k:
            yield np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
            continue
        rolled = np.zeros(len(spread) - k + 1, np.uint64)
        for j in range(k):
            rolled += values[j : j + len(rolled)] * np.uint64(pow(ts.BYTE_BASE, j + 1, 1 << 64))
        inside = np.flatnonzero(blank[k - 1 : k - 1 + len(rolled)] == blank[1 : 1 + len(rolled)])
        yield _bucket(ts.mix(rolled[inside]), k + 1), np.searchsorted(inside + 1, np.append(low, len(spread)))


def _counted(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and shares of each text."""
    kinds = list(features(data, offsets))
    out = []
    for i in range(len(offsets) - 1):
        ids, n = np.unique(np.concatenate([b[o[i] : o[i + 1]] for b, o in kinds]), return_counts=True)
        out.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    return out


def sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", rows: int = SAMPLE, fold: tuple[int, int] | None = None) -> DataFrame:
    """At most rows labelled texts (__k: hash of the key, __y, __text), those with the smallest hash of the key.

    fold (m, r): without rows whose crc32(key as text) mod m is r.  Only keys and labels are sorted; texts are
    fetched by a join with the chosen keys, whose number is bounded.  Keys may be of any type; labels other than 0 and 1 are
    left out; of a key that repeats, the least label and the least text count.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y")).dropna()
    if fold:
        known = known.filter(F.crc32(F.col("__k").cast("string").cast("binary")) % fold[0] != fold[1])
    chosen = known.groupBy("__k").agg(F.min("__y").alias("__y")).orderBy(F.xxhash64("__k"), "__k").limit(rows)
    found = docs.select(F.col(key).alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(chosen), "__k")
    return found.groupBy(F.xxhash64("__k").alias("__k"), "__y").agg(F.min("__text").alias("__text"))


def fit(examples: DataFrame, rows: int = SAMPLE, seed: int = 7) -> Model:
    """Train on examples (__k, __y, __text), of which there are at most rows (repeated keys count once).

    Executors turn texts into bucket shares, the driver trains on these.  Without examples of both classes the
    model gives every text the share of class 1 (0.5 without any).
    """
    small_batches(examples.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _counted(*ts.column_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([b.tobytes() for _, b in got], pa.binary())], ["k", "y", "ids", "shares"])

    found = examples.mapInArrow(ts.thrifty(run), "k long, y int, ids binary, shares binary").dropDuplicates(["k"]).toArrow()
    order = np.argsort(found.column("k").to_numpy(), kind="stable")[:rows]
    y = found.column("y").to_numpy()[order]
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()), 0.01), 0.99) if len(y) else 0.5
        return Model(np.zeros(1 << BITS), float(np.log(p / (1 - p))))
    raw_ids, raw_shares = found.column("ids"), found.column("shares")
    ids = [np.frombuffer(raw_ids[int(i)].as_py(), np.int32) for i in order]
    shares = [np.frombuffer(raw_shares[int(i)].as_py(), np.float32) for i in order]
    del found, raw_ids, raw_shares
    model = train(ids, shares, y, seed)
    # the driver goes on to other steps
    del ids, shares
    ts.released()
    return model


def train(ids: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (1 << BITS, DIMENSION)).astype(np.float32)
    layer = rng.normal(0, 1, (DIMENSION, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    bias[1] = np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))
    full = [i for i in range(len(y)) if len(ids[i])]
    steps, done = EPOCHS * (len(full) // BATCH + 1), 0
    for _ in range(EPOCHS):
        rng.shuffle(full)
        for at in range(0, len(full), BATCH):
            pick = full[at : at + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            which, share = np.concatenate([ids[i] for i in pick]), np.concatenate([shares[i] for i in pick])
            edge = np.cumsum([0, *(len(ids[i]) for i in pick)])[:-1]
            mean = np.add.reduceat(vectors[which] * share[:, None], edge)
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            back = p @ layer.T
            layer -= rate / len(pick) * mean.T @ p
            bias -= 0.1 * rate / len(pick) * p.sum(0)
            row = np.repeat(np.arange(len(pick)), [len(ids[i]) for i in pick])
            # a text's features share its gradient, so the step is scaled up by how many these are
            np.subtract.at(vectors, which, (8 * rate) * back[row] * share[:, None])
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def logits(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for buckets, first in features(data, offsets):
        running = np.concatenate([[0.0], np.cumsum(model.weight[buckets])])
        total += running[first[1:]] - running[first[:-1]]
        count += np.diff(first)
    return total / np.maximum(count, 1) + model.bias


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of class 1.  Empty and null texts get that of the bias alone.

    Narrow: the model, of fixed size, is broadcast, and texts are scored whole, some 100 kB at a time.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    kept = docs.drop(out)
    schema = kept.withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for whole in batches:
            for batch in ts.slices(whole, text, 1 << 18):
                z = logits(known, *ts.column_bytes(batch.column(batch.schema.get_field_index(text))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-z)))], [*batch.schema.names, out])

    return kept.mapInArrow(ts.thrifty(run), schema)
