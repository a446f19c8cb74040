"""The exchange that both substring operators share: repeats found by bucket, gathered by batch, joined to texts.

A map task lays a few megabytes of texts end to end (a batch), and sends what may repeat to hash
buckets.  A bucket answers with places in batches.  A batch's answers, and the directory of its texts
that the map task sent, give spans for each text; equal texts have equal spans, so these are keyed by
the text's SHA-256 and joined to all rows that hold it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import textscan as ts
from basketry.llm.common import content_key, small_batches, text_or_empty, unused, written

#: What a map task sends to a bucket: data of a batch, or (with what = 1) the batch's directory.
SENT = "bucket int, batch long, what int, a binary, b binary, c binary"
ANSWER = "batch long, what int, a binary, b binary"
#: Bytes of text in a batch.
BATCH = 2 << 20

#: From a batch's bytes, offsets and number of buckets: (bucket, a, b, c) rows and the size in units of each text.
Emit = Callable[[np.ndarray, np.ndarray, int], tuple[Iterator[tuple[int, bytes, bytes, bytes]], np.ndarray]]
#: From the rows of a bucket: for each (batch, starts, ends) of repeated spans, in units of the batch.
Judge = Callable[[list[tuple[int, bytes, bytes, bytes]]], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def spanned(docs: DataFrame, text: str, emit: Emit, judge: Judge, buckets: int) -> tuple[DataFrame, str]:
    """docs with a column of spans (null where a text has none), and its name, which docs didn't have."""
    key, spans = unused(docs, "key"), unused(docs, "spans")
    texts = docs.select(text_or_empty(text).alias("__text")).withColumn("__key", content_key(F.col("__text")))
    found = found_spans(texts, emit, judge, buckets).select(F.col("__key").alias(key), F.col("__spans").alias(spans))
    return docs.withColumn(key, content_key(text_or_empty(text))).join(found, key, "left").drop(key), spans


def pack(planes: np.ndarray) -> bytes:
    """Whole numbers below 2**32 as byte planes: what is small everywhere compresses to nothing."""
    return np.ascontiguousarray(planes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def found_spans(keyed_docs: DataFrame, emit: Emit, judge: Judge, buckets: int) -> DataFrame:
    """Per distinct text with repeats: __key and __spans (pairs of int64: start and end in units)."""
    small_batches(keyed_docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(ts.gathered(batches, "__text", BATCH)):
            keys = b"".join(batch.column(1).to_pylist())
            data, offsets = ts.column_bytes(batch.column(0))
            place = struct.pack("<qq", TaskContext.get().partitionId(), number)
            name = int.from_bytes(hashlib.blake2b(keys + place, digest_size=8).digest(), "little", signed=True)
            rows, sizes = emit(data, offsets, buckets)
            out: list[tuple] = []
            for bucket, a, b, c in rows:
                out.append((bucket, name, 0, a, b, c))
                if len(out) == 64:
                    yield _batch(out)
                    out = []
            out.append((name % buckets, name, 1, keys, pack(sizes), b""))
            yield _batch(out)

    def answer(group: pa.Table) -> pa.Table:
        data: list[tuple[int, bytes, bytes, bytes]] = []
        rows = {"batch": [], "what": [], "a": [], "b": []}
        for batch, what, a, b, c in zip(*(group.column(x).to_pylist() for x in ("batch", "what", "a", "b", "c")), strict=True):
            if what:
                for k, v in zip(rows, (batch, 1, a, b), strict=True):
                    rows[k].append(v)
            else:
                data.append((batch, a, b, c))
        for batch, starts, ends in judge(data):
            for k, v in zip(rows, (batch, 0, pack(starts), pack(ends)), strict=True):
                rows[k].append(v)
        del data
        ts.released()
        return pa.table(rows, schema=pa.schema([("batch", pa.int64()), ("what", pa.int32()), ("a", pa.binary()), ("b", pa.binary())]))

    def gather(group: pa.Table) -> pa.Table:
        starts, ends, keys, sizes = [], [], b"", np.zeros(0, np.int64)
        for what, a, b in zip(*(group.column(x).to_pylist() for x in ("what", "a", "b")), strict=True):
            if what:
                keys, sizes = a, unpack(b)
            else:
                starts.append(unpack(a))
                ends.append(unpack(b))
        out_keys, out_spans = [], []
        if starts and len(sizes):
            first = np.concatenate([[0], np.cumsum(sizes)])
            depth = np.zeros(first[-1] + 1, np.int32)
            np.add.at(depth, np.concatenate(starts), 1)
            np.add.at(depth, np.concatenate(ends), -1)
            covered = np.cumsum(depth[:-1]) > 0
            for i in np.unique(np.searchsorted(first, np.flatnonzero(covered), "right") - 1):
                low, high = ts.runs(covered[first[i] : first[i + 1]])
                out_keys.append(keys[32 * i : 32 * i + 32])
                out_spans.append(np.stack([low, high], 1).astype("<i8").tobytes())
        return pa.table({"__key": out_keys, "__spans": out_spans}, schema=pa.schema([("__key", pa.binary()), ("__spans", pa.binary())]))

    sent = keyed_docs.select("__text", "__key").mapInArrow(ts.thrifty(send), SENT)
    answers = sent.groupBy("bucket").applyInArrow(answer, ANSWER)
    spans = answers.groupBy("batch").applyInArrow(gather, "__key binary, __spans binary")
    # written, so that Spark can split the later join where one text has many copies
    return written(spans.groupBy("__key").agg(F.max("__spans").alias("__spans")))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["bucket", "batch", "what", "a", "b", "c"])


def read_spans(raw: bytes | None) -> np.ndarray:
    return np.frombuffer(raw or b"", "<i8").reshape(-1, 2)
