"""Substring deduplication by Rabin-Karp hashes of every fixed-length window of words.

Each window's rolling hash is sent, packed with its place, to a hash bucket; Spark's exchange brings
equal hashes together, where they are counted.  Windows counted more than once, anywhere, are repeats, and
overlapping or touching repeats merge into maximal intervals of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import textscan as ts
from basketry.llm.common import buckets_for, small_batches, text_or_empty
from basketry.llm.spans import pack, read_spans, spanned, unpack


def _emit(width: int, key: int):
    def emit(data: np.ndarray, offsets: np.ndarray, buckets: int):
        starts, ends, doc = ts.words(data, offsets)
        sizes = np.bincount(doc, minlength=len(offsets) - 1)
        rolled = ts.sequence_hashes(ts.word_hashes(data, starts, ends, key), width, key)
        inside = np.flatnonzero(doc[: len(rolled)] == doc[width - 1 :]) if len(rolled) else np.zeros(0, np.int64)
        rolled = rolled[inside]
        # another function of the bytes, from the words on
        second = (ts.sequence_hashes(ts.word_hashes(data, starts, ends, key + 1), width, key + 1)[inside] >> np.uint64(32)).astype("<u4") if len(inside) else np.zeros(0, "<u4")
        bucket = ((rolled >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(rolled, kind="stable")
        # windows that come again in the batch are sent once, with the others' places behind: a passage that all texts
        # hold is a few rows of each batch, not of each text
        new = np.ones(len(order), bool)
        new[1:] = (rolled[order[1:]] != rolled[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
        edges = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))

        def rows() -> Iterator[tuple[int, bytes, bytes, bytes]]:
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                pick, lead = order[low:high], np.flatnonzero(new[low:high])
                more = np.diff(np.append(lead, len(pick))) - 1
                by = np.argsort(pick[lead])
                more = more[by]
                first, behind = pick[lead[by]], pick[ts.ragged(lead[by] + 1, more)]
                # the top byte says little that the bucket doesn't, so seven bytes of the first hash are sent
                hashes = np.zeros((len(first), 12), np.uint8)
                hashes[:, :8] = rolled[first].astype("<u8").view(np.uint8).reshape(-1, 8)
                hashes[:, 7:11] = second[first].view(np.uint8).reshape(-1, 4)
                yield int(bucket[first[0]]), hashes[:, :11].tobytes(), pack(np.diff(inside[first], prepend=0)), pack(more) + pack(inside[behind])

        return rows(), sizes

    return emit


def _judge(width: int):
    def judge(rows: list[tuple[int, bytes, bytes, bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if not rows:
            return
        counts = [len(a) // 11 for _, a, _, _ in rows]
        raw = np.frombuffer(b"".join(a for _, a, _, _ in rows), np.uint8).reshape(-1, 11)
        repeated = np.concatenate([unpack(c[: 4 * n]) > 0 for (_, _, _, c), n in zip(rows, counts, strict=True)])
        values = np.zeros((2, len(raw), 8), np.uint8)
        values[0, :, :7], values[1, :, :4] = raw[:, :7], raw[:, 7:]
        first, second = values[0].copy().view("<u8").ravel(), values[1].copy().view("<u8").ravel()
        order = np.lexsort((second, first))
        same = (first[order[1:]] == first[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        at = 0
        for (batch, _, places, c), n in zip(rows, counts, strict=True):
            mine = repeated[at : at + n]
            at += n
            if mine.any():
                starts = np.concatenate([np.cumsum(unpack(places))[mine], unpack(c[4 * n :])])
                yield batch, starts, starts + width

    return judge


def repeats(docs: DataFrame, text: str = "text", width: int = 35) -> tuple[DataFrame, str]:
    """docs with a column of spans (pairs of int64: the intervals of words that repeated windows cover; null for none), and its name.

    A window is width consecutive words (runs of bytes other than 0x20, 0x09-0x0D) of one text; it is
    repeated if its words also start anywhere else, same text included.  Windows are told apart by 88 bits of two
    rolling hashes and the bucket; both are keyed anew for each run and share nothing from the words' bytes on.  Null and empty texts, and texts with fewer words, have no windows.  Every row stays,
    once; equal rows count as different texts.
    """
    return spanned(docs, text, _emit(width, ts.fresh_key()), _judge(width), 2 * buckets_for(docs, text_or_empty(text)))


def _kept(data: np.ndarray, offsets: np.ndarray, spans: list[bytes | None]):
    """Words and removed words of each text, and the kept words joined by one blank, with offsets."""
    starts, ends, doc = ts.words(data, offsets)
    sizes = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(sizes)])
    mask = ~ts.SPACE[data]
    removed = np.zeros(len(sizes), np.int64)
    gone = np.zeros(len(starts), bool)
    for i, raw in enumerate(spans):
        for low, high in read_spans(raw):
            removed[i] += high - low
            gone[first[i] + low : first[i] + high] = True
            mask[starts[first[i] + low] : ends[first[i] + high - 1]] = False
    data = data.copy()
    after = ends[~gone]
    last = offsets[doc[~gone] + 1]
    after = after[after < last]
    mask[after] = True
    data[after] = 0x20
    running = np.concatenate([[0], np.cumsum(mask)])
    return sizes, removed, data[mask], running[offsets]


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 35) -> DataFrame:
    """Per row: key, n_words, n_removed, kept_sha256 (of the kept words joined by one blank)."""
    small_batches(docs.sparkSession)
    marked, spans = repeats(docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")), "t", width)
    marked = marked.select("k", "t", spans)
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in ts.slices(whole, "t", ts.SEGMENT):
                sizes, removed, kept, offsets = _kept(*ts.column_bytes(batch.column(1)), batch.column(2).to_pylist())
                digest = []
                for low, high in zip(offsets[:-1], offsets[1:], strict=True):
                    if high > low and kept[high - 1] == 0x20:
                        high -= 1
                    digest.append(hashlib.sha256(kept[low:high]).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], [key, "n_words", "n_removed", "kept_sha256"])

    return marked.mapInArrow(ts.thrifty(run), f"`{key}` {key_type}, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, text: str = "text", width: int = 35) -> DataFrame:
    """docs without the repeated words: columns and rows stay, a text loses each removed interval up to
    the next kept word.  Texts without repeats stay as they are, null ones included."""
    small_batches(docs.sparkSession)
    marked, spans = repeats(docs, text, width)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = names.index(text)
            texts = batch.column(at).to_pylist()
            for i, raw in enumerate(batch.column(names.index(spans)).to_pylist()):
                if not raw:
                    continue
                body = texts[i].encode()
                starts, _, _ = ts.words(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
                edge = np.append(starts, len(body))
                pieces, low = [], 0
                for a, b in read_spans(raw):
                    pieces.append(body[low : edge[a]])
                    low = edge[b]
                texts[i] = b"".join([*pieces, body[low:]]).decode()
            cols = [pa.array(texts, pa.string()) if c == text else batch.column(names.index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays(cols, columns)

    return marked.select(*columns, spans).mapInArrow(ts.thrifty(run), docs.select(*[F.col(c) for c in columns]).schema)
