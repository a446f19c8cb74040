"""Byte-level BPE encoding and decoding with a local rank file, through the tiktoken library.

A long text is cut at safe boundaries before it is encoded: places where the split pattern
can't match across and looks no further, so that the ids are those of the whole text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import small_batches

#: Characters of text that are encoded in one go.
PIECE = 100_000
#: White space, as the library's regular expressions know it (fixed values).
BLANK = r"\t-\r \x85\xa0  -     　"
#: Before a lone blank between two other characters, or between a letter and a number.
SAFE = regex.compile(rf"(?<=[^{BLANK}])(?= [^{BLANK}])|(?<=\p{{L}})(?=\p{{N}})|(?<=\p{{N}})(?=\p{{L}})")
LONG_BLANK = regex.compile(rf"[{BLANK}]{{20000}}")

_loaded: dict[tuple[str, str], Codec] = {}


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.splitter = regex.compile(pattern.replace(r"^\s", f"^{BLANK}").replace(r"\s", f"[{BLANK}]"))
        self.digits = [str(i) for i in range(max(self.ranks.values()) + 1)]

    def encode(self, text: str) -> list[int]:
        if len(text) <= PIECE:
            return self._piece(text)
        ids: list[int] = []
        at = 0
        while at < len(text):
            cut = SAFE.search(text, at + PIECE) if at + PIECE < len(text) else None
            end = cut.start() if cut else len(text)
            ids += self._piece(text[at:end])
            at = end
        return ids

    def _piece(self, text: str) -> list[int]:
        if len(text) > 20_000 and LONG_BLANK.search(text):  # the library's matcher would exceed its backtracking limit
            return [i for m in self.splitter.finditer(text) for i in self.encoding._encode_single_piece(m[0].encode())]
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids, which need not be valid UTF-8."""
        return self.encoding.decode_bytes(ids)


def codec(rank_file: str, pattern: str) -> Codec:
    """The codec of a rank file, loaded once in each Python worker."""
    key = (rank_file, pattern)
    if key not in _loaded:
        _loaded[key] = Codec(rank_file, pattern)
    return _loaded[key]


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids", exact: str | None = None) -> DataFrame:
    """df with a column of token ids; with a name for exact, also whether the ids decode to the text's bytes.

    Null texts count as empty and have no ids.  All rows and columns stay; columns named
    like out or exact are replaced.  Narrow: no exchange.  The rank file's path must exist on every executor.
    """
    small_batches(df.sparkSession)
    kept = df.drop(out, *([exact] if exact else []))
    schema = kept.withColumn(out, F.array().cast("array<int>"))
    schema = (schema.withColumn(exact, F.lit(True)) if exact else schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                at = part.schema.get_field_index(text)
                texts = [t or "" for t in part.column(at).to_pylist()]
                ids = [c.encode(t) for t in texts]
                more = [pa.array(ids, pa.list_(pa.int32()))]
                if exact:
                    more.append(pa.array([c.decode(i) == t.encode() for i, t in zip(ids, texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], schema.names)

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the raw bytes that a column of ids stands for; null ids give no bytes."""
    small_batches(df.sparkSession)
    kept = df.drop(out)
    schema = kept.withColumn(out, F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            raw = pa.array([c.decode(x or []) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], [*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


def digests(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256.

    Encodes the text and decodes the ids in one pass over the batches, so that the ids
    themselves needn't leave the worker.  Null texts count as empty; repeated rows are kept.
    """
    small_batches(df.sparkSession)
    kept = df.select(key, F.col(text).alias("__text"))
    schema = kept.drop("__text").withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        digits = c.digits
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for value in batch.column(1):
                ids = c.encode(value.as_py() or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join([digits[i] for i in ids]).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return kept.mapInArrow(run, schema)
