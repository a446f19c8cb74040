"""Chat formatting by columnar byte assembly.

A turn becomes ``### role: text</turn>\\n``.  Inside roles and texts a backslash goes before
every backslash and before every control string (``### `` and ``</turn>``; in a role also
before ``:``), so that no content can pass for a mark and every text can be read back exactly.
Segment lengths, offsets and scatter indices are computed in numpy for a whole batch, whose
bytes are then copied into one preallocated buffer; that buffer is the Arrow column's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import small_batches
from basketry.llm.textscan import column_bytes, ragged

HEAD, ROLE_END, TAIL = b"### ", b": ", b"</turn>\n"
CONTROL = (b"### ", b"</turn>")
TURN = re.compile(rb"### ((?:[^\\:]|\\.)*): ((?:[^\\<]+|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)
ESCAPED = re.compile(rb"\\(.)", re.DOTALL)


def _starts(data: np.ndarray, offsets: np.ndarray, pattern: bytes) -> np.ndarray:
    """Where the pattern begins, within one value."""
    n = len(data) - len(pattern) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hit = data[:n] == pattern[0]
    for k in range(1, len(pattern)):
        hit &= data[k : k + n] == pattern[k]
    at = np.flatnonzero(hit)
    return at[np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(pattern) - 1, "right")]


def escaped(array: pa.Array, also: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the values with a backslash before what must be escaped."""
    data, offsets = column_bytes(array)
    marks = [np.flatnonzero(data == c) for c in b"\\" + also] + [_starts(data, offsets, c) for c in CONTROL]
    marked = np.zeros(len(data), bool)
    marked[np.concatenate(marks)] = True
    before = np.concatenate([[0], np.cumsum(marked)])
    out = np.full(len(data) + int(before[-1]), ord("\\"), np.uint8)
    out[np.arange(len(data)) + before[1:]] = data
    return out, offsets + before[offsets]


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all turns, their offsets, and where each escaped text starts and ends."""
    parts = [escaped(role, also=b":"), escaped(text)]
    n = len(role)
    fixed = [np.frombuffer(x, np.uint8) for x in (HEAD, ROLE_END, TAIL)]
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(HEAD), len(ROLE_END), len(TAIL)
    lengths[:, 1], lengths[:, 3] = np.diff(parts[0][1]), np.diff(parts[1][1])
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    at = ends - lengths
    out = np.empty(int(ends[-1, 4]) if n else 0, np.uint8)
    for k, mark in zip((0, 2, 4), fixed, strict=True):
        out[(at[:, k, None] + np.arange(len(mark))).ravel()] = np.tile(mark, n)
    for k, (data, _) in zip((1, 3), parts, strict=True):
        out[ragged(at[:, k], lengths[:, k])] = data
    return out, np.concatenate([[0], ends[:, 4]]) if n else np.zeros(1, np.int64), at[:, 3], ends[:, 3]


def format_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations in pieces: conv, piece (from 0), n_turns, formatted (bytes) and loss_spans (start and end of each
    assistant text in formatted, in bytes).

    One exchange by conversation; each task streams its turns in order, and a piece holds the turns that a conversation has in one batch, so
    that none is ever held whole.  A partition has the pieces of a conversation one after the other.  Turns of a conversation go by turn
    number (null first), equal numbers by role and text.  Null roles and texts count as empty; rows with a null conversation form
    one conversation, and so do those of NaN; repeated rows are repeated turns.
    """
    small_batches(df.sparkSession)
    name = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    rows = df.select(F.col(conv).alias("__c"), F.col(turn).alias("__t"), F.col(role).alias("__r"), F.col(text).alias("__x"), name.alias("__g"))
    rows = rows.repartition("__g").sortWithinPartitions("__g", "__t", "__r", "__x")
    conv_type = df.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, piece = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            body, offsets, low, high = assemble(batch.column(2), batch.column(3))
            names = batch.column(4).to_pylist()
            first = np.array([0, *(i for i in range(1, len(names)) if names[i] != names[i - 1])])
            pieces = np.zeros(len(first), np.int32)
            pieces[0] = piece + 1 if names[0] == last else 0
            last, piece = names[-1], int(pieces[-1])
            edges = offsets[np.append(first, len(names))]
            learn = np.array([x == "assistant" for x in batch.column(2).to_pylist()])
            shift = np.repeat(edges[:-1], np.diff(np.append(first, len(names))))
            spans = pa.StructArray.from_arrays([pa.array((low - shift)[learn]), pa.array((high - shift)[learn])], ["start", "end"])
            of = np.concatenate([[0], np.cumsum(learn)])[np.append(first, len(names))].astype(np.int32)
            # the buffer that the turns were copied into is the column's; a piece is a pair of offsets in it
            formatted = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(body)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), pa.array(pieces), pa.array(np.diff(np.append(first, len(names)))), formatted, pa.ListArray.from_arrays(pa.array(of), spans)], [conv, "piece", "n_turns", "formatted", "loss_spans"])

    return rows.mapInArrow(run, f"`{conv}` {conv_type}, piece int, n_turns long, formatted binary, loss_spans array<struct<start:long,end:long>>")


def read_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """Role and text of every turn of a formatted conversation."""
    found = []
    at = 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at byte {at}")
        found.append((ESCAPED.sub(rb"\1", m[1]), ESCAPED.sub(rb"\1", m[2])))
        at = m.end()
    return found


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Read conversations back from format_turns' output and digest them: conv, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.

    Pieces of a conversation must follow each other in a partition, as format_turns gives them; digests run over them.
    """
    conv_type = formatted.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        held: list | None = None  # key, turns, digest of all, characters and digest under the mask, characters formatted

        def out(done: list[list]) -> pa.RecordBatch:
            rows = [(x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]) for x in done]
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], kind), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True))], [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind = batch.column(0).type
            done = []
            for key, piece, body, spans in zip(*batch.columns, strict=True):
                if piece.as_py() == 0:
                    if held is not None:
                        done.append(held)
                    held = [key.as_py(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                body = body.as_py()
                turns = read_turns(body)
                for role, text in turns:
                    held[2].update(b"%s\n%s\n" % (role, text))
                for span in spans.as_py():
                    plain = ESCAPED.sub(rb"\1", body[span["start"] : span["end"]])
                    held[4].update(plain)
                    held[3] += len(plain.decode())
                held[1] += len(turns)
                held[5] += len(body.decode())
            if done:
                yield out(done)
        if held is not None:
            yield out([held])

    return formatted.select(conv, "piece", "formatted", "loss_spans").mapInArrow(run, f"`{conv}` {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
