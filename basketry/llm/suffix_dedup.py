"""Exact substring deduplication on bytes by a distributed merge sort of suffixes.

Which suffixes are sorted.  Every string of ``length`` bytes is represented by one anchor in it: the
start of its smallest 16-byte hash, leftmost on ties.  The choice looks at the string alone, so equal
strings have equal anchors at equal distances.  A text's anchors are about a hundredth of its bytes, and
each one answers for a contiguous range of string starts.

How they are sorted.  A map task sorts the suffixes at its anchors (each with the bytes before it that
its strings need) and sends sorted runs to buckets, front-coded: common-prefix length with the one before,
then the rest.  Suffixes that share fewer than 16 bytes are never compared, so runs are dealt by a hash
of these 16 bytes.  A bucket merges its runs with a loser tree that carries common-prefix lengths: two
suffixes whose known prefixes with the last winner differ in length are ordered by these alone, and
otherwise comparison starts behind the known prefix.

What comes out.  Neighbours with 16 bytes in common or more form a family.  For each distance d that its members answer
for, the merged common prefixes say which suffixes have the 200 - d bytes after the anchor in common, and a sort of what goes
before the anchors says which have the d bytes before it in common; strings alike in both occur twice or more.
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

#: Bytes that a suffix must share with another to be in its family.
SEED = 16
_codec = pa.Codec("zstd", 1)


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def _expand(raw: bytes) -> bytes:
    n = int.from_bytes(raw[:8], "little")
    return _codec.decompress(raw[8:], n, asbytes=True) if n else b""


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every width consecutive values, by doubling."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the strings of length bytes that lie within one text, and the first and last string
    start that each answers for."""
    none = np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    sizes = np.diff(offsets)
    at = 0
    # texts are taken together up to a segment; a longer one is cut, with an overlap of a string
    while at < len(sizes):
        low = int(offsets[at])
        to = max(at + 1, int(np.searchsorted(offsets, low + ts.SEGMENT, "right")) - 1)
        high = int(offsets[to])
        for a in range(low, high, ts.SEGMENT):
            b = min(high, a + ts.SEGMENT + length - 1)
            if b - a < length:
                break
            grams = ts.window_hashes(data[a:b].astype(np.uint64) + np.uint64(1), SEED, ts.BYTE_BASE)
            keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
            least = (sliding_min(keys, length - SEED + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64) + a
            starts = np.arange(a, a + len(least))
            inside = np.searchsorted(offsets, starts, "right") == np.searchsorted(offsets, starts + length - 1, "right")
            starts, least = starts[inside], least[inside]
            if len(starts):
                edge = np.flatnonzero(np.concatenate([[True], (np.diff(least) != 0) | (np.diff(starts) != 1)]))
                last = np.append(edge[1:], len(starts)) - 1
                found.append((least[edge], starts[edge], starts[last]))
        at = to
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)  # type: ignore[return-value]


def _emit(length: int):
    left_room = length - SEED

    def emit(data: np.ndarray, offsets: np.ndarray, buckets: int):
        anchor, low, high = anchors(data, offsets, length)
        padded = np.concatenate([np.zeros(left_room, np.uint8), data, np.zeros(length, np.uint8)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, length + left_room)
        bucket = np.zeros(len(anchor), np.int64)
        for a in range(0, len(anchor), 1 << 16):
            heads = windows[anchor[a : a + (1 << 16)], left_room : left_room + SEED].copy().view("<u8").reshape(-1, 2)
            bucket[a : a + (1 << 16)] = ((ts.mix(heads[:, 0] + ts.mix(heads[:, 1])) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))

        def rows() -> Iterator[tuple[int, bytes, bytes, bytes]]:
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                pick = order[a:b]
                yield int(bucket[pick[0]]), *sorted_run(windows[anchor[pick]], anchor[pick], low[pick], high[pick], length)

        return rows(), np.diff(offsets)

    return emit


def sorted_run(around: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[bytes, bytes, bytes]:
    """A front-coded sorted run: (common prefixes, lengths and rests of suffixes and what goes before), places.

    around: a row for each anchor, length - SEED bytes before it and length bytes from it on.
    """
    left_room = length - SEED
    before, after = anchor - low, high + length - anchor
    column = np.arange(length)
    table = np.zeros((len(anchor), length + left_room + 4), np.uint8)
    table[:, :length] = np.where(column < after[:, None], around[:, left_room:], 0)
    table[:, length : length + left_room] = np.where(np.arange(left_room) >= left_room - before[:, None], around[:, :left_room], 0)
    # lengths settle the order of what differs only in trailing zeros, and 1 ends each row with a byte that isn't zero
    table[:, -4], table[:, -3], table[:, -2], table[:, -1] = after % 256, after // 256, before % 256, 1 + before // 256
    order = np.argsort(table.view(f"S{table.shape[1]}").ravel(), kind="stable")
    table, before, after, anchor = table[order], before[order], after[order], anchor[order]
    new = np.ones(len(table), bool)
    new[1:] = (table[1:] != table[:-1]).any(1)
    # equal entries become one, with the number of its places
    many = np.diff(np.append(np.flatnonzero(new), len(new)))
    table, before, after = table[new], before[new], after[new]
    differs = np.ones(table.shape, bool)[:, : length + 1]
    differs[1:, :length] = table[1:, :length] != table[:-1, :length]
    shared = np.minimum(differs.argmax(1), after)
    shared[0] = 0
    shared[1:] = np.minimum(shared[1:], after[:-1])
    rest = table[:, :length][(column >= shared[:, None]) & (column < after[:, None])]
    prior = table[:, length : length + left_room][np.arange(left_room) >= left_room - before[:, None]]
    numbers = np.stack([shared, after, before, many]).astype("<u4").tobytes()
    return _squeeze(numbers), _squeeze(rest.tobytes() + prior.tobytes()), pack(anchor)


def read_run(a: bytes, b: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Suffixes, common prefixes with the one before, lengths before, counts; what goes before, laid end to end."""
    shared, after, before, many = np.frombuffer(_expand(a), "<u4").reshape(4, -1).astype(np.int64)
    body = _expand(b)
    suffixes, at, last = [], 0, b""
    for s, n in zip(shared.tolist(), after.tolist(), strict=True):
        last = last[:s] + body[at : at + n - s]
        at += n - s
        suffixes.append(last)
    return suffixes, shared, after, before, many, body[at:]


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which known bytes are known."""
    end = min(len(a), len(b))
    step = 16
    while known < end:
        x, y = a[known : known + step], b[known : known + step]
        if x != y:
            n = min(len(x), len(y))
            z = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return known + n - (z.bit_length() + 7) // 8
        known += step
        step = 256
    return end


def merge(streams: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs of (suffixes, common prefixes with the one before) with a loser tree.

    Yields (run, index, common prefix with the suffix yielded before).  Each head carries its common
    prefix with the last winner; that of a new head with the old one of its run, which has just won, is
    in the run already.  A longer known prefix wins; equal ones are compared from there on.
    """
    k = 1
    while k < len(streams):
        k *= 2
    index = [0] * len(streams)
    head: list[bytes | None] = [s[0][0] if s[0] else None for s in streams] + [None] * (k - len(streams))
    known = [0] * k
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes that with the winner."""
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None or known[a] > known[b]:
            return a, b
        if known[a] < known[b]:
            return b, a
        n = common(x, y, known[a])
        if x[n:] <= y[n:]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        won, lost = play(build(2 * node), build(2 * node + 1))
        loser[node] = lost
        return won

    won = build(1) if k > 1 else 0
    while head[won] is not None:
        yield won, index[won], known[won]
        suffixes, shared = streams[won]
        i = index[won] = index[won] + 1
        if i < len(suffixes):
            head[won], known[won] = suffixes[i], shared[i]
        else:
            head[won], known[won] = None, 0
        node = (won + k) // 2
        while node:
            rival = loser[node]
            y = head[rival]
            if y is not None and (head[won] is None or known[rival] > known[won]):
                loser[node], won = won, rival
            elif y is not None and known[rival] == known[won]:
                won, loser[node] = play(won, rival)
            node //= 2


def _judge(length: int):
    left_room = length - SEED

    def judge(rows: list[tuple[int, bytes, bytes, bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if not rows:
            return
        runs = [read_run(a, b) for _, a, b, _ in rows]
        won, index, shared = (np.array(x, np.int64) for x in zip(*merge([(r[0], r[1].tolist()) for r in runs]), strict=True))
        first = np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])])
        item = first[won] + index
        after, before, many = (np.concatenate([r[k] for r in runs])[item] for k in (2, 3, 4))
        # a suffix has SEED bytes at least, so a shorter common prefix starts a new family
        family = np.cumsum(shared < SEED)
        size = np.bincount(family, weights=many)[family]
        chosen = np.flatnonzero(size > 1)
        if not len(chosen):
            return
        body_at = [np.concatenate([[0], np.cumsum(r[3])]) for r in runs]
        place_at = [np.concatenate([[0], np.cumsum(r[4])]) for r in runs]
        bounds = np.flatnonzero(np.concatenate([[True], np.diff(family[chosen]) != 0, [True]]))
        found: dict[int, list[tuple[int, int, int]]] = {}
        low = 0
        while low < len(bounds) - 1:
            high = low + 1
            while high < len(bounds) - 1 and bounds[high + 1] - bounds[low] <= 4096:
                high += 1
            block = chosen[bounds[low] : bounds[high]]
            prior = np.zeros((len(block), left_room), np.uint8)
            for row, x in enumerate(block.tolist()):
                r, n = int(won[x]), int(before[x])
                if n:
                    prior[row, :n] = np.frombuffer(runs[r][5], np.uint8, n, int(body_at[r][index[x]]))[::-1]
            # what is between two of a family in the merged order is in it too, so their common prefix is the least on the way
            for row, a, b in repeated(shared[block], prior, before[block], after[block], many[block], length):
                x = int(block[row])
                found.setdefault(int(won[x]), []).append((int(index[x]), a, b))
            low = high
        for r, hits in found.items():
            places = unpack(rows[r][3])
            starts, ends = [], []
            for i, a, b in hits:
                at = places[place_at[r][i] : place_at[r][i + 1]]
                starts.append(at - a)
                ends.append(at - b + length)
            yield rows[r][0], np.concatenate(starts), np.concatenate(ends)

    return judge


def repeated(shared: np.ndarray, prior: np.ndarray, before: np.ndarray, after: np.ndarray, many: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(row, a, b): the strings that start a to b (a >= b) bytes before the row's anchor occur twice or more.

    shared: of each suffix, its common prefix with the one before in the merged order; prior: the bytes before the anchor,
    nearest first.  A string that starts d bytes before its anchor is that of another row if their suffixes have length - d
    bytes in common, which the merged common prefixes say, and the d bytes before them are equal, which a sort
    of these, with common prefixes in its turn, says.
    """
    n, room = prior.shape
    order = np.argsort(np.ascontiguousarray(prior).view(f"S{room}").ravel(), kind="stable")
    differs = np.ones((n, room + 1), bool)
    differs[1:, :room] = prior[order[1:]] != prior[order[:-1]]
    alike = differs.argmax(1)
    alike[0] = 0
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    hit = np.zeros((n, room + 2), bool)
    for d in range(int((length - after).min()), int(before.max()) + 1):
        mine = np.flatnonzero((before >= d) & (length - after <= d))
        if not len(mine):
            continue
        one, two = np.cumsum(shared < length - d), np.cumsum(alike < d) if d else np.zeros(n, np.int64)
        value = one[mine] * (n + 1) + two[place[mine]]
        by = np.argsort(value, kind="stable")
        same = value[by[1:]] == value[by[:-1]]
        twice = many[mine] > 1
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        hit[mine[twice], d] = True
    change = np.diff(hit[:, : room + 1].astype(np.int8), axis=1, prepend=0, append=0)
    rows, starts = np.nonzero(change == 1)
    _, ends = np.nonzero(change == -1)
    for row, low, high in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True):
        yield row, high - 1, low


def repeats(docs: DataFrame, text: str = "text", length: int = 200) -> tuple[DataFrame, str]:
    """docs with a column of spans (pairs of int64: the intervals of bytes of the text's UTF-8 form that repeated
    strings of length bytes cover; null for none), and its name.

    A string is repeated if it also starts anywhere else, same text included.  Strings never cross
    texts; null, empty and shorter texts have none.  Every row stays, once; equal rows count as different texts.
    """
    return spanned(docs, text, _emit(length), _judge(length), 2 * buckets_for(docs, text_or_empty(text)))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that remain)."""
    small_batches(docs.sparkSession)
    marked, spans = repeats(docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")), "t", length)
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            data, offsets = ts.column_bytes(batch.column(1))
            view = memoryview(data)
            for i, raw in enumerate(batch.column(2).to_pylist()):
                low, high = int(offsets[i]), int(offsets[i + 1])
                spans = read_spans(raw)
                kept, at = hashlib.sha256(), low
                for a, b in spans.tolist():
                    kept.update(view[at : low + a])
                    at = low + b
                kept.update(view[at:high])
                rows.append((high - low, int((spans[:, 1] - spans[:, 0]).sum()), len(spans), kept.hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.select("k", "t", spans).mapInArrow(ts.thrifty(run), f"`{key}` {key_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
