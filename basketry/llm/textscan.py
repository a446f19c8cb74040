"""Vectorised scanning of UTF-8 text columns: words, rolling hashes, spans.

All functions work on the bytes of many texts laid end to end, with an offset array, as
Arrow stores them.  Where equal hashes decide, they are pairs of polynomials over a prime with bases drawn
for the run (``word_hashes``, ``sequence_hashes``), so that no text is built to make them collide; hashes that only choose places or features are
polynomials modulo 2**64 with an odd base.  Both are differences of one running sum, made position free by the base's inverse powers.
"""

from __future__ import annotations

import ctypes
import hashlib
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: The white space bytes 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z become a-z, other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: What parts words made of ASCII letters, digits and all bytes above ASCII.
NOT_ALNUM = np.ones(256, bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    NOT_ALNUM[_low:_high] = False

BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
#: Bytes of text hashed in one go.
SEGMENT = 1 << 18

try:
    _libc = ctypes.CDLL(None)
    # arrays from 4 MB on go back to the system when they are freed, however many have been made before; smaller ones are used again
    _libc.mallopt(-3, 4 << 20)
    _libc.mallopt(-1, 32 << 20)
except (OSError, AttributeError):
    _libc = None


def thrifty(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """run, after which a Python worker gives back the memory that it doesn't need: idle workers stay alive beside busy ones."""

    def inner(*args) -> Iterator:
        yield from run(*args)
        released()

    return inner


def released() -> None:
    pa.default_memory_pool().release_unused()
    if _libc is not None and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of base and of its inverse, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, SEGMENT + 1024)
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            p = np.full(n, np.uint64(b & (2**64 - 1)), np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = _powers[base] = (made[0], made[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its values; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, off, data = array.buffers()
    if len(array) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    first, last = offsets[0], offsets[-1]
    body = np.frombuffer(data, np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - first


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters, byte for byte."""
    out = LOWER[data]
    if len(out) > 1:
        capital = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][capital] += 32
    return out


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about limit bytes of the column's text; a longer text stands alone."""
    array = batch.column(batch.schema.get_field_index(column))
    _, offsets = column_bytes(array)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined or cut so that each holds about limit bytes of the column's text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for piece in slices(batch, column, limit):
            held.append(piece)
            size += int(column_bytes(piece.column(piece.schema.get_field_index(column)))[1][-1])
            if size >= limit:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-separator bytes, and the text each is in."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    gap = separator[data]
    start = ~gap
    end = start.copy()
    start[1:] &= gap[:-1]
    end[:-1] &= gap[1:]
    lengths = np.diff(offsets)
    first, last = offsets[:-1][lengths > 0], offsets[1:][lengths > 0] - 1
    start[first] = ~gap[first]
    end[last] = ~gap[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in each span, for features; spans are in order and don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + SEGMENT, "right")))
        high = int(ends[to - 1])
        up, down = powers(BYTE_BASE, high - low + 1)
        running = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=running[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (running[e] - running[s]) * down[s]
        at = to
    return mix(out)


def fresh_key() -> int:
    """A key for word_hashes and sequence_hashes, drawn on the driver and sent along with the tasks of one run."""
    return secrets.randbits(64)


#: The prime of word_hashes and sequence_hashes: products of two residues fit in 64 bits.
PRIME = (1 << 31) - 1
_prime_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _residue(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for values below 2**63."""
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(31))
    x = (x & p) + (x >> np.uint64(31))
    return np.where(x >= p, x - p, x)


def _bases(key: int, use: str) -> list[int]:
    """Two bases that the key chooses."""
    raw = hashlib.blake2b(f"{use}:{key}".encode(), digest_size=16).digest()
    return [512 + int.from_bytes(raw[i : i + 8], "little") % (PRIME - 1024) for i in (0, 8)]


def _powers_over_prime(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _prime_powers.get(base)
    if have is None or len(have[0]) < n:
        made = []
        for b in (base, pow(base, -1, PRIME)):
            p = np.ones(1, np.uint64)
            while len(p) < max(n, SEGMENT + 1):
                p = np.concatenate([p, _residue(p * np.uint64(pow(b, len(p), PRIME)))])
            made.append(p)
        if len(_prime_powers) > 16:
            _prime_powers.clear()
        have = _prime_powers[base] = (made[0], made[1])
    return have


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """A hash of 62 bits of the bytes in each span; spans are in order and don't overlap.

    Two different words of n bytes at most have one hash with a probability of (n / 2**31)**2 over the keys, whatever the words.
    """
    out = np.zeros(len(starts), np.uint64)
    bases = _bases(key, "word")
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + SEGMENT, "right")))
        high = int(ends[to - 1])
        s, e = starts[at:to] - low, ends[at:to] - low
        for which, base in enumerate(bases):
            up, down = _powers_over_prime(base, high - low + 1)
            running = np.zeros(high - low + 1, np.uint64)
            for a in range(low, high, SEGMENT):
                # bytes times residues stay below 2**40, so a segment's sum stays below 2**58
                b = min(high, a + SEGMENT)
                np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[a - low : b - low], out=running[a - low + 1 : b - low + 1])
                running[a - low + 1 : b - low + 1] += _residue(running[a - low : a - low + 1])
            both = _residue(running[e]) + np.uint64(PRIME) - _residue(running[s])
            out[at:to] |= _residue(_residue(both) * down[s]) << np.uint64(31 * which)
        at = to
    return mix(out)


def sequence_hashes(values: np.ndarray, width: int, key: int = 0) -> np.ndarray:
    """Rabin-Karp hash, of 62 bits, of every run of width consecutive values; entry i is the run from i on.

    The hash of a run of 2k values comes from the hashes of its halves.  Runs at the end that are cut short have no entry.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    values = mix(values ^ np.uint64(key & (2**64 - 1)))
    for which, base in enumerate(_bases(key, "sequence")):
        one = _residue((values >> np.uint64(33 * which)) & np.uint64(PRIME))
        hashes, k = one, 1
        for bit in bin(width)[3:]:
            hashes = _residue(hashes[: len(hashes) - k] * np.uint64(pow(base, k, PRIME)) + hashes[k:])
            k *= 2
            if bit == "1":
                hashes = _residue(hashes[:-1] * np.uint64(base) + one[k:])
                k += 1
        out |= hashes << np.uint64(31 * which)
    return mix(out)


def window_hashes(values: np.ndarray, width: int, base: int = WORD_BASE) -> np.ndarray:
    """A 64-bit hash of every run of width consecutive values, for places and features; entry i is the run from i on.

    Runs at the end that are cut short have no entry.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for low in range(0, n, SEGMENT):
        high = min(n, low + SEGMENT)
        m = high - low + width - 1
        up, down = powers(base, m + 1)
        running = np.zeros(m + 1, np.uint64)
        np.cumsum(values[low : low + m] * up[:m], out=running[1:])
        out[low:high] = (running[width : width + high - low] - running[: high - low]) * down[: high - low]
    return mix(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1 of all i, laid end to end."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    some = lengths > 0
    starts, lengths = starts[some], lengths[some]
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    padded = np.zeros(len(mask) + 2, np.int8)
    padded[1:-1] = mask
    change = np.diff(padded)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)
