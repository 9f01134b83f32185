"""Arrow batches as plain byte arrays, and hashes of byte spans, for the operators that run inside tasks.

All functions work on a bounded slice of a batch, so a task holds a few copies of that slice and never of
its partition. A single text longer than the bound is a slice of its own."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

U64 = np.uint64
# Odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
LENGTH_FACTOR = 0xD6E8FEB86659FD93
LONG_SPAN = 128
BYTE_VALUES = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True

_powers = [np.ones(1, U64), np.ones(1, U64)]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(low, high - low)
            low = high


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more entry than texts). Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def strings(column: pa.Array) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept between calls."""
    if len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for k, base in enumerate((BASE, BASE_INVERSE)):
            step = np.full(size, base, U64)
            step[0] = 1
            _powers[k] = np.cumprod(step)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class SpanHashes:
    """64-bit hashes of any byte spans of one array: equal spans have equal hashes wherever they lie.

    They are polynomials modulo 2**64, which collide on spans of 1,024 bytes and more of a certain build (Thue-Morse strings).
    ``digests`` does not: it takes spans that hardly overlap, such as words and lines."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self._data = data
        up, self._down = powers(n + 1)
        self._sums = np.zeros(n + 1, U64)
        np.cumsum(BYTE_VALUES[data] * up[:n], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sums[end] - self._sums[start]) * self._down[start]
        return mix(raw + (end - start).astype(U64) * U64(LENGTH_FACTOR))

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """As a call, but spans of ``LONG_SPAN`` bytes or more have 64 bits of their BLAKE2b digest. It reads each such span once."""
        out = self(start, end)
        far = np.flatnonzero(end - start >= LONG_SPAN)
        if len(far):
            each = (hashlib.blake2b(self._data[a:b], digest_size=8).digest() for a, b in zip(start[far].tolist(), end[far].tolist(), strict=True))
            out[far] = np.frombuffer(b"".join(each), "<u8")
        return out

    def windows(self, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes from each position on, where so many follow."""
        n = len(self._sums) - 1 - width + 1
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self._sums[width:] - self._sums[:n]) * self._down[:n] + U64(width * LENGTH_FACTOR % (1 << 64)))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of bytes other than 0x20 and 0x09-0x0D."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACES[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    cuts = off[:-1]
    before[cuts[cuts < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = off[1:] - 1
    after[last[(last >= 0)]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def per_text(number: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count, or sum of weights, for each of ``n`` texts."""
    out = np.bincount(number, weights, minlength=n)
    return out.astype(np.int64)
