"""Vectorised work on UTF-8 text columns of Arrow record batches.

Python strings are never made on the hot paths: everything reads the bytes of the Arrow buffers, a bounded
slice of documents at a time.  A document longer than a slice is a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 2 << 20
#: Bytes of spans that are hashed in numpy.
LONG_SPAN = 1024

#: Bytes that separate words: the space and U+0009 to U+000D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers = (np.ones(1, U64), np.ones(1, U64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each bit depends on all."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers of x, ascending."""
    x = np.sort(x)
    return x[np.flatnonzero(np.diff(x, prepend=x[:1] ^ x.dtype.type(1)))] if len(x) else x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of polynomial hashes, and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        made = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, U64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if size > 4 * SLICE_BYTES:  # that of one long document isn't kept
            return made[0][:n], made[1][:n]
        _powers = (made[0], made[1])
    return _powers[0][:n], _powers[1][:n]


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off, buf


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes together, or a single longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


class Numbered:
    """Different 64-bit keys, numbered from 0 as they come, in a table with open addressing."""

    def __init__(self, room: int = 1 << 12):
        self.n = 0
        self._clear(2 * room)

    def _clear(self, size: int) -> None:
        self._number, self._key = np.full(size, -1, np.int32), np.zeros(size, U64)
        self._shift = U64(65 - size.bit_length())

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _BASE) >> self._shift).astype(np.int64)

    def _place(self, keys: np.ndarray, number: np.ndarray) -> None:
        slot = self._slot(keys)
        while len(number):
            free = np.flatnonzero(self._number[slot] < 0)
            self._number[slot[free]] = number[free]
            mine = free[self._number[slot[free]] == number[free]]  # of those that meet in a free slot, one has it
            self._key[slot[mine]] = keys[mine]
            left = np.ones(len(number), bool)
            left[mine] = False
            keys, number, slot = keys[left], number[left], (slot[left] + 1) & (len(self._key) - 1)

    def add(self, keys: np.ndarray) -> None:
        """Numbers keys that are all different and have no number yet."""
        first, self.n = self.n, self.n + len(keys)
        if 2 * self.n > len(self._key):
            used = np.flatnonzero(self._number >= 0)
            had, number = self._key[used], self._number[used]
            self._clear(2 << self.n.bit_length())
            self._place(had, number)
        self._place(keys, np.arange(first, self.n, dtype=np.int32))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        slot = self._slot(keys)
        found = self._number[slot]
        which = np.flatnonzero((self._key[slot] != keys) & (found >= 0))
        while len(which):
            slot[which] = at = (slot[which] + 1) & (len(self._key) - 1)
            found[which] = there = self._number[at]
            which = which[(self._key[at] != keys[which]) & (there >= 0)]
        return found


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of documents that lie in buf one after another, and how many each has.

    off holds where each document begins in buf, and at last buf's length.
    """
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off) - 1, np.int64)
    inside = ~IS_SPACE[buf]
    cut = off[:-1][off[:-1] < len(buf)]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of buf on as one number, the first byte the lowest; zeros follow buf."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def span_part(parts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """The k-th eight bytes of spans that are longer than 8 k bytes, as numbers; what lies beyond a span is zero."""
    left = np.minimum(sizes - 8 * k, 8).astype(U64)
    return parts[starts + 8 * k] & (~U64(0) >> (U64(64) - (left << U64(3))))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes: eight bytes at a time are mixed with what came before.

    Spans of up to eight bytes that are equally long never share one; longer than LONG_SPAN they are hashed by BLAKE2.
    """
    sizes = ends - starts
    out = mix64(sizes.astype(U64) + U64(seed))
    parts = eights(buf)
    long = np.flatnonzero(sizes > LONG_SPAN)
    which, k = np.flatnonzero((sizes > 0) & (sizes <= LONG_SPAN)), 0
    while len(which):
        out[which] = mix64(out[which] * _BASE + span_part(parts, starts[which], sizes[which], k))
        k += 1
        which = which[sizes[which] > 8 * k]
    view = memoryview(np.ascontiguousarray(buf))
    for i in long.tolist():
        digest = hashlib.blake2b(view[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def window_starts(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices at which a window of so many items fits within its document, and how many each document has.

    counts holds how many items each document has; their items lie one after another.
    """
    fits = np.maximum(counts - (width - 1), 0)
    first = np.cumsum(counts) - counts
    total = int(fits.sum())
    ahead = np.repeat(first - (np.cumsum(fits) - fits), fits)
    return ahead + np.arange(total), fits


def window_hashes(items: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of the windows of so many items that start at the given indices."""
    up, down = powers(len(items) + 1)
    sums = np.zeros(len(items) + 1, U64)
    np.cumsum(items * up[:-1], out=sums[1:])
    return mix64((sums[at + width] - sums[at]) * down[at] + U64(width))
