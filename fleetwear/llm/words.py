"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. Words are known by a 64-bit hash of their bytes: a polynomial
modulo 2^64 that is then mixed. Two different words of a corpus share one with a chance of about 2^-64 a pair. No
Python object is made for a word, so the work for a text is a handful of passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2^64 for i below ``size``; kept, and grown for longer texts."""
    have = _powers.get(base)
    if have is None or len(have[0]) < size:
        size = max(1 << 16, 1 << (size - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        pair = []
        for factor in (base, inverse):
            out = np.full(size, factor, dtype=np.uint64)
            out[0] = 1
            pair.append(np.multiply.accumulate(out))
        have = _powers[base] = (pair[0], pair[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """Words of a run of texts: byte spans, hashes, and where each text's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the ``n + 1`` offsets of its texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    lo, hi = int(offs[0]), int(offs[-1])
    raw = np.frombuffer(data, np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
    return raw, offs - lo


def runs(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts texts into runs ``[a, b)`` of at most ``limit`` bytes, or one longer text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """``offsets`` delimit texts in ``data``; words never cross from one text into the next."""
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    space = _SPACE[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    before[inner] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    word = ~space
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    forth, back = powers(_BASE, n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forth[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return Words(data, starts, ends, np.searchsorted(starts, offsets), hashes)


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each ``size`` values in a row; empty where there are fewer. Runs may cross texts: see ``gram_mask``."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 4:
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = (out + hashes[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        return mix(out)
    forth, back = powers(0xA0761D6478BD642F, len(hashes) + 1)
    total = np.empty(len(hashes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(hashes * forth[: len(hashes)], out=total[1:])
    return mix((total[size:] - total[:n]) * back[:n])


def gram_docs(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start places of all windows of ``size`` words inside one text, and the text each belongs to."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    docs = np.repeat(np.arange(len(counts)), counts)
    places = np.arange(len(docs)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[:-1], counts)
    return places, docs
