"""Pre-tokens of byte-pair tokenizers found by array passes over UTF-8 bytes, and a bounded store of their ids.

Both public vocabularies split a text by a pattern over letters, numbers, white space and the rest, with English
contractions first. ``spans`` finds the same pieces from character classes. ``PieceStore`` maps each piece, by a 64-bit
hash of its bytes, to its ids, and asks an encoder only for pieces it does not hold.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from tokenizers import Regex, pre_tokenizers

from fleetwear.llm.words import _BASE, mix, powers

LETTER, NUMBER, WHITE, OTHER = 0, 1, 2, 3

# The contractions of both split patterns.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_BLOCK = 256
_table = np.full(0x110000, OTHER, np.uint8)
_known = np.zeros(len(_table) // _BLOCK, bool)


def char_classes(codes: np.ndarray) -> np.ndarray:
    """The class of each code point, by the Unicode tables of the tokenizers library, asked once for a block of 256."""
    for block in np.unique(codes // _BLOCK).tolist():
        if not _known[block]:
            chars = [c for c in range(block * _BLOCK, (block + 1) * _BLOCK) if not 0xD800 <= c < 0xE000]
            for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
                split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
                for _, (a, b) in split.pre_tokenize_str("".join(map(chr, chars))):
                    _table[chars[a:b]] = kind
            _known[block] = True
    return _table[codes]


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to; ``data`` is well-formed UTF-8."""
    out = char_classes(np.arange(_BLOCK))[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b0 = data[lead].astype(np.int32)
        for size, low, keep in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
            at = lead[(b0 >= low) & (b0 < low + (0x20 if size == 2 else 0x10))]
            if not len(at):
                continue
            code = data[at].astype(np.int32) & keep
            for k in range(1, size):
                code = (code << 6) | (data[at + k].astype(np.int32) & 0x3F)
            kind = char_classes(code)
            for k in range(size):
                out[at + k] = kind
    return out


def spans(data: np.ndarray, offsets: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every piece, and for each text the place of its first piece.

    ``spaces``: a piece takes the blank before it, and other white space makes pieces of its own (the byte-level
    pattern). Otherwise white space is dropped and each number character is a piece (the word-end pattern).
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    kind = byte_classes(data)
    head = (data & 0xC0) != 0x80
    begins = np.zeros(n + 1, bool)
    begins[offsets[offsets <= n]] = True
    begins[n] = True
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    start[1:n] = kind[1:] != kind[:-1]
    start |= begins
    run_first = np.flatnonzero(start[:n])
    quote = run_first[(data[run_first] == 39)]
    if spaces:
        following = np.append(run_first[1:], n)
        inner = (kind[run_first] == WHITE) & ~begins[following]
        nxt = following[inner]
        last = nxt - 1
        for _ in range(3):
            last = np.where(head[last], last, last - 1)
        start[last] = True
        blank = data[last] == 32
        start[nxt[blank]] = False
    else:
        start[:n] |= (kind == NUMBER) & head
    quote = quote[start[quote] & (quote + 1 < n)]
    quote = quote[~begins[quote + 1]]
    if len(quote):
        padded = np.append(data, np.zeros(4, np.uint8))
        ends_at = np.searchsorted(offsets, quote, side="right")
        room = offsets[ends_at] - quote - 1
        done = np.zeros(len(quote), bool)
        for tail in CONTRACTIONS:
            raw = tail.encode()
            hit = ~done & (room >= len(raw))
            for k, c in enumerate(raw):
                hit &= padded[quote + 1 + k] == c
            at = quote[hit]
            start[at + 1] = False
            start[at + 1 + len(raw)] = True
            done |= hit
    cut = np.flatnonzero(start)
    first, last = cut[:-1], cut[1:]
    if not spaces:
        keep = kind[first] != WHITE
        first, last = first[keep], last[keep]
    return first, last, np.searchsorted(first, offsets)


class PieceStore:
    """Ids of pieces, in a table of fixed size addressed by the hash's low bits; a newer piece takes an older one's slot.

    ``encode`` maps a list of byte strings to lists of ids. At most ``2**bits`` pieces and ``pool`` ids are held; beyond that
    the store starts afresh, which costs time and changes no result.
    """

    def __init__(self, encode: Callable[[list[bytes]], list], bits: int = 21, pool: int = 16_000_000):
        self.encode, self.mask, self.limit = encode, np.uint64((1 << bits) - 1), pool
        self.clear()

    def clear(self) -> None:
        size = int(self.mask) + 1
        self.keys = np.zeros(size, np.uint64)
        self.place = np.zeros(size, np.int32)
        self.length = np.zeros(size, np.int32)
        self.pool = np.zeros(1 << 16, np.uint16)
        self.used = 0

    def _take(self, ids: np.ndarray) -> int:
        at, end = self.used, self.used + len(ids)
        if end > len(self.pool):
            grown = np.zeros(max(end, 2 * len(self.pool)), np.uint16)
            grown[:at] = self.pool[:at]
            self.pool = grown
        self.pool[at:end] = ids
        self.used = end
        return at

    def ids(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and the count for each piece."""
        if not len(first):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        if self.used > self.limit:
            self.clear()
        forth, back = powers(_BASE, len(data) + 1)
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forth[: len(data)], out=total[1:])
        key = mix((total[last] - total[first]) * back[first] + (last - first).astype(np.uint64)) | np.uint64(1)
        slot = (key & self.mask) ^ (key >> np.uint64(44))
        slot = (slot & self.mask).astype(np.int64)
        place, count = self.place[slot], self.length[slot]
        miss = np.flatnonzero(self.keys[slot] != key)
        if len(miss):
            fresh, where, back_to = np.unique(key[miss], return_index=True, return_inverse=True)
            at = miss[where]
            raw = data.tobytes()
            found = self.encode([raw[a:b] for a, b in zip(first[at].tolist(), last[at].tolist(), strict=True)])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.concatenate([np.asarray(x, np.uint16) for x in found]) if len(found) < 64 else np.fromiter(
                (i for x in found for i in x), np.uint16, int(sizes.sum())
            )
            places = self._take(flat) + np.cumsum(sizes) - sizes
            place[miss], count[miss] = places[back_to], sizes[back_to]
            self.keys[slot[at]], self.place[slot[at]], self.length[slot[at]] = fresh, places, sizes
        count = count.astype(np.int64)
        ends = np.cumsum(count)
        pick = np.arange(ends[-1]) + np.repeat(place - (ends - count), count)
        return self.pool[pick], count
