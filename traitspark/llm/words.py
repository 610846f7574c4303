"""Words of whole texts as arrays: positions and 64-bit hashes for a piece of an Arrow batch.

Words are runs of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses these
bytes inside a character, so the work is done on bytes, without Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a piece of its own.
PIECE_BYTES = 3 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x + _MULT
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64))
#: The first bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed byte by byte.
LONG = 64


def powers(n: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """``base**i`` modulo 2**64 for i below n."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of some texts: byte ``start`` and ``end``, ``row`` of each, and ``first`` word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """``data``: the bytes of all texts; ``offsets``: where each begins, and the end."""
        self.data, self.offsets = data, offsets
        rows = len(offsets) - 1
        word = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | edge[1:-1]
        stops = word.copy()
        stops[:-1] &= ~word[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(rows), self.count)
        self._in_word = word
        self._hashes: dict[tuple[bool, int], np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word's bytes, computed once."""
        if not len(self):
            return np.zeros(0, np.uint64)
        if (lower, seed) in self._hashes:
            return self._hashes[lower, seed]
        size = self.end - self.start
        data = self.data[self._in_word]
        if lower:
            data = LOWER[data]
        first = np.cumsum(size) - size
        place = np.arange(len(data)) - np.repeat(first, size)
        power = powers(int(size.max()), 0xD1342543DE82EF95 + 2 * seed)
        out = mix(np.add.reduceat(_BYTE[data] * power[place], first) + size.astype(np.uint64))
        out.flags.writeable = False
        self._hashes[lower, seed] = out
        return out

    def codes(self, lower: bool = False) -> np.ndarray:
        """Another 64-bit hash of each word's bytes, eight at a time, computed once; much faster for common words."""
        if (lower, -1) in self._hashes:
            return self._hashes[lower, -1]
        data = np.concatenate([LOWER[self.data] if lower else self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        size = self.end - self.start
        out = mix((eight[self.start] & _FIRST[np.minimum(size, 8)]) ^ mix(size.astype(np.uint64)))
        more = np.flatnonzero((size > 8) & (size <= LONG))
        for at in range(8, LONG, 8):
            out[more] = mix(out[more] + (eight[self.start[more] + at] & _FIRST[np.minimum(size[more] - at, 8)]))
            more = more[size[more] > at + 8]
            if not len(more):
                break
        if (size > LONG).any():
            out[size > LONG] = self.hashes(lower)[size > LONG]
        out.flags.writeable = False
        self._hashes[lower, -1] = out
        return out

    def runs(self, hashes: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every ``k`` consecutive words of one text, and the index of the first word."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        factor = mix(np.arange(1, k + 1, dtype=np.uint64) + np.uint64(1000 * seed)) | np.uint64(1)
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += hashes[j : j + n] * factor[j]
        return mix(total[at]), at


def text_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def pieces(texts: pa.Array, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """``(low, high, words)`` for runs of rows of about ``piece_bytes``; every row is in one run."""
    if not len(texts):
        return
    data, offsets = text_arrays(texts)
    low = 0
    while low < len(texts):
        high = int(np.searchsorted(offsets, offsets[low] + piece_bytes, side="right")) - 1
        high = min(max(high, low + 1), len(texts))
        part = offsets[low : high + 1]
        yield low, high, Words(data[part[0] : part[-1]], part - part[0])
        low = high


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as a Spark long."""
    return x.view(np.int64)


def unsigned(x) -> np.ndarray:
    return np.asarray(x, np.int64).view(np.uint64)
