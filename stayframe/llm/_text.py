"""Vectorised helpers on Arrow string columns, used inside tasks.

A batch is cut into slices of whole rows of at most ``SLICE_BYTES`` (a longer row
is a slice of its own), so that the numpy work arrays stay small however many
rows a batch holds. Nothing here drops or shortens a text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_C1 = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xBF58476D1CE4E5B9)
_C3 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` bytes, or of one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def codepoints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 rows and the offsets of the rows in them."""
    raw = data.tobytes()
    cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(cp) == len(raw):
        return cp, offsets
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return cp, starts[offsets]


class Rolling:
    """Hashes of substrings: sums of random values times powers of an odd base, modulo 2**64.
    ``table`` maps the data's values to random ones; without it the data are taken as they are."""

    base = np.uint64(0xD6E8FEB86659FD93)
    powers = inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray, table: np.ndarray | None = None):
        n = len(data) + 1
        if len(Rolling.powers) < n:
            ahead = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, np.uint64))])
            self.powers, self.inverse = ahead(Rolling.base), ahead(np.uint64(pow(int(Rolling.base), -1, 1 << 64)))
            if n <= SLICE_BYTES + 1:  # those of longer texts go with them
                Rolling.powers, Rolling.inverse = self.powers, self.inverse
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data if table is None else table[data]) * self.powers[:n - 1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def random_table(size: int, seed: int) -> np.ndarray:
    """Odd random 64-bit values."""
    return np.random.default_rng(seed).integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.lru_cache(maxsize=1)
def _codepoint_table() -> np.ndarray:
    return random_table(0x110000, 3)


def span_hash(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span [start, end) of code points."""
    return mix64(Rolling(cp, _codepoint_table())(starts, ends) + (ends - starts).astype(np.uint64))


#: ASCII letters and digits and every byte of a non-ASCII character.
WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LOWER_BYTE = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_LOWERED = random_table(256, 4)[LOWER_BYTE]


def byte_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of ``WORD_BYTE``, A-Z lower-cased) of the rows: byte starts and
    ends, 64-bit hashes, and the offsets of the rows in the list of words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = WORD_BYTE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = word[1:] & ~word[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    first &= word
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = ~word[1:]
    inner = offsets[1:][(offsets[1:] > 0)] - 1
    last[inner] = True
    last &= word
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = mix64(Rolling(data, _LOWERED)(starts, ends) + (ends - starts).astype(np.uint64))
    return starts, ends, hashes, np.searchsorted(starts, offsets)


class Memo:
    """A bounded memory of computed values by 64-bit key: two sorted arrays,
    emptied when ``limit`` is passed (values are then computed anew)."""

    def __init__(self, dtype=np.int64, limit: int = 1_500_000):
        self.limit, self.dtype = limit, dtype
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, dtype)

    def get(self, keys: np.ndarray, compute) -> np.ndarray:
        """Values of sorted distinct ``keys``; ``compute(indices)`` gives those not yet known."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        out = np.zeros(len(keys), self.dtype)
        out[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = compute(new)
            if len(self.keys) + len(new) > self.limit:
                self.keys, self.values = keys[new], out[new]
            else:
                self.values = np.insert(self.values, at[new], out[new])
                self.keys = np.insert(self.keys, at[new], keys[new])
        return out
