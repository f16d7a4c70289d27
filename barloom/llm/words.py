"""Words, lines and their 64-bit hashes over the raw bytes of whole Arrow batches.

Separators are ASCII, so UTF-8 bytes can be split without decoding. The hash
of a span is a polynomial over random byte values, taken from one running sum
per chunk and then mixed; two different spans agree with probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text worked on at once; a longer single text is its own chunk
CHUNK_BYTES = 1 << 19
MULTIPLIER = 0x9E3779B97F4A7C15

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
CONTINUATION = np.zeros(256, bool)
CONTINUATION[0x80:0xC0] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, more than n of each."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = 1 << max(CHUNK_BYTES.bit_length(), n.bit_length())
        _POWERS.clear()
        for base in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS.append(np.cumprod(table, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string()) if texts.null_count else texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, len(texts))
        own = offsets[row : stop + 1]
        yield row, data[own[0] : own[-1]], own - own[0]
        row = stop


class Spans:
    """Words of a chunk: byte ranges, the row of each, and hashes of any ranges."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        self.data, self.offsets = LOWER[data] if lower else data, offsets
        self.rows = len(offsets) - 1
        inside = ~SEPARATOR[data]
        self.inside = inside
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = offsets[:-1] < offsets[1:]
        before[offsets[:-1][full]] = False
        after[offsets[1:][full] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first_word = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first_word)
        self.row_of_word = np.repeat(np.arange(self.rows), self.counts)
        self._sums: np.ndarray | None = None

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One mixed hash per byte range; empty ranges agree."""
        forward, back = powers(len(self.data))
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(BYTE_VALUES[self.data] * forward[: len(self.data)], out=self._sums[1:])
        return mixed((self._sums[ends] - self._sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row are flagged."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[self.offsets])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of n words within a row."""
        words = self.hashes(self.starts, self.ends)
        if len(words) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        run = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            run = mixed(run * np.uint64(MULTIPLIER) + words[k : len(words) - n + 1 + k])
        at = np.flatnonzero(self.row_of_word[: len(run)] == self.row_of_word[n - 1 :])
        return at, run[at]


def repeated(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Size of each entry's group of equal keys within its row."""
    both = mixed(keys + rows.astype(np.uint64) * np.uint64(MULTIPLIER))
    _, place, count = np.unique(both, return_inverse=True, return_counts=True)
    return count[place]
