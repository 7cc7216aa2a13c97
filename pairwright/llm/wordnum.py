"""Words of many texts as numpy arrays (used inside Arrow tasks).

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D),
or of another given set of bytes.
Texts are cut into chunks of about a megabyte, so memory does not follow the
batch, and every step is vectorised over the chunk's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

NOT_SPACE = np.ones(256, dtype=bool)          # True: part of a word
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)             # ASCII letters and digits, and all other characters
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15 | 1          # odd, so it has an inverse modulo 2^64
_P_INV = pow(_P, -1, 1 << 64)
_Q = 0xD1342543DE82EF95
_Q_INV = pow(_Q, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        x[0] = 1
        have = _powers[base] = np.cumprod(x, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Texts ``lo..hi-1`` of a batch: their bytes, word bounds and first word of each text."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray      # len hi - lo + 1: index of the first word of each text

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of every word."""
        data = _LOWER[self.data] if lower else self.data
        n = len(data)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_P, n), out=total[1:])
        poly = (total[self.ends] - total[self.starts]) * powers(_P_INV, n + 1)[self.starts]
        return mix(poly ^ (self.ends - self.starts).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes (empty when there are fewer)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers(_Q, len(words)), out=total[1:])
    return mix((total[size:] - total[:-size]) * powers(_Q_INV, n))


def text_chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES,
                letters: np.ndarray = NOT_SPACE) -> Iterator[Words]:
    """Chunks of an Arrow string (or UTF-8 binary) column in order; a null text has no words.

    ``letters``: which bytes are part of a word."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + chunk_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield _words(lo, hi, data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], letters)
        lo = hi


def _words(lo: int, hi: int, data: np.ndarray, at: np.ndarray, letters: np.ndarray) -> Words:
    inside = letters[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    before[at] = False                     # a text's first byte has nothing before it
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    after[at] = False                      # nor its last byte anything after it
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(lo, hi, data, starts, ends, np.searchsorted(starts, at))
