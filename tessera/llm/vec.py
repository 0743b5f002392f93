"""Vectorised text primitives over Arrow string batches (numpy, inside tasks).

A batch is handled in chunks of a few hundred kilobytes of UTF-8, so memory
stays bounded whatever the batch; only a text longer than a chunk is a chunk
of its own. Hashes are 64-bit polynomials modulo 2^64 of random byte codes,
finished by a multiplicative mixer. They are functions of the content alone:
every task, run and machine gives the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 19

_rng = np.random.default_rng(20_240_501)
BYTE_CODE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4D)  # odd; two independent hash families
_MUL = U(0xD6E8FEB86659FD93)

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= _MUL
    x ^= x >> U(32)
    x *= _MUL
    x ^= x >> U(32)
    return x


class _Powers:
    """Powers of a base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up), CHUNK + 1)
            self.up, self.down = self._table(self.base, m), self._table(self.inv, m)
        return self.up, self.down

    @staticmethod
    def _table(r: int, n: int) -> np.ndarray:
        p = np.empty(n, U)
        p[0], k = 1, 1
        while k < n:
            m = min(k, n - k)
            np.multiply(p[:m], U(pow(r, k, 1 << 64)), out=p[k:k + m])
            k += m
        return p


POWERS = tuple(_Powers(b) for b in _BASES)


class Rolling:
    """Prefix sums of codes: the hash of any run [s, e) in constant time."""

    def __init__(self, codes: np.ndarray, family: int = 0):
        n = len(codes)
        self.up, self.down = POWERS[family].get(n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(codes * self.up[:n], out=self.sums[1:])

    def grams(self, q: int) -> np.ndarray:
        """Hashes of all runs of length q, by start (runs across texts included)."""
        s = self.sums
        return mix64((s[q:] - s[:-q]) * self.down[:len(s) - q])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])


def text_arrays(col: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of a string or binary column: (first row, bytes, offsets); nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off_buf, data = col.buffers()
    n = len(col)
    if n == 0:
        return
    offs = np.frombuffer(off_buf, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK, "right")) - 1)
        hi = min(hi, n)
        yield lo, raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte starts, byte ends, first word of each text, one more at the end)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~separators[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offs[(offs > 0) & (offs < len(buf))]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offs)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w values (blockwise prefix and suffix minima)."""
    n = len(h)
    if w <= 1:
        return h
    m = -(-n // w) * w
    a = np.full(m, np.iinfo(np.uint64).max, U)
    a[:n] = h
    a = a.reshape(-1, w)
    fore = np.minimum.accumulate(a, axis=1).ravel()
    back = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], fore[w - 1:n])


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Boolean mask of n units covered by [s, s + length) for the given starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:n]) > 0


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of [s, s + c) for each pair."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - at, counts)
