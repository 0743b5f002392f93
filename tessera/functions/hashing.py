"""k-gram hashing and in-array winnowing (E1-E3) as Column expressions.

Winnowing runs inside each document's hash array with higher-order
functions, so fingerprint selection is a narrow projection: no explode, no
window, no shuffle before the index is built. The same expression serves
batch and streaming (row windows are not allowed on streams).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\x1f"  # joins tokens of a k-gram before md5


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once and pass it to ``fn`` as a lambda variable.

    Catalyst may substitute a projected column back into its consumers (e.g.
    when a filter is pushed below a projection); an array expression
    referenced inside a per-element lambda would then be recomputed for
    every element. Binding it through a one-element ``transform`` keeps it
    a single evaluation whatever the optimizer rewrites.
    """
    return F.element_at(F.transform(F.array(expr), fn), 1)


def safe_range(n: Column, start: int = 1) -> Column:
    """[start .. n] or an empty array when n < start (``sequence`` would count down)."""
    return F.when(n >= start, F.sequence(F.lit(start), n)).otherwise(F.array().cast("array<int>"))


def md5_long(s: Column) -> Column:
    """First 60 bits of md5 as a non-negative long (order equals the hex prefix order)."""
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("long")


def kgrams(tokens, k: int) -> Column:
    """Overlapping k-token slices; fewer than k tokens -> empty."""
    return let(_c(tokens), lambda t: F.transform(safe_range(F.size(t) - k + 1), lambda i: F.slice(t, i, k)))


def kgram_hashes(tokens, k: int, hash_fn: str = "xxhash64") -> Column:
    """One long per k-gram, in position order.

    ``xxhash64`` (default, fast): every token is hashed once, then each
    k-gram hashes its k token hashes (longs, not strings). ``md5``: 60-bit
    prefix of the md5 of the k-gram joined by \x1f -- reproducible outside
    Spark (DuckDB), used where another engine must agree on the winnowing.
    """
    if hash_fn == "xxhash64":
        return let(F.transform(_c(tokens), lambda t: F.xxhash64(t)),
                   lambda th: F.transform(safe_range(F.size(th) - k + 1), lambda i: F.xxhash64(F.slice(th, i, k))))
    if hash_fn == "md5":
        return let(_c(tokens), lambda t: F.transform(
            safe_range(F.size(t) - k + 1), lambda i: md5_long(F.array_join(F.slice(t, i, k), SEP))))
    raise ValueError(f"unknown hash function {hash_fn!r}")


def winnow(hashes, w: int) -> Column:
    """array<struct<pos int, hash long>> of selected fingerprints.

    For every full window of ``w`` consecutive hashes the minimum is taken,
    the rightmost one on ties; positions are de-duplicated. A sequence shorter
    than ``w`` is one window (its global minimum); an empty one gives [].
    ``pos`` is the 0-based k-gram index. ``w == 1`` keeps every k-gram.
    """
    if w == 1:
        return F.transform(_c(hashes), lambda x, i: F.struct(i.alias("pos"), x.alias("hash")))
    return let(_c(hashes), lambda h: _winnow(h, w))


def _winnow(h: Column, w: int) -> Column:
    """Window j (1-based start) covers h[j .. j+w-1]; its minimum and the
    rightmost position holding it are w-term ``least`` / ``when`` expressions
    over ``get`` (0-based, NULL past the end): no array is allocated per
    window. A sequence shorter than w has one window (NULLs are ignored)."""
    n = F.size(h)
    n_windows = F.when(n > 0, F.greatest(n - w + 1, F.lit(1))).otherwise(F.lit(0))

    def rightmost_min(j: Column) -> Column:
        vals = [F.get(h, j - 1 + t) for t in range(w)]

        def position_of(m: Column) -> Column:
            pos = None
            for t in range(w - 1, -1, -1):
                pos = F.when(vals[t] == m, j + t) if pos is None else pos.when(vals[t] == m, j + t)
            return pos

        return let(F.least(*vals), position_of)  # the minimum is evaluated once

    picks = F.array_distinct(F.transform(safe_range(n_windows), rightmost_min))
    return F.transform(picks, lambda p: F.struct((p - 1).alias("pos"), F.get(h, p - 1).alias("hash")))


# ---------------------------------------------------------------------------
# The md5 fingerprints of whole batches: the same values as winnow(kgram_hashes(.., "md5"), w)
# ---------------------------------------------------------------------------

CHUNK = 1 << 18  # k-grams of the documents that are hashed together
_LAST = np.iinfo(np.int64).max  # above any hash: pads a document with fewer k-grams than a window


def md5_fingerprints(k: int, w: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: batches whose last column is ``tokens`` get ``n_kgrams``, ``fp`` and ``n_fp`` in its place.

    An expression visits each k-gram through a dozen boxed calls. Here a chunk
    of documents is one byte string, a k-gram a slice of it, and all windows of
    the chunk are compared at once. Null tokens have no k-gram, as in ``kgram_hashes``.
    """
    def run(batches):
        for b in batches:
            n = _n_kgrams(b.column(b.num_columns - 1), k)
            chunk = np.cumsum(n) // CHUNK  # a chunk has whole documents
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    yield _with_fingerprints(b.slice(lo, hi - lo), n[lo:hi], k, w)
    return run


def _n_kgrams(tokens: pa.ListArray, k: int) -> np.ndarray:
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.maximum(lengths - k + 1, 0)


def _with_fingerprints(b: pa.RecordBatch, n: np.ndarray, k: int, w: int) -> pa.RecordBatch:
    tokens = b.column(b.num_columns - 1)
    pos, hashes, n_fp = winnowed(_md5_kgrams(tokens, n, k), n, w)
    offsets = pa.array(np.concatenate([[0], np.cumsum(n_fp)]).astype(np.int32))
    picked = pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), pa.array(hashes)], names=["pos", "hash"])
    new = [pa.array(n), pa.ListArray.from_arrays(offsets, picked), pa.array(n_fp)]
    names = [*b.schema.names[:-1], "n_kgrams", "fp", "n_fp"]
    return pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=names)


def _md5_kgrams(tokens: pa.ListArray, n: np.ndarray, k: int) -> np.ndarray:
    """The first 60 bits of md5 of each k-gram, its tokens joined by ``SEP``; documents one behind the other."""
    flat, lengths = tokens.flatten(), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    if flat.null_count:  # a null token is left out of its k-grams, but has a place
        words = flat.to_pylist()
        first = np.repeat(np.cumsum(lengths) - lengths, n) + _within(n)
        grams = [SEP.join(t for t in words[i:i + k] if t is not None).encode() for i in first.tolist()]
        raw = b"".join([hashlib.md5(g).digest() for g in grams])
    else:
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), SEP)
        text = joined[0].as_buffer().to_pybytes() if len(flat) else b""
        size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        end = np.cumsum(size) - 1  # of each token in the text
        first = np.repeat(np.cumsum(lengths) - lengths, n) + _within(n)
        starts = (end - size + 1)[first]
        raw = b"".join([hashlib.md5(text[i:j]).digest() for i, j in zip(starts.tolist(), end[first + k - 1].tolist())])
    return (np.frombuffer(raw, ">u8")[::2] >> 4).astype(np.int64)


def _within(n: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n, one behind the other."""
    return np.arange(int(n.sum()), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)


def winnowed(hashes: np.ndarray, n: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """E3 of documents with ``n`` hashes each: (positions, hashes, number of them a document), as ``winnow`` picks them.

    A window's rightmost minimum never moves back, so a position is picked by windows in a row.
    """
    if w == 1:
        return _within(n), hashes, n
    slots = np.where(n > 0, np.maximum(n, w), 0)
    base = np.cumsum(slots) - slots
    h = np.full(int(slots.sum()), _LAST)
    h[np.repeat(base, n) + _within(n)] = hashes
    windows = np.where(n > 0, slots - w + 1, 0)
    owner = np.repeat(np.arange(len(n)), windows)
    at = base[owner] + _within(windows)
    least, pick = h[at], at.copy()
    for t in range(1, w):
        other = h[at + t]
        lower = other <= least
        lower &= other != _LAST
        least, pick = np.where(lower, other, least), np.where(lower, at + t, pick)
    new = np.ones(len(pick), bool)
    new[1:] = pick[1:] != pick[:-1]  # no slot belongs to two documents
    pick, owner = pick[new], owner[new]
    return pick - base[owner], h[pick], np.bincount(owner, minlength=len(n)).astype(np.int64)
