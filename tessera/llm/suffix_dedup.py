"""Operator 9, suffix-array dedup: longest-previous-factor arrays over bytes.

Each shard (see ``repeats``) builds one sparse suffix array over its segment
bodies by prefix doubling, refining tied suffixes only, to a depth of
``length`` bytes. In suffix order, the previous and the next entry with a
smaller position are the earlier suffixes that share the longest prefix with
an entry; the longer of both is its longest previous factor (LPF). The same
arrays over larger positions give the longest next factor. A window is a
later copy if its LPF reaches ``length``, and repeated if either does.

Defined results: null and empty texts have no bytes and nothing removed;
texts shorter than ``length`` keep all bytes; matches never cross texts; rows
repeated with id and text are repeated places; an empty table gives an empty
result. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Block, remove_windows, repeated_windows

LENGTH = 200
GRAM = 32


def suffix_order(buf: np.ndarray, depth: int, every: bool = True) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes of ``buf`` sorted by their first ``depth`` bytes (ties by
    position), and the ranks at each doubling level (or the last only) as
    (length, ranks)."""
    n = len(buf)
    pad = np.zeros(n + 8, np.uint64)
    pad[:n] = buf
    level = min(8, depth)
    key = np.zeros(n, np.uint64)
    for j in range(level):
        key = (key << np.uint64(8)) | pad[j:n + j]
    order = np.argsort(key, kind="stable")
    head = np.ones(n, bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    ranks = [(level, rank.copy() if every else rank)]
    while level < depth:
        step = min(level, depth - level)
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots = np.flatnonzero(tied)
        if len(slots):
            at = order[slots]
            beyond = np.full(len(at), -1, np.int64)
            inside = at + step < n
            beyond[inside] = rank[at[inside] + step]
            both = rank[at] * (n + 1) + beyond + 1
            perm = np.argsort(both, kind="stable")
            order[slots], both = at[perm], both[perm]
            new = np.ones(len(slots), bool)
            new[1:] = both[1:] != both[:-1]
            head[slots] = new
            rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
        level += step
        ranks.append((level, rank.copy() if every else rank))
    return order, ranks


def nearest(pos: np.ndarray, smaller: bool, before: bool) -> np.ndarray:
    """For each entry of a suffix order the nearest entry before (after) it with
    a smaller (larger) position, or -1. Pointer jumping over all entries at once."""
    p = pos if smaller else -pos
    if not before:
        back = nearest(p[::-1], True, True)[::-1]
        return np.where(back >= 0, len(pos) - 1 - back, -1)
    to = np.arange(-1, len(p) - 1)
    act = np.arange(len(p))
    while len(act):
        act = act[to[act] >= 0]
        act = act[p[to[act]] > p[act]]
        to[act] = to[to[act]]
    return to


def common_prefix(a: np.ndarray, b: np.ndarray, ranks: list[tuple[int, np.ndarray]], buf: np.ndarray,
                  depth: int) -> np.ndarray:
    """Length of the common prefix of suffix pairs, up to ``depth`` (b < 0: none)."""
    n = len(buf)
    out = np.zeros(len(a), np.int64)
    ok = b >= 0
    x, y = a.copy(), np.where(ok, b, 0)
    full = ok & (ranks[-1][1][x] == ranks[-1][1][y])
    out[full] = depth
    act = np.flatnonzero(ok & ~full)
    for level, rank in reversed(ranks[:-1]):
        u, v = x[act] + out[act], y[act] + out[act]
        fits = np.flatnonzero((u < n) & (v < n))
        same = fits[rank[u[fits]] == rank[v[fits]]]
        out[act[same]] += level
    for _ in range(7):
        u, v = x[act] + out[act], y[act] + out[act]
        fits = np.flatnonzero((u < n) & (v < n))
        same = fits[buf[u[fits]] == buf[v[fits]]]
        act = act[same]
        out[act] += 1
    return np.minimum(out, depth)


def factors(buf: np.ndarray, starts: np.ndarray, depth: int, lengths: bool = True):
    """(LPF, LNF, rank) of the suffixes at ``starts``, lengths up to ``depth``.

    With ``lengths=False`` a factor is only told apart as ``depth`` or shorter
    (then 0): neighbours with equal ranks share ``depth`` bytes.
    """
    order, ranks = suffix_order(buf, depth, every=lengths)
    rank = ranks[-1][1]
    chosen = np.zeros(len(buf), bool)
    chosen[starts] = True
    sa = order[chosen[order]]
    place = np.empty(len(buf), np.int64)
    place[sa] = np.arange(len(sa))
    result = []
    for smaller in (True, False):
        best = np.zeros(len(sa), np.int64)
        for before in (True, False):
            to = nearest(sa, smaller, before)
            if lengths:
                best = np.maximum(best, common_prefix(sa, np.where(to >= 0, sa[to], -1), ranks, buf, depth))
            else:
                best[(to >= 0) & (rank[sa[to]] == rank[sa])] = depth
        result.append(best[place[starts]])
    return result[0], result[1], rank[starts]


def lpf_classes(blk: Block, length: int) -> np.ndarray:
    """Resolver: windows whose factors are shorter than ``length`` stand alone."""
    lpf, lnf, rank = factors(blk.data, blk.starts, length, lengths=False)
    alone = np.arange(len(rank), dtype=np.int64)
    return np.where((lpf >= length) | (lnf >= length), len(rank) + rank, alone)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "first",
                 with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``).

    keep="first" removes later copies and keeps the earliest place (by id);
    keep="none" removes every place of a repeated string.
    """
    windows = repeated_windows(docs, "bytes", length, min(gram, length), lpf_classes, keep, id_col, text_col)
    return remove_windows(docs, windows, "bytes", length, with_text, id_col, text_col) \
        .withColumnRenamed("n_units", "n_bytes")
