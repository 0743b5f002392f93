"""Greedy String Tiling from maximal runs.

The maximal common runs of every pair come from the Spark seed join (E10);
only the inherently sequential part -- pick the longest remaining run, mark
its tokens on both sides, trim and re-split the runs it overlaps, repeat --
runs per pair in Python over Arrow batches. A pair's runs are bounded by
the two documents, never by the corpus.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .meeting import of_pairs

ROUNDS = 12  # tiles of a pair that are picked for all pairs of a batch at once; a pair with more goes on by itself


class _Marked:
    """Disjoint marked intervals of one side, sorted."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> None:
        k = bisect.bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)

    def within(self, start: int, end: int) -> list[tuple[int, int]]:
        """Marked parts of [start, end), relative to start."""
        lo, hi = bisect.bisect_right(self.ends, start), bisect.bisect_left(self.starts, end)
        return [(max(s, start) - start, min(e, end) - start) for s, e in zip(self.starts[lo:hi], self.ends[lo:hi])]


def tiles_of(runs: list[tuple[int, int, int]], min_len: int) -> list[tuple[int, int, int]]:
    """Tiles (start_a, start_b, len) of one pair, longest first (then by place).

    Runs wait in a heap by length. A run is looked at when it is the longest:
    if a tile has marked a part of it since, its free parts go back into the
    heap with their own lengths; else it is a tile.
    """
    a, b = _Marked(), _Marked()
    heap = [(-ln, sa, sb) for sa, sb, ln in runs if ln >= min_len]
    heapq.heapify(heap)
    tiles = []
    while heap:
        ln, sa, sb = heapq.heappop(heap)
        ln = -ln
        taken = sorted(a.within(sa, sa + ln) + b.within(sb, sb + ln))
        if not taken:
            tiles.append((sa, sb, ln))
            a.add(sa, sa + ln)
            b.add(sb, sb + ln)
            continue
        at = 0
        for s, e in [*taken, (ln, ln)]:
            if s - at >= min_len:
                heapq.heappush(heap, (at - s, sa + at, sb + at))
            at = max(at, e)
    return tiles


def _overlapping(pair: np.ndarray, start: np.ndarray, ln: np.ndarray) -> np.ndarray:
    """The pairs of which two runs overlap on this side."""
    order = np.lexsort((start, pair))
    p, s, n = pair[order], start[order], ln[order]
    return np.unique(p[1:][(p[1:] == p[:-1]) & (s[1:] < (s + n)[:-1])])


def tiles_of_pairs(pair: np.ndarray, sa: np.ndarray, sb: np.ndarray, ln: np.ndarray, min_len: int) -> tuple[np.ndarray, ...]:
    """``tiles_of`` of many pairs: (pair, start_a, start_b, len), by pair. In each round the longest run of
    every pair is a tile, and the others keep their free parts; runs that do not overlap are tiles as they are."""
    live, done = tuple(x[ln >= min_len] for x in (pair, sa, sb, ln)), []
    for _ in range(ROUNDS):
        p, x, y, n = live
        clash = np.zeros(int(p.max(initial=-1)) + 1, bool)
        clash[_overlapping(p, x, n)] = True
        clash[_overlapping(p, y, n)] = True
        done.append(tuple(v[~clash[p]] for v in live))
        p, x, y, n = live = tuple(v[clash[p]] for v in live)
        if not len(p):
            break
        order = np.lexsort((y, x, -n, p))
        p, x, y, n = live = tuple(v[order] for v in live)
        head = np.ones(len(p), bool)
        head[1:] = p[1:] != p[:-1]
        tile = np.flatnonzero(head)[np.cumsum(head) - 1]
        done.append(tuple(v[head] for v in live))
        (p, x, y, n), t = (v[~head] for v in live), tile[~head]
        cuts = []
        for side, start in ((live[1], x), (live[2], y)):
            lo, hi = np.clip(side[t] - start, 0, n), np.clip(side[t] + live[3][t] - start, 0, n)
            cuts.append((np.where(lo < hi, lo, n), np.where(lo < hi, hi, n)))  # no cut is one at the end
        (a0, a1), (b0, b1) = cuts
        first = a0 <= b0
        parts = [(np.zeros_like(n), np.minimum(a0, b0)), (np.where(first, a1, b1), np.where(first, b0, a0)),
                 (np.maximum(a1, b1), n)]
        keep = [e - s >= min_len for s, e in parts]
        live = tuple(np.concatenate([f(s, e)[k] for (s, e), k in zip(parts, keep)]) for f in (
            lambda s, e: p, lambda s, e: x + s, lambda s, e: y + s, lambda s, e: e - s))
    else:
        order = np.argsort(live[0], kind="stable")
        p, x, y, n = (v[order] for v in live)
        cuts = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)]
        rows = [(int(p[lo]), *t) for lo, hi in zip(cuts, cuts[1:]) if lo < hi
                for t in tiles_of(list(zip(x[lo:hi].tolist(), y[lo:hi].tolist(), n[lo:hi].tolist())), min_len)]
        done.append(tuple(np.array(rows, np.int64).reshape(-1, 4).T))
    found = tuple(np.concatenate(v) for v in zip(*done))
    order = np.argsort(found[0], kind="stable")
    return tuple(v[order] for v in found)


def _tile_pair(runs: list[tuple[int, int, int]], min_len: int) -> tuple[int, int]:
    """(tiled tokens, number of tiles) for one pair; runs = (start_a, start_b, len)."""
    tiles = tiles_of(runs, min_len)
    return sum(ln for _, _, ln in tiles), len(tiles)


def greedy_tiles(runs: DataFrame, min_len: int, a: str = "doc_a", b: str = "doc_b", together: bool = False) -> DataFrame:
    """The tiles themselves, one row each: (a, b, start_a, start_b, len). With ``together`` the runs of a pair
    follow each other in a partition (as from ``textruns.maximal_text_runs``), and so do its tiles: nothing is shuffled."""
    places = ["start_a", "start_b", "len"]
    long_enough = runs.filter(F.col("len") >= min_len).select(a, b, *[F.col(c).cast("long").alias(c) for c in places])
    schema = f"{a} {runs.schema[a].dataType.simpleString()}, {b} {runs.schema[b].dataType.simpleString()}, " \
             "start_a long, start_b long, len long"
    if together:
        def of_batch(t: pa.Table, pair: np.ndarray) -> pa.Table:
            p, *tiles = tiles_of_pairs(pair, *(t[c].to_numpy().astype(np.int64) for c in places), min_len)
            at = pa.array(np.searchsorted(pair, p))  # a row of the pair
            return pa.table([t[a].take(at), t[b].take(at), *map(pa.array, tiles)], names=[a, b, *places])

        return long_enough.mapInArrow(of_pairs(a, b, of_batch), schema)
    per_pair = long_enough.select(a, b, F.struct(*places).alias("r")).groupBy(a, b).agg(F.collect_list("r").alias("runs"))

    def tile(batches):
        for pdf in batches:
            found = [tiles_of([(x["start_a"], x["start_b"], x["len"]) for x in rs], min_len) for rs in pdf["runs"]]
            rows = [(x, y, *t) for x, y, ts in zip(pdf[a], pdf[b], found) for t in ts]
            yield pd.DataFrame(rows, columns=[a, b, "start_a", "start_b", "len"])

    return per_pair.mapInPandas(tile, schema=schema)


def greedy_tiling(runs: DataFrame, min_len: int, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """One-to-one tiles (longest first) per pair: (a, b, tiled, n_tiles).

    The runs of each pair are gathered into one array (bounded by the pair's
    two documents -- the unit the sequential algorithm needs anyway), then
    Arrow batches of pairs are tiled by ``mapInPandas``: no per-group pandas
    overhead when there are millions of small pairs.
    """
    sel = runs.filter(F.col("len") >= min_len).select(
        a, b, F.struct(F.col("start_a").cast("long").alias("sa"), F.col("start_b").cast("long").alias("sb"),
                       F.col("len").cast("long").alias("ln")).alias("r"))
    per_pair = sel.groupBy(a, b).agg(F.collect_list("r").alias("runs"))

    def tile(batches):
        for pdf in batches:
            res = [_tile_pair([(x["sa"], x["sb"], x["ln"]) for x in rs], min_len) for rs in pdf["runs"]]
            yield pd.DataFrame({a: pdf[a], b: pdf[b], "tiled": [t for t, _ in res], "n_tiles": [n for _, n in res]})

    schema = f"{a} {runs.schema[a].dataType.simpleString()}, {b} {runs.schema[b].dataType.simpleString()}, " \
             "tiled long, n_tiles long"
    return per_pair.mapInPandas(tile, schema=schema)
