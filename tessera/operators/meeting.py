"""All pairs of rows without a row for each: a block of rows meets another block in one task.

Rows are dealt into blocks by a hash of their id. A task has two blocks, whose
sizes are bounded, and passes them as matrices, a tile of rows at a time; only
the pairs that it keeps leave it. The shuffle is rows times blocks, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK_BYTES = 32 << 20  # of the rows of a block
LEAST = 12              # blocks of a small table: 78 tasks
CELLS = 4_000_000       # pairs of a tile
OUT_ROWS = 100_000      # rows of a result batch, from which on it is sent


def meet(df: DataFrame, id_col: str, n_bytes: Column, block_bytes: int = BLOCK_BYTES, least: int = LEAST) -> DataFrame:
    """Every row once for each block that its own meets: plus (block, lo, hi), to be grouped by (lo, hi)."""
    total = df.agg(F.coalesce(F.sum(n_bytes.cast("long")), F.lit(0))).first()[0]
    n = max(least, -(-int(total) // block_bytes))
    dealt = df.withColumn("block", F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda o: F.struct(
        F.least(o, F.col("block")).alias("lo"), F.greatest(o, F.col("block")).alias("hi")))
    return dealt.select("*", F.inline(other))


def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """(rows of the one block, rows of the other, whether they are the same block)."""
    lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
    block = table["block"].to_numpy()
    return np.flatnonzero(block == lo), np.flatnonzero(block == hi), lo == hi


def id_order(ids: pa.ChunkedArray) -> np.ndarray:
    """Rank of every id in the order of Spark's ``<`` (equal ids have one rank)."""
    return pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of [s, s + c) for each pair."""
    at = np.cumsum(counts) - counts
    return np.arange(int(counts.sum()), dtype=np.int64) + np.repeat(starts - at, counts)


class Found:
    """Kept pairs, gathered into batches; a pair is turned so that its first id is the lower one."""

    def __init__(self, ids: pa.ChunkedArray, names: list[str]):
        self.ids, self.rank, self.names = ids.combine_chunks(), id_order(ids), names
        self.parts, self.n = [], 0

    def add(self, i: np.ndarray, j: np.ndarray, *values) -> None:
        """Rows i and j with ``values``, each (of the pair,) or (of the side i, of the side j)."""
        turned = self.rank[i] > self.rank[j]
        out = [np.where(turned, j, i), np.where(turned, i, j)]
        for v in values:
            out += [v[0]] if len(v) == 1 else [np.where(turned, v[1], v[0]), np.where(turned, v[0], v[1])]
        self.parts.append(out)
        self.n += len(i)

    def batch(self) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*self.parts)]
        self.parts, self.n = [], 0
        return pa.RecordBatch.from_arrays(
            [self.ids.take(pa.array(cols[0])), self.ids.take(pa.array(cols[1])), *map(pa.array, cols[2:])], names=self.names)


PAIR_BLOCK_BYTES = 4 << 20  # of the rows of a block that meets only where it has pairs


def meet_pairs(pairs: DataFrame, a: str, b: str, rows: DataFrame, id_col: str, n_bytes: Column,
               block_bytes: int = PAIR_BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Given pairs and the rows of their sides, both with the cell (lo, hi) in which they meet, to be cogrouped by it.

    A row goes to the cells of its own pairs alone. Rows with the same lowest partner (a family of copies has
    one) are dealt into one block, a family larger than a block into several: most pairs are within a block.
    """
    ends = pairs.select(F.col(a).alias("_id"), F.col(b).alias("_o")).unionByName(
        pairs.select(F.col(b).alias("_id"), F.col(a).alias("_o")))
    hubs = ends.groupBy("_id").agg(F.least("_id", F.min("_o")).alias("_hub"))
    sized = cut_lineage(hubs.join(rows.select(F.col(id_col).alias("_id"), n_bytes.cast("long").alias("_n")), "_id"))
    n = max(LEAST, -(-int(sized.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]) // block_bytes))
    parts = sized.groupBy("_hub").agg((F.floor(F.sum("_n") / block_bytes) + 1).alias("_parts"))
    part = F.pmod(F.xxhash64("_id"), F.col("_parts"))
    dealt = cut_lineage(sized.join(parts, "_hub").select(
        "_id", F.pmod(F.xxhash64("_hub", part), F.lit(n)).cast("int").alias("_b")))
    side = (lambda x: dealt.select(F.col("_id").alias(x), F.col("_b").alias(f"_b{x}")))
    cells = cut_lineage(pairs.join(side(a), a).join(side(b), b).withColumn("lo", F.least(f"_b{a}", f"_b{b}"))
                        .withColumn("hi", F.greatest(f"_b{a}", f"_b{b}")).drop(f"_b{a}", f"_b{b}"))
    need = cut_lineage(cells.select(F.col(a).alias(id_col), "lo", "hi").unionByName(
        cells.select(F.col(b).alias(id_col), "lo", "hi")).distinct())
    return cells, rows.join(need, id_col)


def of_pairs(a: str, b: str, made: Callable[[pa.Table, np.ndarray], pa.Table]):
    """For ``mapInArrow`` over rows of which those of a pair (a, b) follow each other in a partition: ``made`` of
    whole pairs and the number of each row's pair, counted from 0."""
    def numbered(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        for c in (a, b):
            v = t[c].combine_chunks()
            new[1:] |= pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False)
        return np.cumsum(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held, n = [*held, pa.Table.from_batches([batch])], n + batch.num_rows
            if n >= OUT_ROWS:
                t = pa.concat_tables(held).combine_chunks()
                pair = numbered(t)
                whole = int(np.searchsorted(pair, pair[-1]))  # the last pair may go on
                if whole:
                    yield from made(t.slice(0, whole), pair[:whole]).to_batches()
                held, n = [t.slice(whole)], 0
        if held:
            t = pa.concat_tables(held).combine_chunks()
            if len(t):
                yield from made(t, numbered(t)).to_batches()
    return run


def slices(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """[b, e) in a row whose counts add up to ``most`` at the most (or that are one)."""
    upto, b = np.cumsum(counts), 0
    while b < len(counts):
        e = max(b + 1, int(np.searchsorted(upto, (upto[b - 1] if b else 0) + most, "right")))
        yield b, e
        b = e
