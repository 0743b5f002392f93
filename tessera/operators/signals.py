"""Multi-signal pair scoring (K1, K2).

Each channel is a bag (doc_id, item, cnt). A pair's channel similarity is
the weighted Jaccard sum(min) / (total_a + total_b - sum(min)). The bags of
the documents of pairs meet in bounded blocks (``meeting.meet_pairs``): no row
is made for a pair and an item, and no work depends on an item's frequency.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .meeting import CELLS, PAIR_BLOCK_BYTES, meet_pairs, ranges, slices


def bag(df: DataFrame, items: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, item, cnt) from an array column expression."""
    e = df.select(F.col(id_col).alias("doc_id"), F.explode_outer(items).alias("item")).filter(F.col("item").isNotNull())
    return e.groupBy("doc_id", "item").agg(F.count(F.lit(1)).alias("cnt"))


def bag_similarity(pairs: DataFrame, b: DataFrame, name: str, a_col: str = "doc_a", b_col: str = "doc_b",
                   block_bytes: int = PAIR_BLOCK_BYTES, most: int = CELLS) -> DataFrame:
    """Adds ``name`` = weighted Jaccard of the two bags for every pair (0 when disjoint)."""
    keys = cut_lineage(pairs.select(a_col, b_col).distinct())
    some = keys.select(F.col(a_col).alias("doc_id")).unionByName(keys.select(F.col(b_col).alias("doc_id"))).distinct()
    bags = cut_lineage(b.join(some, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.collect_list(F.struct(F.xxhash64("item").alias("h"), F.col("cnt").cast("long").alias("n"))).alias("_b"))
        .select("doc_id", F.col("_b.h").alias("items"), F.col("_b.n").alias("counts")))
    cells, rows = meet_pairs(keys, a_col, b_col, bags, "doc_id", F.size("items") * 16 + 64, block_bytes)
    kind = {c: keys.schema[c].dataType.simpleString() for c in (a_col, b_col)}
    found = cells.groupBy("lo", "hi").cogroup(rows.groupBy("lo", "hi")).applyInArrow(
        _jaccard(a_col, b_col, most), f"`{a_col}` {kind[a_col]}, `{b_col}` {kind[b_col]}, _s double")
    return pairs.join(found, [a_col, b_col], "left").withColumn(name, F.coalesce("_s", F.lit(0.0))).drop("_s")


def _jaccard(a_col: str, b_col: str, most: int):
    def run(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        ids = rows["doc_id"].combine_chunks()
        at = [pc.fill_null(pc.index_in(pairs[c], value_set=ids), -1).to_numpy().astype(np.int64) for c in (a_col, b_col)]
        n = pc.list_value_length(rows["items"]).to_numpy().astype(np.int64)
        first = np.cumsum(n) - n
        items, code = np.unique(rows["items"].combine_chunks().flatten().to_numpy(), return_inverse=True)
        count = rows["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)
        total = np.bincount(np.repeat(np.arange(len(n)), n), count, minlength=len(n))
        shared = np.zeros(len(pairs))
        order = np.argsort(at[0], kind="stable")
        side = at[0][order]
        step = max(1, most // max(1, len(items)))
        held = np.zeros(step * len(items), np.int64)  # of a tile: how often a row holds an item
        heads = np.unique(side)
        for lo in range(0, len(heads), step):
            mine = heads[lo:lo + step]
            cells = np.repeat(np.arange(len(mine)), n[mine]) * len(items) + code[ranges(first[mine], n[mine])]
            np.add.at(held, cells, count[ranges(first[mine], n[mine])])
            p = order[np.searchsorted(side, mine[0]):np.searchsorted(side, mine[-1], "right")]
            row, other = np.searchsorted(mine, at[0][p]), at[1][p]
            for b, t in slices(n[other], most):
                e, m = ranges(first[other[b:t]], n[other[b:t]]), n[other[b:t]]
                least = np.minimum(held[np.repeat(row[b:t], m) * len(items) + code[e]], count[e])
                shared[p[b:t]] = np.bincount(np.repeat(np.arange(t - b), m), least, minlength=t - b)
            held[cells] = 0
        every = total[at[0]] + total[at[1]] - shared
        score = np.divide(shared, every, out=np.zeros(len(pairs)), where=every > 0)
        return pa.table({a_col: pairs[a_col], b_col: pairs[b_col], "_s": score})
    return run


def channel_correlations(pairs: DataFrame, channels: dict[str, DataFrame]) -> DataFrame:
    """K1: one similarity column per channel bag."""
    out = pairs
    for name, b in channels.items():
        out = cut_lineage(bag_similarity(out, b, name))
    return out


def rank_pairs(scored: DataFrame, score: str, n: int, items_a: DataFrame, items_b: DataFrame | None = None,
               a_col: str = "doc_a", b_col: str = "doc_b", id_col: str = "doc_id", items: str = "items") -> DataFrame:
    """K2: the ``n`` highest pairs with all (sorted) shared elements that raised the flag. Element sets are attached only to the
    ``n`` selected pairs."""
    top = scored.orderBy(F.desc(score), a_col, b_col).limit(n)
    ib = items_b if items_b is not None else items_a
    j = (top.join(items_a.select(F.col(id_col).alias(a_col), F.col(items).alias("_ia")), a_col)
         .join(ib.select(F.col(id_col).alias(b_col), F.col(items).alias("_ib")), b_col))
    shared = F.array_sort(F.array_intersect("_ia", "_ib"))
    return j.select(*top.columns, F.array_join(shared, " ").alias("shared_elements"))
