"""Coverage of all similar pairs without a row for each pair and fingerprint.

Fingerprints that exactly the same documents hold (a passage of 100 words has
96) go together: a *bundle* has one row a document, with their number and the
positions that they cover there. Documents, with their bundles in the order
(document frequency, bundle), are dealt into bounded blocks, and two blocks
meet in one task (see ``meeting``): pairs that a rare prefix allows are looked
for in postings, and what they cover is counted on all their bundles. Only the
counts of a pair leave the task; the shuffle is documents times blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .meeting import CELLS, OUT_ROWS, Found, meet, ranges, sides, slices

BLOCK_BYTES = 16 << 20  # of the bundles of a block
COUNTS = ["shared", "covered_a", "covered_b", "total_a", "total_b", "size_a", "size_b"]


def bundled_fingerprints(reps: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """(hash, doc_id, *scope, df, n_hash, n_pos, n_fp, class_size): the fingerprints that two documents or
    more of a scope hold, those with the same holders as one (``hash`` stands for the holders)."""
    held = Window.partitionBy("hash", *scope)
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "doc_id", *scope)).over(held).alias(f"_x{seed}") for seed in (1, 2)]
    often = reps.dropna(subset=["doc_id", *scope]).select(
        "doc_id", *scope, "n_pos", "n_fp", "class_size", F.count(F.lit(1)).over(held).alias("df"), *marks).filter("df > 1")
    bundle = F.xxhash64("df", "_x1", "_x2").alias("hash")
    # the bundles of a document come from all hash partitions: nothing is gained by adding them up before the shuffle
    rows = often.select("doc_id", *scope, bundle, "df", "n_pos", "n_fp", "class_size").repartition("doc_id", *scope)
    return rows.groupBy("hash", "doc_id", *scope).agg(
        F.max("df").alias("df"), F.count(F.lit(1)).alias("n_hash"), F.sum("n_pos").alias("n_pos"),
        F.max("n_fp").alias("n_fp"), F.max("class_size").alias("class_size"))


def covered_pairs(bundles: DataFrame, threshold: float, scope: tuple[str, ...] = (), both: bool = False,
                  block_bytes: int = BLOCK_BYTES, most: int = CELLS) -> DataFrame:
    """(*scope, doc_a, doc_b, shared, covered_a, covered_b, total_a, total_b, size_a, size_b) of all pairs that can have
    a side covered to ``threshold`` (with ``both``: COMBINED >= threshold), counted on all fingerprints that they share.

    Any such pair meets in a rare prefix (see ``fingerprint.shared_fingerprints``; a bundle's fingerprints have one
    frequency). With ``both``, what the two sides have left from their first common bundle on must suffice, too.
    """
    docs = cut_lineage(bundles.groupBy("doc_id", *scope).agg(
        F.max("n_fp").alias("n_fp"), F.max("class_size").alias("class_size"),
        F.array_sort(F.collect_list(F.struct("df", "hash", "n_pos", "n_hash"))).alias("_b"))
        .select("doc_id", *scope, "n_fp", "class_size", F.col("_b.hash").alias("bundles"), F.col("_b.n_pos").alias("n_pos"),
                F.col("_b.n_hash").alias("n_hash")))
    kind = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", *scope)}
    schema = ", ".join([f"doc_a {kind['doc_id']}, doc_b {kind['doc_id']}", *[f"{c} long" for c in COUNTS],
                        *[f"`{c}` {kind[c]}" for c in scope]])
    met = meet(docs, "doc_id", F.size("bundles") * 24 + 64, block_bytes)
    out = met.groupBy("lo", "hi").applyInArrow(_count_covered(threshold, both, tuple(scope), most), schema)
    return out.select(*scope, "doc_a", "doc_b", *COUNTS)


class _Block:
    """The bundles of the documents of two blocks, as flat arrays: those that both sides hold."""

    def __init__(self, table: pa.Table, left: np.ndarray, right: np.ndarray, same: bool, threshold: float):
        self.total = table["n_fp"].to_numpy().astype(np.int64)
        flat = (lambda c: table[c].combine_chunks().flatten().to_numpy())
        n = pc.list_value_length(table["bundles"]).to_numpy().astype(np.int64)
        doc, mass = np.repeat(np.arange(len(n)), n), flat("n_pos").astype(np.int64)
        upto = np.cumsum(mass)
        end = np.concatenate([[0], upto])[np.cumsum(n)]  # of each document
        rest = end[doc] - upto + mass  # from this bundle on
        total = self.total[doc].astype(float)
        prefix = total - rest <= (1 - threshold) * total + 1e-9
        _, code = np.unique(flat("bundles"), return_inverse=True)
        self.on_right = np.zeros(len(n), bool)
        self.on_right[right] = True
        side = self.on_right[doc]
        m = int(code.max(initial=-1)) + 1
        here, there = np.bincount(code[side], minlength=m), np.bincount(code[~side], minlength=m)
        use = here > 1 if same else (here > 0) & (there > 0)
        self.n_codes = int(use.sum())
        keep = use[code]
        code = (np.cumsum(use) - 1)[code[keep]]
        self.code, self.doc, self.mass, self.rest, self.prefix = code, doc[keep], mass[keep], rest[keep], prefix[keep]
        self.n_hash = flat("n_hash").astype(np.int64)[keep]
        self.n = np.bincount(self.doc, minlength=len(n))
        self.first = np.cumsum(self.n) - self.n

    def postings(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entries by code, start and number of each code's): of ``some`` entries."""
        at = np.flatnonzero(some)
        at = at[np.argsort(self.code[at], kind="stable")]
        held = np.bincount(self.code[at], minlength=self.n_codes)
        return at, np.cumsum(held) - held, held


def _count_covered(threshold: float, both: bool, scope: tuple[str, ...], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        left, right, same = sides(table)
        if not len(left) or not len(right):
            return
        x = _Block(table, left, right, same, threshold)
        if not x.n_codes:
            return
        found = Found(table["doc_id"], ["doc_a", "doc_b", *COUNTS, "_row"])
        copies = table["class_size"].to_numpy().astype(np.int64)
        own = [table[c].combine_chunks() for c in scope]

        def batch() -> pa.RecordBatch:
            b = found.batch()
            row = b.column(b.num_columns - 1)
            return pa.RecordBatch.from_arrays([*b.columns[:-1], *[c.take(row) for c in own]],
                                              names=[*b.schema.names[:-1], *scope])

        place = np.full(len(x.total), -1)
        place[right] = np.arange(len(right))
        on_right = x.on_right[x.doc]
        every, rare = x.postings(on_right), x.postings(on_right & x.prefix)
        step = max(1, most // max(len(right), x.n_codes))
        seen = np.zeros(step * len(right), bool)            # of a tile: the pairs found
        entry = np.zeros(step * x.n_codes, np.int32)        # of a tile: where a row has a code, plus 1
        for lo in range(0, len(left), step):
            rows = left[lo:lo + step]
            mine = ranges(x.first[rows], x.n[rows])
            row = np.repeat(np.arange(len(rows)), x.n[rows])
            pairs = [np.empty(0, np.int64)]
            for some, (at, start, held) in ((x.prefix[mine], every), (~x.prefix[mine], rare)):
                e, r = mine[some], row[some]
                h = held[x.code[e]]
                e, r, h = e[h > 0], r[h > 0], h[h > 0]
                for b, t in slices(h, most):
                    other = at[ranges(start[x.code[e[b:t]]], h[b:t])]
                    e_, r_ = np.repeat(e[b:t], h[b:t]), np.repeat(r[b:t], h[b:t])
                    i, j = x.doc[e_], x.doc[other]
                    ok = j > i if same else found.rank[i] != found.rank[j]
                    if both:
                        ok &= x.rest[e_] + x.rest[other] >= threshold * (x.total[i] + x.total[j]) - 1e-6
                    key = r_[ok] * len(right) + place[j[ok]]
                    key = np.unique(key[~seen[key]])
                    seen[key] = True
                    pairs.append(key)
            pairs = np.concatenate(pairs)
            seen[pairs] = False
            cells = row * x.n_codes + x.code[mine]
            entry[cells] = mine + 1
            r, j = pairs // len(right), right[pairs % len(right)]
            if same:
                ok = found.rank[rows[r]] != found.rank[j]
                r, j = r[ok], j[ok]
            for b, t in slices(x.n[j], most):
                n = x.n[j[b:t]]
                e = ranges(x.first[j[b:t]], n)
                p = np.repeat(np.arange(t - b), n)
                m = entry[np.repeat(r[b:t], n) * x.n_codes + x.code[e]]
                hit = np.flatnonzero(m)
                p, e, m = p[hit], e[hit], m[hit] - 1
                count = (lambda v: np.bincount(p, v, minlength=t - b).astype(np.int64))
                i, k = rows[r[b:t]], j[b:t]
                found.add(i, k, (count(x.n_hash[e]),), (count(x.mass[m]), count(x.mass[e])), (x.total[i], x.total[k]),
                          (copies[i], copies[k]), (i,))
                if found.n >= OUT_ROWS:
                    yield batch()
            entry[cells] = 0
        if found.n:
            yield batch()
    return run
