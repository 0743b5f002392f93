"""Operator 13, source divergence audit.

How far the term frequencies of each (language, source) group lie from those
of the language's other sources, and which terms stand out against the
language. Term counts of a group are a segment tree over the language's term
ids. The trees of a block of term ids are built together and hash-consed:
equal subtrees, of one group or of several, are one node. Two groups are
compared by walking both trees at once, level by level; a pair of nodes met
again (at any place) is the same pair, so it is priced once. A pair's price is
the sum of its children's, down to the price of two counts; its best term is
the greater of its children's, which lets the walk for the leading terms
leave out subtrees that cannot hold one.

Scale: texts are counted inside the scan, one row per (group, term) and chunk
leaves a task. Term ids follow (document frequency, term), counted by a
distributed running sum, so that blocks of rare terms have mostly equal
subtrees. A tree task holds one block of ``BLOCK`` terms for at most two tiles
of ``TILE`` sources, whatever the sizes of groups and vocabulary, and returns
sums per pair and block. All arithmetic is on integers.

Defined results: null text, language and source count as empty; a group whose
texts have no kept term has counts of 0 throughout; in a language without kept
terms every pair has value 0 and no group has terms; rows repeated with id and
text count twice; an empty table gives an empty result. Only the text, language
and source columns are read, so other columns (clashing names included) don't
matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vec
from .common import drop_written, running_sum, written

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
BLOCK = 4096  # term ids of one tree
TILE = 32     # sources of a task's side
_PAIRS = 128  # pairs of trees walked at once

# Terms: runs of ASCII letters and of all characters above ASCII.
SEPARATORS = np.ones(256, bool)
SEPARATORS[0x80:] = False
SEPARATORS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def _chunk_counts(group: np.ndarray, buf: np.ndarray, offs: np.ndarray):
    """(group, term, occurrences, documents) of a chunk's texts."""
    buf = vec.ASCII_LOWER[buf]
    starts, ends, first = vec.words(buf, offs, SEPARATORS)
    if not len(starts):
        return None
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    codes = vec.BYTE_CODE[buf]
    one, two = (vec.Rolling(codes, k).runs(starts, ends) for k in (0, 1))
    g = group[doc]
    order = np.lexsort((doc, two, one, g))
    g, one, two, doc = g[order], one[order], two[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    new_doc = new.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    n = np.diff(at, append=len(order))
    docs = np.add.reduceat(new_doc.astype(np.int64), at)
    s, e = starts[order[at]], ends[order[at]]
    cuts = np.concatenate([[0], np.cumsum(e - s)])
    term = pa.Array.from_buffers(pa.string(), len(at), [None, pa.array(cuts, pa.int32()).buffers()[1],
                                                        pa.py_buffer(buf[vec.ranges(s, e - s)].tobytes())])
    return g[at], term, n, docs


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
        group = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
        for lo, buf, offs in vec.text_arrays(batch.column(2)):
            made = _chunk_counts(group[lo:lo + len(offs) - 1], buf, offs)
            if made is None:
                continue
            g, term, n, docs = made
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(g // len(source.dictionary))),
                 source.dictionary.take(pa.array(g % len(source.dictionary))), term, pa.array(n), pa.array(docs)],
                names=["lang", "source", "term", "n", "docs"])


class Forest:
    """Hash-consed segment trees of equal height over the rows of ``counts``.

    ``counts`` is (trees, terms); terms are padded to a power of two by leaves
    that cost nothing. ``nodes[k]`` holds the two children (nodes of level
    k - 1) of each node of level k; the nodes of level 0 are distinct counts.
    """

    def __init__(self, counts: np.ndarray):
        width = 1 << max(0, int(counts.shape[1] - 1).bit_length())
        padded = np.full((len(counts), width), -1, np.int64)
        padded[:, :counts.shape[1]] = counts
        self.counts, ids = np.unique(padded, return_inverse=True)
        level = ids.reshape(padded.shape)
        self.nodes: list[np.ndarray] = []
        self.levels = [level]
        while level.shape[1] > 1:
            base = int(level.max()) + 1
            pairs, ids = np.unique(level[:, ::2] * base + level[:, 1::2], return_inverse=True)
            level = ids.reshape(len(counts), -1)
            self.nodes.append(np.column_stack([pairs // base, pairs % base]))
            self.levels.append(level)
        self.roots = level[:, 0]

    def size(self) -> int:
        return len(self.counts) + sum(map(len, self.nodes))


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exactly."""
    if len(count) and int(count.max()) > (1 << 62) // SCALE - 2:
        return np.array([1 + SCALE * (int(c) + 2) // (int(t) + 2 * terms) for c, t in zip(count, total)], np.int64)
    return 1 + SCALE * (count + 2) // (total + 2 * terms)


class Walk:
    """Simultaneous walk of pairs of trees; every pair of nodes is met once a pair of trees.

    ``sums[k]`` and ``best[k]`` are by distinct (pair, node, node) of level k:
    the price, and the greatest price of a term whose first count is above 0
    and whose first share is the greater (-1: none).
    """

    def __init__(self, forest: Forest, a: np.ndarray, b: np.ndarray, totals: np.ndarray, terms: int):
        pair = np.arange(len(a))
        x, y = forest.roots[a], forest.roots[b]
        height = len(forest.nodes)
        self.children: list[tuple[np.ndarray, np.ndarray]] = [()] * height
        for k in range(height - 1, -1, -1):
            low = forest.nodes[k]
            px, py, pp = low[x].T.ravel(), low[y].T.ravel(), np.concatenate([pair, pair])
            size = len(forest.nodes[k - 1]) if k else len(forest.counts)
            key, at = np.unique((pp * size + px) * size + py, return_inverse=True)
            self.children[k] = (at[:len(x)], at[len(x):])
            pair, x, y = key // (size * size), key // size % size, key % size
        ca, cb = forest.counts[x], forest.counts[y]
        real = ca >= 0
        p, q = (shares(np.maximum(c, 0), totals[t[pair]], terms) for c, t in ((ca, a), (cb, b)))
        price = np.where(real, (p - q) * (p - q) // (p + q), 0)
        self.sums, self.best = [price], [np.where(real & (ca > 0) & (p > q), price, -1)]
        for left, right in self.children:
            s, t = self.sums[-1], self.best[-1]
            self.sums.append(s[left] + s[right])
            self.best.append(np.maximum(t[left], t[right]))

    def leading(self, pair: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, prices) of the terms that can be among the ``top`` best of
        a pair, ties included: a subtree goes as soon as ``top`` others have a
        better best term."""
        node, at = np.array([pair]), np.zeros(1, np.int64)
        for k in range(len(self.children), -1, -1):
            best = self.best[k][node]
            least = np.sort(best)[-top] if len(best) > top else 0
            stays = best >= max(0, least)
            node, at = node[stays], at[stays]
            if k:
                left, right = self.children[k - 1]
                node, at = np.concatenate([left[node], right[node]]), np.concatenate([2 * at, 2 * at + 1])
        return at, self.best[0][node]


def _task(top: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        # rows come in any order: by source, a pair has the same first side in every block
        groups = sorted((r for r in rows if r["terms"] is None), key=lambda r: r["source"].encode())
        language = [r for r in rows if r["terms"] is not None]
        lang, lo, hi, terms = (rows[0][c] for c in ("lang", "lo", "hi", "v"))
        width = rows[0]["width"]
        trees = groups + language
        counts = np.zeros((len(trees), max(1, width)), np.int64)
        for i, r in enumerate(trees):
            counts[i, r["at"]] = r["n"]
        if not width:
            counts[:] = -1
        totals = np.array([r["total"] for r in trees], np.int64)
        forest = Forest(counts)
        tile = np.array([r["tile"] for r in groups])
        left, right = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        if lo == hi:
            a, b = a[a < b], b[a < b]
        out = {c: [] for c in ("lang", "source", "part", "item", "value")}

        def add(source, part, item, value):
            for c, x in zip(out, (lang, source, part, item, value)):
                out[c].append(x)

        for k in range(0, len(a), _PAIRS):
            walk = Walk(forest, a[k:k + _PAIRS], b[k:k + _PAIRS], totals, max(1, terms))
            for i, j, value in zip(a[k:k + _PAIRS].tolist(), b[k:k + _PAIRS].tolist(), walk.sums[-1].tolist()):
                add(groups[i]["source"], "pair", groups[j]["source"], value)
        if language and width:
            names = [t.encode() for t in language[0]["terms"]]
            for k in range(0, len(left), _PAIRS):
                some = left[k:k + _PAIRS]
                walk = Walk(forest, some, np.full(len(some), len(groups)), totals, terms)
                for pair, i in enumerate(some.tolist()):
                    at, value = walk.leading(pair, top)
                    found = sorted(zip((-value).tolist(), [names[x] for x in at.tolist()]))[:top]
                    for v, name in found:
                        add(groups[i]["source"], "term", name.decode(), -v)
        return pa.table({c: pa.array(x, pa.int64() if c == "value" else pa.string()) for c, x in out.items()})
    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, tile: int = TILE,
          text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows lang, source, part, item, value, rank: the ``pair`` rows price every
    other source of the language over all kept terms, the ``term`` rows the
    ``top`` terms that the group uses more than its language."""
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    docs = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"),
                       F.col(text_col).cast("string").alias("text"))
    counts = written(docs.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
                     .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
                     "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")) \
        .filter(F.col("docs") >= min_docs).withColumn("one", F.lit(1))
    ids = written(running_sum(kept, "lang", [F.desc("docs"), F.asc("term")], "one", "id", "term-order").select(
        "lang", "term", "n", F.expr(f"id div {block}").alias("block"), F.expr(f"int(id % {block})").alias("at")),
        "term-ids")

    # one row per (group, block of terms) with a count above 0
    cells = written(counts.select("lang", "source", "term", "n").join(ids.drop("n"), ["lang", "term"])
                    .groupBy("lang", "source", "block")
                    .agg(F.collect_list(F.struct("at", "n")).alias("c"), F.sum("n").alias("sum")), "term-cells")

    groups = docs.select("lang", "source").distinct() \
        .join(cells.groupBy("lang", "source").agg(F.sum("sum").alias("total")), ["lang", "source"], "left") \
        .withColumn("tile", F.expr(f"(row_number() OVER (PARTITION BY lang ORDER BY source) - 1) div {tile}"))
    langs = groups.groupBy("lang").agg((F.max("tile") + 1).alias("tiles")) \
        .join(ids.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total")), "lang", "left") \
        .na.fill(0, ["v", "lang_total"])
    # every group has a row in every block of its language (at least one block, if only an empty one)
    places = groups.na.fill(0, ["total"]).join(langs, "lang") \
        .withColumn("block", F.expr(f"explode(sequence(0L, greatest(0L, (v - 1) div {block})))"))
    width = F.expr(f"int(least({block}, v - block * {block}))").alias("width")
    group_rows = places.join(cells.drop("sum"), ["lang", "source", "block"], "left") \
        .withColumn("other", F.expr("explode(sequence(0L, tiles - 1))")) \
        .select("lang", "block", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "v",
                width, "source", "tile", "total",
                F.coalesce(F.col("c.at"), F.expr("array()").cast("array<int>")).alias("at"),
                F.coalesce(F.col("c.n"), F.expr("array()").cast("array<bigint>")).alias("n"),
                F.lit(None).cast("array<string>").alias("terms"))
    lang_rows = ids.groupBy("lang", "block").agg(F.collect_list(F.struct("at", "n", "term")).alias("c")) \
        .withColumn("c", F.array_sort("c")).join(langs, "lang") \
        .withColumn("lo", F.expr("explode(sequence(0L, tiles - 1))")) \
        .select("lang", "block", "lo", F.col("lo").alias("hi"), "v", width, F.lit(None).cast("string").alias("source"),
                F.lit(None).cast("long").alias("tile"), F.col("lang_total").alias("total"), F.col("c.at").alias("at"),
                F.col("c.n").alias("n"), F.col("c.term").alias("terms"))
    made = group_rows.unionByName(lang_rows).groupBy("lang", "block", "lo", "hi").applyInArrow(
        _task(top), "lang string, source string, part string, item string, value long")
    parts = written(made, "divergence-parts")
    for table in (counts, ids, cells):
        drop_written(table)

    pairs = parts.filter("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", "part", F.col("item").alias("source"),
                                              F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    ranked = F.row_number().over(order).alias("rank")
    cols = ["lang", "source", "part", "item", "value"]
    return both.select(*cols, ranked).unionByName(
        parts.filter("part = 'term'").select(*cols, ranked).filter(F.col("rank") <= top))
