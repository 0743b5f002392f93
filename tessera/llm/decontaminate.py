"""Operator 10, benchmark decontamination: training suffix arrays.

The documents are the training text. Each Arrow batch of documents is a shard
(split where it grows large): its word suffixes are sorted into a suffix
array, and every test suffix (each 13-word window of a benchmark item, or the
whole of a shorter item) is found in it by binary search. The range that a
search returns holds all places of that window. Places of consecutive windows
on the same diagonal join to the longest verbatim match.

The suffix array is sparse: it holds the suffixes whose first words (up to
four) start some test suffix. All others cannot match and are not sorted.

The benchmark is the stated query set. It is cut into blocks of at most about
``BLOCK_BYTES`` of text by a hash of the item, each block is broadcast by
itself, and documents pass block after block in the same task without a
shuffle; every fourth block the state is written down and the blocks are freed.

Words are lower-cased (A-Z only) ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

Defined results: null or empty documents have no words and are clean; null or
empty items have no windows; an item without an id counts as item "null";
items that share an id are one item; repeated rows are judged alike; an empty
benchmark leaves all documents clean. Input columns named like an output
column are replaced, all others pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .common import guarded, written

WINDOW = 13
HEAD = 4
BLOCK_BYTES = 4 << 20
SHARD_SUFFIXES = 400_000
THRESHOLD = (1, 20)     # contaminated: hit words are at least 1/20 of all

NOT_WORD = np.zeros(256, bool)
NOT_WORD[0x00:0x30] = NOT_WORD[0x3A:0x61] = NOT_WORD[0x7B:0x80] = True


def _codes(buf: np.ndarray, offs: np.ndarray):
    """(word codes, first word of each text) of lower-cased texts."""
    low = vec.ASCII_LOWER[buf]
    starts, ends, first = vec.words(low, offs, NOT_WORD)
    return vec.Rolling(vec.BYTE_CODE[low]).runs(starts, ends), first


class TestSuffixes:
    """The windows of one block of items, as keys for binary search."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        self.window, self.ids = window, sorted(set(ids))
        number = {x: k for k, x in enumerate(self.ids)}
        texts = [(ids[lo + d], codes[first[d]:first[d + 1]]) for lo, buf, offs in vec.text_arrays(pa.array(texts, pa.string()))
                 for codes, first in [_codes(buf, offs)] for d in range(len(offs) - 1)]
        texts = [(i, w) for i, w in texts if len(w)]
        self.size = 0
        if not texts:
            return
        # words as four-byte numbers from the start: a window is then 52 bytes, its own key
        self.vocabulary = np.unique(np.concatenate([w for _, w in texts]))
        wide = np.array([min(window, len(w)) for _, w in texts])
        many = np.array([len(w) for _, w in texts]) - wide + 1
        words = np.zeros((int(many.sum()), window), ">u4")
        for (_, w), at, m, n in zip(texts, np.cumsum(many) - many, many, wide):
            numbers = (np.searchsorted(self.vocabulary, w) + 1).astype(">u4")
            words[at:at + m, :n] = np.lib.stride_tricks.sliding_window_view(numbers, n)
        self.item = np.repeat(np.array([number[i] for i, _ in texts], np.int32), many)
        self.offset = vec.ranges(np.zeros(len(many), np.int64), many).astype(np.int32)
        # unused places are 0 and no word is, so equal keys have equal lengths
        keys = words.view(np.uint8).reshape(len(words), -1).view(f"S{4 * window}").ravel()
        self.low, at, self.window_of = np.unique(keys, return_index=True, return_inverse=True)
        self.window_of = self.window_of.astype(np.int32)
        self.length = np.repeat(wide, many)[at].astype(np.int32)
        self.size = len(at)
        # a full window is its own upper end; that of a shorter one ends in 0xFF
        self.short = np.flatnonzero(self.length < window)
        high = words[at[self.short]]
        high[np.arange(window)[None, :] >= self.length[self.short][:, None]] = 0xFFFFFFFF
        self.short_high = high.view(np.uint8).reshape(len(high), 4 * window).view(f"S{4 * window}").ravel()
        by = np.argsort(self.window_of, kind="stable")  # test suffixes of each distinct window
        self.of_window, self.first_of = by.astype(np.int32), np.searchsorted(self.window_of[by], np.arange(self.size + 1))
        self.heads = {}  # head length -> (filter bits, exact hashes)
        for g in range(1, HEAD + 1):
            rows = at[np.minimum(self.length, HEAD) == g]
            if len(rows):
                flat = vec.Rolling(self.vocabulary[words[rows, :g].astype(np.int64).ravel() - 1]).grams(g)[::g]
                bits = np.zeros(1 << 20, bool)
                bits[(flat >> np.uint64(44)).astype(np.int64)] = True
                self.heads[g] = bits, np.unique(flat)

    def bytes_of(self, codes: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Word numbers (from 1; 0 for none or another word) as four bytes, first byte first."""
        at = np.searchsorted(self.vocabulary, codes)
        at[at == len(self.vocabulary)] = 0
        known = used & (self.vocabulary[at] == codes)
        return np.where(known, at + 1, 0).astype(">u4").view(np.uint8).reshape(*codes.shape, 4)

    def keys(self, codes: np.ndarray, used: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.bytes_of(codes, used).reshape(len(codes), 4 * self.window)) \
            .view(f"S{4 * self.window}").ravel()

    def suffixes(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, keys) of the suffixes of these texts that may match."""
        end = np.repeat(first[1:], np.diff(first))
        take = np.zeros(len(codes), bool)
        roll = vec.Rolling(codes)
        for g, (bits, exact) in self.heads.items():
            if len(codes) < g:
                continue
            h = roll.grams(g)
            at = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
            pos = np.searchsorted(exact, h[at])
            pos[pos == len(exact)] = 0
            at = at[exact[pos] == h[at]]
            take[at[at + g <= end[at]]] = True
        places = np.flatnonzero(take)
        words = places[:, None] + np.arange(self.window)[None, :]
        used = words < end[places][:, None]
        return places, self.keys(codes[np.minimum(words, len(codes) - 1)], used)

    def search(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Binary search of all windows in the suffix array of ``keys``:
        (suffix order, first place, end of the range of places)."""
        order = np.argsort(keys, kind="stable")
        array = keys[order]
        end = np.searchsorted(array, self.low, "right")
        end[self.short] = np.searchsorted(array, self.short_high, "right")
        return order, np.searchsorted(array, self.low, "left"), end


class _Shard:
    """Suffixes gathered from consecutive chunks of one batch."""

    def __init__(self):
        self.places, self.keys, self.base, self.size = [], [], 0, 0

    def add(self, places, keys, n_words):
        self.places.append(places + self.base)
        self.keys.append(keys)
        self.base += n_words
        self.size += len(places)

    def match(self, test: TestSuffixes):
        """(place, window length, item, item offset) of every occurrence."""
        places, keys = np.concatenate(self.places), np.concatenate(self.keys)
        order, left, right = test.search(keys)
        hit = np.flatnonzero(right > left)
        n = (right - left)[hit]
        window = np.repeat(hit, n)
        place = places[order[vec.ranges(left[hit], n)]]
        tests = (test.first_of[1:] - test.first_of[:-1])[window]
        t = test.of_window[vec.ranges(test.first_of[window], tests)]
        return place, test.length[window], np.repeat(place, tests), test.item[t], test.offset[t], \
            np.repeat(test.length[window], tests)


def _longest(place, item, offset, length, doc, n_docs: int) -> np.ndarray:
    """Longest verbatim match of each document: windows that go on one word
    later in both the document and the item are one match."""
    out = np.zeros(n_docs, np.int64)
    if not len(place):
        return out
    by = np.lexsort((place, place - offset, item, doc))
    place, offset, item, length, doc = (x[by] for x in (place, offset, item, length, doc))
    new = np.ones(len(place), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) \
        | (offset[1:] != offset[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(place)) - 1
    np.maximum.at(out, doc[at], place[last] + length[last] - place[at])
    return out


def _scan(block, text_at: int, n_cols: int):
    """Search one block; state columns are the last four: n_words, spans, items, longest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = block.value
        for b in batches:
            n = len(b)
            old = b.column(n_cols + 1)
            old_at, old_st = old.offsets.to_numpy(), old.values
            old_s, old_e = (old_st.field(k).to_numpy() for k in ("s", "e"))
            old_items = b.column(n_cols + 2).to_pylist()
            old_longest = b.column(n_cols + 3).to_numpy()
            total, spans, items, longest = [], [], [], []
            shard, todo = _Shard(), []

            def flush():
                firsts = [f for _, f in todo]
                base = np.cumsum([0] + [f[-1] for f in firsts])
                first = np.concatenate([f[:-1] + k for f, k in zip(firsts, base)] + [base[-1:]])
                lo, k = todo[0][0], len(first) - 1
                edge = np.zeros(int(first[-1]) + 1, np.int32)
                if test.size and shard.size:
                    place, length, p2, item, offset, l2 = shard.match(test)
                    np.add.at(edge, place, 1)
                    np.add.at(edge, place + length, -1)
                    doc = np.searchsorted(first, p2, "right") - 1
                    far = _longest(p2, item, offset, l2, doc, k)
                    pairs = np.unique(doc * len(test.ids) + item)
                else:
                    far, pairs = np.zeros(k, np.int64), np.zeros(0, np.int64)
                prev = np.arange(old_at[lo], old_at[lo + k])
                owner = np.repeat(np.arange(k), np.diff(old_at[lo:lo + k + 1]))
                np.add.at(edge, first[owner] + old_s[prev], 1)
                np.add.at(edge, first[owner] + old_e[prev], -1)
                hit = np.cumsum(edge)[:-1] > 0
                cut = np.zeros(len(hit) + 1, bool)
                cut[first] = True
                opens = np.flatnonzero(hit & ~(np.concatenate([[False], hit[:-1]]) & ~cut[:-1]))
                ends = np.flatnonzero(hit & ~(np.concatenate([hit[1:], [False]]) & ~cut[1:])) + 1
                owner = np.searchsorted(first, opens, "right") - 1
                at = np.searchsorted(opens, first)
                which = np.searchsorted(pairs, np.arange(k + 1) * max(len(test.ids) if test.size else 1, 1))
                s, e = opens - first[owner], ends - first[owner]
                for d in range(k):
                    spans.append([{"s": int(x), "e": int(y)} for x, y in zip(s[at[d]:at[d + 1]], e[at[d]:at[d + 1]])])
                    new = [test.ids[x % len(test.ids)] for x in pairs[which[d]:which[d + 1]]]
                    items.append(sorted({*(old_items[lo + d] or ()), *new}))
                total.extend(np.diff(first).tolist())
                longest.extend(np.maximum(far, old_longest[lo:lo + k]).tolist())

            for lo, buf, offs in vec.text_arrays(b.column(text_at)):
                codes, first = _codes(buf, offs)
                if test.size and len(codes):
                    shard.add(*test.suffixes(codes, first), len(codes))
                else:
                    shard.base += len(codes)
                todo.append((lo, first))
                if shard.size >= SHARD_SUFFIXES:
                    flush()
                    shard, todo = _Shard(), []
            if todo:
                flush()
            cols = [*(b.column(i) for i in range(n_cols)), pa.array(total, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
                     pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                  threshold=THRESHOLD) -> DataFrame:
    """``docs`` plus n_words, n_hit, n_items, items (sorted ids), longest (words of the
    longest verbatim match), spans (start and end words of hit runs), contaminated."""
    spark = docs.sparkSession
    made = {"n_words", "n_hit", "n_items", "items", "longest", "spans", "contaminated"} - {text_col}
    own, names = guarded(docs.select(*[c for c in docs.columns if c not in made]))
    text_at = names.index(text_col)
    own = own.withColumn(f"c{text_at}", F.col(f"c{text_at}").cast("string"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"),
                             F.col(item_text_col).cast("string").alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n_blocks = -(-int(size) // block_bytes)
    part = F.pmod(F.xxhash64("i", "t"), F.lit(max(n_blocks, 1)))
    state = own.select("*", F.lit(0).cast("long").alias("__n"),
                       F.array().cast("array<struct<s:int,e:int>>").alias("__spans"),
                       F.array().cast("array<string>").alias("__items"), F.lit(0).cast("long").alias("__longest"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in state.schema.fields])
    live = []
    for k in range(max(n_blocks, 1)):  # each collect is bounded by the block size
        rows = items.filter(part == k).collect() if n_blocks else []
        test = spark.sparkContext.broadcast(TestSuffixes([r.i for r in rows], [r.t for r in rows], window))
        live.append(test)
        state = state.mapInArrow(_scan(test, text_at, len(names)), schema)
        if k % 4 == 3 and k < n_blocks - 1:
            state = written(state, "decontaminate")
            while live:  # the written state needs its blocks no more
                live.pop().destroy()
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    out = state.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("__n").alias("n_words"),
                       hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
                       F.col("__items").alias("items"), F.col("__longest").alias("longest"),
                       F.col("__spans").alias("spans"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0)
                          & (F.lit(threshold[1]) * F.col("n_hit") >= F.lit(threshold[0]) * F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The clean documents, with the columns of ``docs``."""
    own, names = guarded(docs)
    found = contamination(own, benchmark, text_col=f"c{names.index(text_col)}", **kw)
    return found.filter(~F.col("contaminated")).select(*own.columns).toDF(*names)
