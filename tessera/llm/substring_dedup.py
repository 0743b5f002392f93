"""Operator 2, substring dedup: level-wise doubling over word windows.

Windows repeated at one length alone are extended to twice that length. The
first level is the anchor gram of ``GRAM`` words (see ``repeats``); a window
of ``length`` words stays a candidate while the run of GRAM, 2*GRAM, ... words
around its anchor is found at two or more places, and is removed if all of its
words are. Candidates of one shard are counted by 64-bit run hashes at each
level; the last level compares 128 bits.

Defined results: null and empty texts have no words and nothing removed; a
text of fewer than ``length`` words keeps all of them; rows repeated with id
and text are repeated places; an empty table gives an empty result. Only the
id and text columns are read, so other columns (clashing names included)
don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import vec
from .repeats import Block, remove_windows, repeated_windows

LENGTH = 35
GRAM = 9


def doubling(gram: int):
    """Resolver: classes of equal windows by doubling levels."""
    def resolve(blk: Block, length: int) -> np.ndarray:
        one, two = vec.Rolling(blk.data, 0), vec.Rolling(blk.data, 1)
        starts, seg = blk.starts, blk.seg
        anchor = blk.places(one.grams(gram))
        alive = np.arange(len(starts))
        level = gram
        while level < length and len(alive):
            level = min(2 * level, length)
            s = starts[alive]
            at = np.clip(anchor[alive] - (level - gram) // 2, s, s + length - level)
            h = one.runs(at, at + level)
            if level == length:
                break
            place, first = np.unique(at, return_index=True)
            value, inv, n = np.unique(h[first], return_inverse=True, return_counts=True)
            weight = np.bincount(inv, weights=1 + blk.many[seg[alive[first]]])
            stays = (weight[np.searchsorted(value, h)] > 1) | blk.salted[seg[alive]]
            alive = alive[stays]
        cls = np.arange(len(starts), dtype=np.int64)  # a window of its own unless equal to another
        if len(alive):
            s = starts[alive]
            pair = np.empty(len(alive), [("a", np.uint64), ("b", np.uint64)])
            pair["a"], pair["b"] = one.runs(s, s + length), two.runs(s, s + length)
            _, inv = np.unique(pair, return_inverse=True)
            cls[alive] = len(starts) + inv
        return cls
    return resolve


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "none",
                    with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, n_spans, kept_sha256 (and ``kept``).

    keep="none" removes every word of a window that starts anywhere else too;
    keep="first" keeps the earliest place (by id) of each window.
    """
    windows = repeated_windows(docs, "words", length, min(gram, length), doubling(min(gram, length)), keep,
                               id_col, text_col)
    return remove_windows(docs, windows, "words", length, with_text, id_col, text_col) \
        .withColumnRenamed("n_units", "n_words")
