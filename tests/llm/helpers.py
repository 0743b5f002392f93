"""Small fixtures and brute-force versions for the training-data operators."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_frame(spark, rows, extra: bool = False):
    """rows: (doc_id, text); with extra, columns whose names clash with outputs and helpers."""
    full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        full = [(*r, "x", 1, "y", 0.5) for r in full]
        schema += ", kept string, n_removed int, __text string, score double"
    return spark.createDataFrame(full, schema).repartition(4)


def places(texts, length):
    where = defaultdict(list)
    for k, units in enumerate(texts):
        for s in range(len(units) - length + 1):
            where[tuple(units[s:s + length])].append((k, s))
    return where


def brute_removed(texts, length, keep="none"):
    """Covered unit positions of each text (texts in the order of (id, ...))."""
    gone = [set() for _ in texts]
    for at in places(texts, length).values():
        for k, s in (at if keep == "none" else at[1:]) if len(at) > 1 else ():
            gone[k].update(range(s, s + length))
    return gone


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def runs(positions) -> int:
    return sum(p - 1 not in positions for p in positions)
