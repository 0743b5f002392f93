from __future__ import annotations

import random

import numpy as np
import pytest

from helpers import WORD, brute_removed, docs_frame, runs, sha
from tessera.llm import repeats, vec
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.suffix_dedup import factors, suffix_dedup


def corpus(seed: int, n: int = 60):
    """Random texts with shared passages, copies, periodic runs, nulls and empties."""
    r = random.Random(seed)
    vocab = ["a", "bé", "c", "dd", "ñe", "f", "gg!", "h"]
    words = lambda k: [r.choice(vocab) for _ in range(k)]
    shared = [words(r.randint(5, 40)) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "   \n "), (3, "a " * 90), (4, "a " * 90), (5, "b"), (6, "ab" * 100)]
    for i in range(7, n):
        w = words(r.randint(0, 30)) + r.choice(shared) + words(r.randint(0, 30))
        if r.random() < 0.4:
            w += r.choice(shared)
        rows.append((i, r.choice([" ", "\n", " \t"]).join(w)))
    for i in range(n, n + 8):
        rows.append((i, rows[r.randrange(7, n)][1]))
    rows += [(90, rows[10][1]), (90, rows[10][1]), (None, rows[11][1]), (91, "\x00\x00" * 30 + "q" * 30)]
    return rows


def ordered(rows, spark):
    """Rows in the order of (id with null first); equal ids here have equal texts."""
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("shard", [1024, 2])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, keep, shard):
    monkeypatch.setattr(repeats, "SHARD", shard)
    rows = ordered(corpus(3 + shard), spark)
    texts = [WORD.findall(t or "") for _, t in rows]
    gone = brute_removed(texts, 10, keep)
    want = sorted((str(i), len(w), len(g), runs(g), sha(" ".join(x for p, x in enumerate(w) if p not in g).encode()))
                  for (i, _), w, g in zip(rows, texts, gone))
    out = substring_dedup(docs_frame(spark, rows, extra=True), length=10, gram=3, keep=keep)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect())
    if keep == "first":  # rows that repeat id and text are one text in two places: both count as later or neither
        got, want = ([x for x in v if x[0] != "90"] for v in (got, want))
    assert got == want


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("shard", [1024, 2])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, keep, shard):
    monkeypatch.setattr(repeats, "SHARD", shard)
    rows = ordered(corpus(5 + shard), spark)
    texts = [(t or "").encode() for _, t in rows]
    gone = brute_removed(texts, 20, keep)
    want = sorted((str(i), len(b), len(g), runs(g), sha(bytes(x for p, x in enumerate(b) if p not in g)))
                  for (i, _), b, g in zip(rows, texts, gone))
    out = suffix_dedup(docs_frame(spark, rows, extra=True), length=20, gram=6, keep=keep, with_text=True)
    got_rows = out.collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got_rows)
    if keep == "first":
        got, want = ([x for x in v if x[0] != "90"] for v in (got, want))
    assert got == want
    assert all(sha(bytes(r.kept)) == r.kept_sha256 for r in got_rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(empty).count() == 0
    assert suffix_dedup(empty).count() == 0


def test_factors_are_longest_earlier_and_later_matches():
    r = random.Random(1)
    data = bytes(r.choice(b"ab") for _ in range(300)) + b"abab" * 20
    starts = np.arange(0, len(data) - 16)
    lpf, lnf, _ = factors(np.frombuffer(data, np.uint8), starts, 16)

    def lcp(i, j):
        k = 0
        while k < 16 and max(i, j) + k < len(data) and data[i + k] == data[j + k]:
            k += 1
        return k

    for i in starts.tolist():
        assert lpf[i] == max((lcp(i, j) for j in starts.tolist() if j < i), default=0)
        assert lnf[i] == max((lcp(i, j) for j in starts.tolist() if j > i), default=0)


def test_words_and_chunks_match_a_plain_split():
    import pyarrow as pa

    texts = ["", None, "a b", " x\ny ", "é è", "end", "z", " ", "tail \x0b\x0c"]
    got = []
    for _, buf, offs in vec.text_arrays(pa.array(texts)):
        s, e, first = vec.words(buf, offs, vec.SPACES)
        for d in range(len(offs) - 1):
            got.append([buf[s[k]:e[k]].tobytes().decode() for k in range(first[d], first[d + 1])])
    assert got == [WORD.findall(t or "") for t in texts]
