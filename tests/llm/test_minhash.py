from __future__ import annotations

import random

import numpy as np
import pytest

from helpers import WORD, docs_frame
from tessera.llm import minhash
from tessera.llm.components import components
from tessera.llm.minhash import connect, near_duplicates


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute(rows, percent=85):
    """component by lowest id (null last) and set size, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                parent[find(parent, i)] = find(parent, j)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(parent, k), []).append(i)
    low = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted((str(i), len(sets[k]), str(low[find(parent, k)])) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("unit", [4096, 4])
def test_components_match_brute_force(spark, monkeypatch, unit):
    monkeypatch.setattr(minhash, "UNIT", unit)
    r = random.Random(unit)
    vocab = [f"w{k}" for k in range(500)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "a b c d"), (6, "A  b\nc D"), (7, "two")]
    for f in range(6):
        base = [r.choice(vocab) for _ in range(150)]
        for _ in range(9):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((10 + len(rows), " ".join(w)))
    rows += [(200, rows[20][1]), (5000, rows[20][1].upper()), (None, rows[30][1]), (None, "alone with a null id x y z")]
    out = near_duplicates(docs_frame(spark, rows, extra=True)).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in out) == brute(rows)
    assert all(x.kept == (x.doc_id == x.component_id) for x in out)


def test_connect_in_blocks_equals_all_pairs():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**60, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(100) > 0.06], r.integers(0, 2**60, 3, dtype=np.uint64)]))
            for _ in range(12)]
    sig = np.zeros((12, 125), np.uint8)  # all signatures equal: every pair is compared on its set
    want = set()
    for i in range(12):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                want.add((j, i))
    parent = list(range(12))
    for i, j in want:
        parent[find(parent, i)] = find(parent, j)
    got = list(range(12))
    halves = np.arange(6), np.arange(6, 12)
    for left, right in ((halves[0], halves[0]), (halves[1], halves[1]), halves):
        for i, j in connect(sig, sets, left, right):
            assert (min(i, j), max(i, j)) in want
            got[find(got, i)] = find(got, j)
    same = lambda p: {frozenset(x for x in range(12) if find(p, x) == find(p, y)) for y in range(12)}
    assert same(got) == same(parent)


def test_components_of_a_path_a_star_and_a_cycle(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(50, 51), (51, 52), (52, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{100 + i: 100 for i in range(30)}, 50: 50, 51: 50, 52: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_by_id(rows, den=100, num=85):
    """As ``brute``, with the rows of an id linked."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same or k and den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                parent[find(parent, i)] = find(parent, j)
    low = {}
    for k, (i, _) in enumerate(rows):
        low.setdefault(find(parent, k), []).append(i)
    low = {g: min((i for i in ids if i is not None), default=None) for g, ids in low.items()}
    return sorted((str(i), len(sets[k]), str(low[find(parent, k)])) for k, (i, _) in enumerate(rows))


def test_rows_of_an_id_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(5, a), (5, b), (3, a), (9, b), (20, c), (20, c), (21, ""), (21, a), (22, None), (22, ""), (None, b), (None, "n")]
    out = near_duplicates(docs_frame(spark, rows)).collect()
    assert {x.component_id for x in out if x.doc_id in (3, 5, 9, 21)} == {3}
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in out) == brute_by_id(rows)
    assert all(x.kept == (x.doc_id == x.component_id) for x in out)


def test_a_unit_of_long_texts_is_split_by_its_shingles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "WEIGHT", 300)
    r = random.Random(4)
    rows = []
    for f in range(4):
        base = [f"v{r.randrange(400)}" for _ in range(120)]
        for _ in range(8):
            w = list(base)
            w[r.randrange(120)] = "changed"
            rows.append((len(rows), " ".join(w)))
    out = near_duplicates(docs_frame(spark, rows)).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in out) == brute(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
