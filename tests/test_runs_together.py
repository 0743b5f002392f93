"""E9-E12 where the runs of a pair come together, against the plain versions; blocks made small so that many meet."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import meeting
from tessera.operators import textruns as tr
from tessera.operators import tiling
from test_textruns import plain_chains, plain_runs, plain_tiles, random_texts


@pytest.mark.parametrize("seed,r", [(5, 3), (6, 2)])
def test_runs_tiles_and_chains_of_small_blocks(spark, seed, r):
    texts = random_texts(seed, n=30, alphabet=4)
    df = spark.createDataFrame([(f"d{i:02d}", t) for i, t in enumerate(texts)], "doc_id string, tokens array<string>").repartition(3)
    runs = tr.maximal_text_runs(df, r, block_bytes=2000, most=40)
    want = {(f"d{x:02d}", f"d{y:02d}"): plain_runs(texts[x], texts[y], r) for x in range(30) for y in range(x + 1, 30)}
    want = {k: v for k, v in want.items() if v}
    assert sorted(map(tuple, runs.collect())) == sorted((*k, *x) for k, v in want.items() for x in v)
    union, tiles = tr.run_union(runs, together=True), tiling.greedy_tiles(runs, r, together=True)
    chains = tr.chain_matches(tiles, 2, together=True)
    for made in (union, tiles, chains):  # before, edges, runs and matches were shuffled by pair
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") >= 1 and plan.index("MapInArrow") < plan.index("FlatMapGroupsInArrow")
        assert not any(x in plan.split("FlatMapGroupsInArrow")[0] for x in ("Join", "Aggregate", "Window", "Sort"))
    cover = {k: [len({i + o for *s, n in v for i in [s[side]] for o in range(n)}) for side in (0, 1)] for k, v in want.items()}
    assert {(u.doc_a, u.doc_b): [u.covered_a, u.covered_b] for u in union.collect()} == cover
    assert {(u.doc_a, u.doc_b): u.n_runs for u in union.collect()} == {k: len(v) for k, v in want.items()}
    tiled = {k: plain_tiles(v, r) for k, v in want.items()}
    assert sorted(map(tuple, tiles.collect())) == sorted((*k, *x) for k, v in tiled.items() for x in v)
    assert sorted(map(tuple, chains.collect())) == sorted((*k, *x) for k, v in tiled.items() for x in plain_chains(v, 2))


@pytest.mark.parametrize("rounds", [1, 4, 50])
def test_tiles_of_many_pairs_at_once(monkeypatch, rounds):
    monkeypatch.setattr(tiling, "ROUNDS", rounds)
    rnd = random.Random(rounds)
    runs = {p: [(rnd.randrange(60), rnd.randrange(60), rnd.randrange(1, 15)) for _ in range(rnd.randrange(12))] for p in range(80)}
    rows = np.array([(p, *x) for p, v in runs.items() for x in v], np.int64)
    got = defaultdict(list)
    for p, *x in zip(*(v.tolist() for v in tiling.tiles_of_pairs(*rows.T, 4))):
        got[p].append(tuple(x))
    assert {p: sorted(v) for p, v in got.items()} == {p: sorted(t) for p, v in runs.items() if (t := plain_tiles(v, 4))}


def test_without_room_for_one_number_rows_are_sorted_by_all(monkeypatch):
    rnd = np.random.default_rng(1)
    cols = [rnd.integers(0, 9, 200), rnd.integers(-9, 9, 200), rnd.integers(0, 9, 200), rnd.integers(0, 2, 200)]
    want = sorted(zip(*(c.tolist() for c in cols)))
    assert list(zip(*(c.tolist() for c in tr._sorted(*cols)))) == want
    cols[0] = cols[0] + 2 ** 60
    assert [x[1:] for x in zip(*(c.tolist() for c in tr._sorted(*cols)))] == [x[1:] for x in want]


def test_pairs_that_batches_cut_are_made_whole(monkeypatch):
    monkeypatch.setattr(meeting, "OUT_ROWS", 5)
    rows = [(a, a + 1, k) for a in range(6) for k in range(1 + 3 * a)]
    batches = [pa.RecordBatch.from_pylist([dict(zip("abk", r)) for r in rows[i:i + 4]], schema=pa.schema(
        [("a", pa.int64()), ("b", pa.int64()), ("k", pa.int64())])) for i in range(0, len(rows), 4)]
    seen = []
    made = meeting.of_pairs("a", "b", lambda t, pair: seen.append((t["a"].to_pylist(), pair.tolist())) or t)
    assert [tuple(r.values()) for b in made(iter(batches)) for r in b.to_pylist()] == rows
    assert len(seen) > 2 and sorted(a for s, _ in seen for a in set(s)) == list(range(6))
    assert all([x - s[0] for x in s] == p for s, p in seen)
