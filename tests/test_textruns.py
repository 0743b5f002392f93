"""Run matching on texts against plain versions: runs, coverage, tiles, chains."""

from __future__ import annotations

import random
import time
from collections import defaultdict

import pytest

from tessera.operators import textruns as tr
from tessera.operators import tiling
from tessera.plans import detect
from tessera.plans.catalog import QUERIES
from tessera.plans.q_textruns import GAP, R


def plain_runs(a, b, r):
    """Maximal common runs (start_a, start_b, len) of two token lists."""
    out = []
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                    k += 1
                if k >= r:
                    out.append((i, j, k))
    return out


def plain_tiles(runs, min_len):
    """Longest run first; the rest are cut at marked positions, every time anew."""
    ma, mb, live, tiles = set(), set(), [r for r in runs if r[2] >= min_len], []
    while live:
        live.sort(key=lambda x: (-x[2], x[0], x[1]))
        sa, sb, n = live[0]
        tiles.append((sa, sb, n))
        ma.update(range(sa, sa + n))
        mb.update(range(sb, sb + n))
        cut = []
        for x, y, m in live[1:]:
            k = 0
            while k < m:
                while k < m and (x + k in ma or y + k in mb):
                    k += 1
                s = k
                while k < m and x + k not in ma and y + k not in mb:
                    k += 1
                if k - s >= min_len:
                    cut.append((x + s, y + s, k - s))
        live = cut
    return tiles


def plain_chains(runs, gap):
    """Merge one mutually nearest pair after another until there is none."""
    m = [(a, a + n, b, b + n, 1, n) for a, b, n in runs]
    while True:
        near = [(x, y) for x in m for y in m if x is not y and 0 <= y[0] - x[1] <= gap and 0 <= y[2] - x[3] <= gap]
        first = {x: min((y for z, y in near if z == x), key=lambda y: (y[0], y[2], y)) for x, _ in near}
        last = {y: max((x for x, z in near if z == y), key=lambda x: (x[1], x[3])) for _, y in near}
        both = [(x, y) for x, y in first.items() if last[y] == x]
        if not both:
            return sorted(m)
        nxt = dict(both)
        heads = [x for x in nxt if x not in nxt.values()]
        gone = set(nxt) | set(nxt.values())
        merged = []
        for h in heads:
            chain = [h]
            while chain[-1] in nxt:
                chain.append(nxt[chain[-1]])
            merged.append((min(c[0] for c in chain), max(c[1] for c in chain), min(c[2] for c in chain),
                           max(c[3] for c in chain), sum(c[4] for c in chain), sum(c[5] for c in chain)))
        m = [x for x in m if x not in gone] + merged


def random_texts(seed, n=14, alphabet=6):
    rnd = random.Random(seed)
    texts = []
    for _ in range(n):
        t = [rnd.choice("abcdef"[:alphabet]) for _ in range(rnd.randrange(30))]
        if texts and rnd.random() < 0.7:
            src = rnd.choice(texts)
            k = rnd.randrange(len(src) + 1)
            t = t[:rnd.randrange(len(t) + 1)] + src[k:k + rnd.randrange(30)] + t
        texts.append(t)
    return texts


@pytest.mark.parametrize("seed,r,alphabet", [(1, 3, 6), (2, 5, 3), (3, 1, 6), (4, 4, 1)])
def test_runs_and_coverage_against_plain_version(spark, seed, r, alphabet):
    texts = random_texts(seed, alphabet=alphabet)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, tokens array<string>").repartition(3)
    runs = tr.maximal_text_runs(df, r)
    want = {(x, y, *run) for x in range(len(texts)) for y in range(x + 1, len(texts))
            for run in plain_runs(texts[x], texts[y], r)}
    got = [tuple(x) for x in runs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    cover = defaultdict(lambda: (set(), set()))
    for x, y, i, j, n in want:
        cover[x, y][0].update(range(i, i + n))
        cover[x, y][1].update(range(j, j + n))
    assert {(c.doc_a, c.doc_b): (c.covered_a, c.covered_b) for c in tr.run_union(runs).collect()} == {
        k: (len(a), len(b)) for k, (a, b) in cover.items()}


def test_the_inside_of_a_shared_passage_makes_no_matches(spark):
    """40 texts share 300 words in a row: one run a pair, and no gram of the inside is joined."""
    passage = [f"p{i}" for i in range(300)]
    texts = [[f"a{k}", *passage, f"b{k}"] for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, tokens array<string>")
    grams = tr.edge_grams(df, 10)
    assert tr._edges(grams, "prev").count() == tr._edges(grams, "next").count() == 40 * 39 // 2
    assert {(x.start_a, x.start_b, x.len) for x in tr.maximal_text_runs(df, 10).collect()} == {(1, 1, 300)}


def test_no_texts_and_texts_without_words(spark):
    df = spark.createDataFrame([(1, []), (2, None), (3, ["x"])], "doc_id long, tokens array<string>")
    assert tr.maximal_text_runs(df, 3).count() == 0 and tr.maximal_text_runs(df.filter("false"), 3).count() == 0
    assert [r.doc_id for r in tr.distinct_texts(df).collect()] == [3]


@pytest.mark.parametrize("seed", range(40))
def test_tiles_equal_the_plain_version(seed):
    rnd = random.Random(seed)
    texts = random_texts(seed, 2, 1 + seed % 4)
    runs = plain_runs(texts[0], texts[1], 1 + seed % 3) + [
        (rnd.randrange(60), rnd.randrange(60), rnd.randrange(1, 12)) for _ in range(rnd.randrange(40))]
    assert tiling.tiles_of(runs, 1 + seed % 4) == plain_tiles(runs, 1 + seed % 4)


def test_a_pair_with_100000_runs_is_tiled_in_seconds():
    rnd = random.Random(1)
    runs = [(rnd.randrange(10**6), rnd.randrange(10**6), rnd.randrange(5, 200)) for _ in range(100_000)]
    t = time.time()
    tiles = tiling.tiles_of(runs, 5)
    assert time.time() - t < 30
    for k in (0, 1):
        spans = sorted((x[k], x[k] + x[2]) for x in tiles)
        assert all(e <= s for (_, e), (s, _) in zip(spans, spans[1:]))


RUNS = "doc_a long, doc_b long, start_a long, start_b long, len long"


def test_a_match_elsewhere_does_not_break_a_chain(spark):
    runs = [(1, 2, 0, 0, 100), (1, 2, 50, 200, 5), (1, 2, 102, 102, 48)]
    got = {tuple(r) for r in tr.chain_matches(spark.createDataFrame(runs, RUNS), 2).collect()}
    assert got == {(1, 2, 0, 150, 0, 150, 2, 148), (1, 2, 50, 55, 200, 205, 1, 5)}


@pytest.mark.parametrize("seed", range(3))
def test_chains_equal_the_plain_version(spark, seed):
    rnd = random.Random(seed)
    rows, want = [], set()
    for pair in range(25):
        a = b = 0
        runs = []
        for _ in range(rnd.randrange(1, 14)):
            n = rnd.randrange(4, 9)
            runs.append((a, b, n))
            a, b = a + n + rnd.randrange(5), b + n + rnd.randrange(5)
        runs += [(rnd.randrange(60), rnd.randrange(60), rnd.randrange(4, 9)) for _ in range(seed * 4)]
        runs = plain_tiles(runs, 4)
        rows += [(pair, 99, *r) for r in runs]
        want |= {(pair, 99, *m) for m in plain_chains(runs, 3)}
    assert {tuple(r) for r in tr.chain_matches(spark.createDataFrame(rows, RUNS), 3).collect()} == want


def test_long_chains_need_few_rounds(spark):
    rows = [(1, 2, 12 * k, 12 * k, 10) for k in range(1000)]
    got = [tuple(r) for r in tr.chain_matches(spark.createDataFrame(rows, RUNS), 2).collect()]
    assert got == [(1, 2, 0, 11998, 0, 11998, 1000, 10_000)]


def test_tiles_and_chains_of_the_given_documents(spark, sf_check):
    """e11_text_tiles and e12_chained_matches against the plain versions, from the runs that SQL confirms."""
    runs = defaultdict(list)
    for r in QUERIES["e10_text_runs"](spark, sf_check).collect():
        runs[r.doc_a, r.doc_b].append((r.start_a, r.start_b, r.len))
    tiles = {p: plain_tiles(x, R) for p, x in runs.items()}
    got = defaultdict(set)
    for r in QUERIES["e11_text_tiles"](spark, sf_check).collect():
        got[r.doc_a, r.doc_b].add((r.start_a, r.start_b, r.len))
    assert got == {p: set(t) for p, t in tiles.items()} and sum(map(len, tiles.values())) > 100
    chains = {(*p, *m) for p, t in tiles.items() for m in plain_chains(t, GAP)}
    assert {tuple(r) for r in QUERIES["e12_chained_matches"](spark, sf_check).collect()} == chains


def test_word_docs_have_the_tokens_that_runs_count(spark, sf_small):
    d = detect.word_docs(spark, sf_small).filter("size(tokens) > 0").first()
    assert all(t == t.lower() and t for t in d.tokens)


def test_only_grams_found_again_leave_the_scan_and_ids_may_repeat(spark):
    rnd = random.Random(5)
    rows = [(k, [rnd.choice("abc") for _ in range(rnd.randrange(30))]) for k in range(12)] + [(3, list("abcabcab"))]
    rows += [(None, list("abcabc")), (20, None)]
    docs = spark.createDataFrame(rows, "doc_id int, tokens array<string>")
    got = tr.edge_grams(docs, 4)
    plain = [(d, i, tuple(t[i:i + 4])) for d, t in rows if t for i in range(len(t) - 3)]
    often = defaultdict(int)
    for _, _, g in plain:
        often[g] += 1
    want = sorted((d, i) for d, i, g in plain if often[g] > 1 and d is not None)
    found = sorted((r.doc_id, r.pos) for r in got.collect())
    assert set(want) <= set(found) and len([x for x in found if x[0] != 3]) == len([x for x in want if x[0] != 3])
