from __future__ import annotations

import random
import re

import pytest

from helpers import docs_frame
from tessera.llm.decontaminate import contamination, decontaminate

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(t):
    return TOKEN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, window):
    out = []
    for i, text in rows:
        w, hit, found = tokens(text), set(), set()
        for item, t in items:
            x = tokens(t)
            n = min(window, len(x))
            wins = {tuple(x[s:s + n]) for s in range(len(x) - n + 1)} if x else set()
            for s in range(len(w) - n + 1 if n else 0):
                if tuple(w[s:s + n]) in wins:
                    hit.update(range(s, s + n))
                    found.add("null" if item is None else str(item))
        out.append((str(i), len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_matches_brute_force_in_one_block_and_in_several(spark, block_bytes):
    r = random.Random(block_bytes)
    vocab = ["a", "B", "cé", "d9", "ßx", "e"]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    items = [(k, text(r.randint(5, 12))) for k in range(8)] + [(8, "lone"), (9, ""), (10, None), (None, text(7)),
                                                                 (3, text(6)), (11, "a b")]
    rows = [(0, None), (1, ""), (2, "..."), (3, "LONE!"), (4, "A,B")]
    passages = [t.upper() for _, t in items if t]
    for k in range(5, 60):
        rows.append((k, f"{text(r.randint(0, 40))}; {r.choice(passages)}" if k % 2 else text(r.randint(0, 60))))
    rows += [(70, rows[8][1]), (70, rows[8][1]), (None, rows[9][1]), (71, (items[0][1] + " ") * 300)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs_frame(spark, rows, extra=True)
    found = contamination(df, bench, window=5, block_bytes=block_bytes).collect()
    got = sorted((str(x.doc_id), x.n_words, x.n_hit, ",".join(x["items"]), x.contaminated) for x in found)
    assert got == brute(rows, items, 5)
    assert all(x.n_items == len(x["items"]) and sum(s.e - s.s for s in x.spans) == x.n_hit for x in found)
    clean = decontaminate(df, bench, window=5, block_bytes=block_bytes)
    assert clean.columns == df.columns
    assert clean.count() == sum(not x.contaminated for x in found)


def test_longest_match_and_its_place(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    df = docs_frame(spark, [(1, "x two three four five y one two three z"), (2, "x")])
    got = {r.doc_id: r for r in contamination(df, bench, window=3).collect()}
    assert got[1].longest == 4 and [(s.s, s.e) for s in got[1].spans] == [(1, 5), (6, 9)]
    assert got[2].longest == 0 and not got[2].contaminated


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in contamination(docs_frame(spark, [(1, "a b")]), bench).collect()] == [False]
    assert contamination(spark.createDataFrame([], "doc_id long, text string"), bench).count() == 0
