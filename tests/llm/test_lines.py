from __future__ import annotations

import random
from collections import defaultdict

import pytest

from helpers import WORD, docs_frame, sha
from tessera.llm.line_dedup import LONG, line_dedup


@pytest.mark.parametrize("run", [1, 2, 4])
def test_later_runs_go_as_in_brute_force(spark, run):
    r = random.Random(run)
    lines = ["alpha", "beta b", "ç", "  ", "", "gamma\t", "x" * 3000, "delta"]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "alpha"), (4, "alpha\nalpha\nalpha\nalpha\nalpha\nalpha"),
            (5, "beta b\n")]
    for i in range(6, 60):
        rows.append((i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 14)))))
    rows += [(60, rows[20][1]), (None, rows[21][1])]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    seen, gone, units = defaultdict(list), defaultdict(set), {}
    for k, (_, t) in enumerate(rows):
        units[k] = [p for p, x in enumerate((t or "").split("\n")) if WORD.search(x)]
        ls = (t or "").split("\n")
        for s in range(len(units[k]) - run + 1):
            key = tuple(ls[p] for p in units[k][s:s + run])
            if seen[key]:
                gone[k].update(units[k][s:s + run])
            seen[key].append((k, s))
    want = sorted((str(i), len(units[k]), len(gone[k]),
                   sha("\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in gone[k]).encode()))
                  for k, (i, t) in enumerate(rows))
    df = docs_frame(spark, rows, extra=True)
    out = line_dedup(df, run=run)
    got_rows = out.collect()
    assert sorted((str(x.doc_id), x.n_lines, x.n_removed, x.kept_sha256) for x in got_rows) == want
    assert all(sha(x.text.encode()) == x.kept_sha256 for x in got_rows)
    assert {"lang", "source", "kept", "score"} <= set(out.columns)


def test_repeated_rows_and_empty_table(spark):
    same = docs_frame(spark, [(1, "a\nb"), (1, "a\nb"), (2, "a\nb")])
    assert sorted((x.doc_id, x.text) for x in line_dedup(same).collect()) == [(1, "a\nb"), (1, "a\nb"), (2, "")]
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_with_long(rows, long, run=2):
    """Units removed from each text: later runs, and later lines of at least ``long`` words."""
    seen, gone, texts = set(), [], [[x for x in (t or "").split("\n") if WORD.search(x)] for _, t in rows]
    for ls in texts:
        cut = set()
        for s in range(len(ls)):
            for key in [tuple(ls[s:s + run])] * (s + run <= len(ls)) + [(ls[s],)] * (len(WORD.findall(ls[s])) >= long):
                if key in seen:
                    cut.update(range(s, s + len(key)))
                seen.add(key)
        gone.append(cut)
    return gone


def test_a_long_line_goes_without_a_repeated_neighbour(spark):
    words = (lambda n, w: " ".join(f"{w}{k}" for k in range(n)))
    whole, under = words(LONG, "a"), words(LONG - 1, "b")
    rows = [(0, f"p\n{whole}\nq\n{under}"), (1, f"r\n{whole}\n\ns\n{under}\nt"), (2, whole), (3, under), (4, under),
            (5, f"u\n{whole}\nv\n{whole}\nw"), (6, f"x {whole}"), (7, f" {whole}"), (8, f"x {whole}")]
    got = {x.doc_id: x for x in line_dedup(docs_frame(spark, rows)).collect()}
    assert [got[i].n_removed for i in range(9)] == [0, 1, 1, 0, 0, 2, 0, 0, 1]
    assert got[1].text == f"r\n\ns\n{under}\nt" and got[2].text == "" and got[5].text == "u\nv\nw"
    assert all(x.n_removed == 0 for x in line_dedup(docs_frame(spark, rows), long=None).collect())


def test_runs_and_long_lines_together_as_in_brute_force(spark):
    r = random.Random(7)
    lines = ["alpha", "beta b", "gamma g g", "d e f g", "one two three four five", "  six seven\teight nine ten ", "x", ""]
    rows = [(i, "\n".join(r.choice(lines) + r.choice(["", "", f" {r.random()}"]) for _ in range(r.randint(1, 9))))
            for i in range(80)]
    out = {x.doc_id: x.n_removed for x in line_dedup(docs_frame(spark, rows), long=4).collect()}
    assert [out[i] for i in range(80)] == [len(g) for g in brute_with_long(rows, 4)]
