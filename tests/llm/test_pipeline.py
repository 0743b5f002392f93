"""Every pipeline stage against a brute-force version (1000 documents)."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline as cp
from helpers import WORD
from test_decontaminate import brute as brute_contamination
from test_minhash import brute as brute_near
from test_minhash import shingles
from test_small_operators import fill
from tessera.llm.common import read
from tessera.llm.line_dedup import LONG


def test_stages(spark, sf_check):
    docs = read(spark, sf_check, "documents")
    given = {r.doc_id: r for r in docs.collect()}
    step, rows = docs, []
    for name, stage in cp.STAGES:
        out = stage(spark, step, sf_check)
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
        step = spark.createDataFrame(out.collect(), out.schema)
        rows.append(step.collect())
    quality, lines, near, clean, mixed = rows

    labels = {r.doc_id: r.quality for r in read(spark, sf_check, "labels").collect()}
    kept = {r.doc_id for r in quality}
    assert all(r == given[r.doc_id] for r in quality)
    good = [i for i in given if labels.get(i) == 1]
    bad = [i for i in given if labels.get(i) == 0]
    assert sum(i in kept for i in good) >= 0.9 * len(good) and sum(i in kept for i in bad) <= 0.5 * len(bad)

    seen, want = set(), {}
    for r in sorted(quality, key=lambda x: x.doc_id):
        ls = (r.text or "").split("\n")
        unit = [p for p, x in enumerate(ls) if WORD.search(x)]
        gone = set()
        for k, a in enumerate(unit):
            runs = [unit[k:k + 2]] * (k + 1 < len(unit)) + [[a]] * (len(WORD.findall(ls[a])) >= LONG)
            for run in runs:
                if tuple(ls[p] for p in run) in seen:
                    gone.update(run)
                seen.add(tuple(ls[p] for p in run))
        if not unit or len(gone) < len(unit):
            want[r.doc_id] = "\n".join(x for p, x in enumerate(ls) if p not in gone)
    assert {r.doc_id: r.text for r in lines} == want
    assert all(r.n_chars == len(r.text) for r in lines)

    assert all(WORD.search(r.text) for r in lines if WORD.search(given[r.doc_id].text or ""))
    groups = brute_near([(r.doc_id, r.text) for r in lines], 80)
    assert sorted(str(r.doc_id) for r in near) == sorted(i for i, _, c in groups if i == c)

    items = [(r.item_id, r.text) for r in read(spark, sf_check, "benchmark").collect()]
    found = brute_contamination([(r.doc_id, r.text) for r in near], items, 13)
    assert sorted(str(r.doc_id) for r in clean) == sorted(i for i, *_, dirty in found if not dirty)

    sizes = {}
    for r in clean:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text))
    goal = fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))})
    for s in sizes:
        assert abs(sum(r.taken for r in mixed if r.source == s) - goal[s]) < 1.001
    assert sorted(r.doc_id for r in mixed) == sorted(r.doc_id for r in clean)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, n_removed string"


def texts():
    word = (lambda n, w: " ".join(f"{w}{k}" for k in range(n)))
    return [(1, None), (2, ""), (3, word(60, "a")), (4, word(60, "a")), (5, f"{word(60, 'a')}\nown words here"),
            (6, word(40, "b")), (6, word(40, "b")), (7, word(40, "b") + " tail"), (8, "x\ny"), (9, "x\ny"),
            (None, word(40, "c")), (10, "short line\nkeeps"), (10, "another text of the same id")]


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_every_stage_takes_nulls_empty_and_repeated_rows_and_clashing_names(spark, sf_small, name):
    stage = dict(cp.STAGES)[name]
    rows = [(i, t, None if i == 8 else "en", None if i in (3, 8) else "s", None, 1, "x") for i, t in texts()]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = stage(spark, docs, sf_small)
    assert name == cp.STAGES[-1][0] or out.columns == cp.COLUMNS
    got = out.collect()
    assert len(got) <= len(rows)
    assert stage(spark, docs.filter("false"), sf_small).count() == 0
    if name == "line_dedup":
        assert {r.doc_id: r.text for r in got if r.doc_id in (1, 2, 3, 5, 8)} == {
            1: "", 2: "", 3: texts()[2][1], 5: "own words here", 8: "x\ny"}
        assert not {4, 9} & {r.doc_id for r in got}  # nothing of their own is left
        assert len(got) == len(rows) - 2
    if name == "minhash_near_dedup":
        assert Counter(r.doc_id for r in got) == Counter([1, 2, 3, 6, 8, None, 10, 10])
        assert {r.n_chars for r in got} == {None}


def test_near_copies_from_similarity_four_fifths_on(spark, sf_small):
    base = [f"w{k}" for k in range(104)]                      # 100 shingles
    changed = base[:52] + ["other"] * 1 + base[53:]             # 5 shingles of 100 differ
    far = base[:20] + ["p"] + base[21:60] + ["q"] + base[61:90] + ["r"] + base[91:]  # 15 of 100 differ
    rows = [(i, " ".join(t), "en", "s", 1, 1, "x") for i, t in ((1, base), (2, changed), (3, far))]
    got = {r.doc_id for r in cp.near_copies(spark, spark.createDataFrame(rows, SCHEMA), sf_small).collect()}
    share = (lambda a, b: len(shingles(" ".join(a)) & shingles(" ".join(b))) / len(shingles(" ".join(a)) | shingles(" ".join(b))))
    assert share(base, changed) >= 0.8 > share(base, far) and got == {1, 3}
