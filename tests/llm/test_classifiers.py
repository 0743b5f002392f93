from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import docs_frame
from tessera.llm import quality_fm as fm
from tessera.llm import vec
from tessera.llm.labelled import fold
from tessera.llm.quality_fm import fit_quality, score_quality
from tessera.llm.toxicity import STEP, WINDOW, MARKER, Savings, ToxicityModel, fit_toxicity, score_toxicity


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def labelled(spark):
    """Invented prose; toxic texts hold stems with varied endings, bad ones are shouted or repetitive."""
    r = random.Random(8)
    parts = ["an", "ther", "ion", "sel", "mo", "ra", "tin", "wo", "ble", "ead"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    rows, marks = [], []
    for i in range(900):
        w = [word() for _ in range(r.randint(30, 150))]
        toxic, good = int(r.random() < 0.25), int(r.random() > 0.3)
        if toxic:
            for _ in range(r.randint(3, 8)):
                w[r.randrange(len(w))] = r.choice(["quxzil", "vubkog"]) + r.choice(["", "a", "eth"])
        if not good:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x for x in w[:12] for _ in range(8)]
        rows.append((i, " ".join(w)))
        marks.append((i, good, toxic))
    rows += [(None, "no id"), (1000, None), (1001, ""), (1002, "x" * 500_000), (1003, rows[5][1]), (1003, rows[5][1])]
    labels = spark.createDataFrame([*marks, (None, 1, 1), (2000, None, None)], "doc_id long, quality int, toxic int")
    return rows, {i: (q, t) for i, q, t in marks}, labels


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_held_out_accuracy_and_defined_results(spark, labelled, kind):
    rows, truth, labels = labelled
    docs = docs_frame(spark, rows, extra=True)
    learn = fold(F.col("doc_id"), 3) != 1
    if kind == "toxic":
        out = score_toxicity(docs, fit_toxicity(docs, labels, learn))
    else:
        out = score_quality(docs, fit_quality(docs, labels, learn))
        assert {"text", "lang", "kept"} <= set(out.columns)
    got = out.withColumn("held", fold(F.col("doc_id"), 3) == 1).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)
    at = 1 if kind == "toxic" else 0
    assert auc([(x.score, truth[x.doc_id][at]) for x in got if x.held and x.doc_id in truth]) > 0.93
    assert len({x.score for x in got if x.doc_id == 1003}) == 1


def test_without_labels_or_rows(spark):
    docs = docs_frame(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    learn = F.lit(True)
    assert [x.score for x in score_toxicity(docs, fit_toxicity(docs, none, learn)).collect()] == [0.0, 0.0]
    assert [x.score for x in score_quality(docs, fit_quality(docs, none, learn)).collect()] == [1.0, 1.0]
    empty = docs.limit(0)
    assert score_toxicity(empty, fit_toxicity(empty, none, learn)).count() == 0


def test_windows_cover_every_byte_and_match_single_compression():
    import zstandard

    model = ToxicityModel(b"the quick brown fox jumps over the lazy dog " * 9, b"zorblax quibnort ", None)
    texts = ["", "short", "the quick zorblax jumps over " * 8, "q" * WINDOW, "z" * (WINDOW + 1)]
    buf, offs = next((b, o) for _, b, o in vec.text_arrays(pa.array(texts)))
    doc, saved = Savings(model)(buf, offs)
    want = []
    plain, both = (c for c in Savings(model).compressors)
    for k, t in enumerate(texts):
        n = len(t)
        starts = [0] if 0 < n <= WINDOW else list(range(0, n - WINDOW + STEP, STEP)) if n else []
        assert not starts or starts[-1] + WINDOW >= n
        want += [(k, len(plain.compress(MARKER + t[s:s + WINDOW].encode()))
                  - len(both.compress(MARKER + t[s:s + WINDOW].encode()))) for s in starts]
    assert list(zip(doc.tolist(), saved.tolist())) == want
    assert max(s for k, s in want if k == 2) > 0 and zstandard is not None


def test_sum_of_squares_identity_equals_all_pairs():
    r = np.random.default_rng(0)
    size = fm.BUCKETS + len(fm.STATS) * fm.BINS
    model = fm.FMModel(np.sort(r.normal(size=(len(fm.STATS), fm.BINS - 1)), axis=1), 0.3, r.normal(size=size),
                       r.normal(size=(size, fm.RANK)))
    texts = ["a b a", "", "Big! #1\nline"]
    buf, offs = next((b, o) for _, b, o in vec.text_arrays(pa.array(texts)))
    t, f, x = fm.entries(*fm.describe(buf, offs), model.edges)
    got, _ = fm.raw_scores(model, t, f, x, 3)
    for d in range(3):
        k = np.flatnonzero(t == d)
        pairs = sum(model.factors[f[i]] @ model.factors[f[j]] * x[i] * x[j] for n, i in enumerate(k) for j in k[:n])
        assert got[d] == pytest.approx(model.bias + model.weight[f[k]] @ x[k] + pairs)
