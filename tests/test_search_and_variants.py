"""Exact vector search, matched negatives and separation, against plain versions."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import variants as va
from tessera.operators import vectors as vo


@pytest.mark.parametrize("block_bytes", [1, 700, 1 << 20])
def test_search_equals_plain_version(spark, block_bytes):
    rnd = np.random.default_rng(3)
    vecs = {k: [float(x) for x in rnd.normal(size=6)] for k in range(60)}
    vecs[60], vecs[61] = vecs[5], [0.0] * 6  # a copy, a zero vector
    rows = [(k, v) for k, v in vecs.items()] + [(70, [1.0, 2.0]), (71, None), (None, vecs[5]), (72, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r.id): r.cosine for r in vo.search_vectors(df, df.filter("vec_id % 5 = 0"), 0.4, block_bytes=block_bytes).collect()}
    want = {}
    for q, a in vecs.items():
        for i, b in vecs.items():
            if q % 5 or q == i or not any(a) or not any(b):
                continue
            c = float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
            if c >= 0.4:
                want[q, i] = c
    assert len(want) > 50 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert vo.search_vectors(df, df.limit(0), 0.4).count() == 0
    assert vo.search_vectors(df.limit(0), df, 0.4).count() == 0


def test_matched_negatives(spark):
    items = spark.createDataFrame([(1, 5, "a"), (2, 7, "b"), (3, 4, "c"), (4, 8, "d"), (5, 15, "d"), (6, 99, "e"), (7, 0, None)],
                                  "id long, n int, text string")
    got = {(r.id, r.other_id) for r in va.matched_negatives(items, "id", "n", "text").collect()}
    assert got == {(1, 2), (2, 3), (3, 1)}  # 4 and 5 have the same text, 6 and 7 are alone


def test_separation(spark):
    rows = [("m", True, 0.9), ("m", True, 0.5), ("m", False, 0.5), ("m", False, 0.1), ("one", True, 0.3)]
    s = spark.createDataFrame(rows, "method string, positive boolean, similarity double")
    got = {r.method: r for r in va.separation(s, ["method"]).collect()}
    m = got["m"]
    assert (m.n_positive, m.n_negative, m.auc) == (2, 2, 0.875)
    assert m.median_positive == pytest.approx(0.7) and m.gap == pytest.approx(0.4)
    assert got["one"].auc is None and got["one"].gap is None
