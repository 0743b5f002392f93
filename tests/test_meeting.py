"""H2, H6 and J1 against plain counts; blocks made small so that many of them meet."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.text import word_tokens
from tessera.operators import blocks as bo
from tessera.operators import vectors as vo


def test_windows_are_embedded_without_making_the_tokens_again(spark):
    texts = [(1, " ".join(f"w{k % 7}" for k in range(100))), (2, "one two two"), (3, ""), (4, None)]
    docs = spark.createDataFrame(texts, "doc_id int, text string").select("doc_id", word_tokens("text").alias("tokens"))
    got = vo.embed(vo.chunk(docs, 64, 32, keep=("doc_id",)), "tokens", 16)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.lower().count("sqrt(") == 1, plan
    rows = {(r.doc_id, r.window): r.embedding for r in got.collect()}
    assert sorted(rows) == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)]
    bucket = {r.w: r.b for r in spark.createDataFrame([(f"w{k}",) for k in range(7)] + [("one",), ("two",)], "w string")
              .select("w", F.pmod(F.xxhash64("w"), F.lit(16)).alias("b")).collect()}
    for (doc, window), vec in rows.items():
        words = (texts[doc - 1][1] or "").split()[window * 32:window * 32 + 62]
        want = np.bincount([bucket[w] for w in words], minlength=16).astype(float)
        assert vec == (want / (np.sqrt((want * want).sum()) or 1)).tolist()


def test_similar_vectors_are_all_found(spark):
    m = np.random.default_rng(5).normal(size=(120, 8)).astype("float32")
    rows = [(k, v.tolist()) for k, v in enumerate(m)]
    odd = [(200, [0.0] * 8), (201, None), (None, rows[0][1]), (202, rows[3][1][:4]), (7, rows[7][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(3)
    got = vo.similar_vectors(df, 0.3, block_bytes=500).collect()  # before, a null vector ended the job
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    cos = unit @ unit.T
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if cos[i, j] >= 0.3}
    assert len(got) == len(want) and {(r.id_a, r.id_b) for r in got} == want
    assert all(abs(r.cosine - cos[r.id_a, r.id_b]) < 1e-9 for r in got)


def test_overlaps_of_repeated_block_ids_are_all_found(spark):
    rng = np.random.default_rng(3)
    sets = [(f"b{k:03d}", [f"t{min(int(x), 60)}" for x in rng.zipf(1.4, rng.integers(0, 30))]) for k in range(90)]
    sets += sets[:20] + [("c000", sets[5][1]), (None, ["t1"]), ("c001", None)]
    df = spark.createDataFrame(sets, "block_id string, tokens array<string>")
    for theta in (0.25, 0.8):
        got = bo.overlap_candidates(df, theta, block_bytes=600)
        # before, a self-join on prefix tokens: pairs of blocks of one id twice were lost
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
        want = []
        for a, ta in sets:
            for b, tb in sets:
                if a is not None and b is not None and a < b and ta and tb:
                    sa, sb = set(ta), set(tb)
                    if len(sa & sb) >= max(1, theta * max(len(sa), len(sb))):
                        want.append((a, b, len(sa & sb), len(sa), len(sb)))
        assert sorted(map(tuple, got.collect())) == sorted(want)
