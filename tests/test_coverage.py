"""Covered pairs against all pairs of plain sets, and the whole job of E8."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import coverage as cv
from tessera.operators import fingerprint as fpo
from tessera.plans.catalog import QUERIES
from test_families import SCHEMA, random_docs, rows_of


def plain_pairs(docs, threshold, metric):
    out = {}
    for a in docs:
        for b in docs:
            (la, x), (lb, y) = docs[a], docs[b]
            both = x.keys() & y.keys()
            if a < b and la == lb and both:
                ca, cb, ta, tb = sum(x[h] for h in both), sum(y[h] for h in both), sum(x.values()), sum(y.values())
                if {"max": max(ca / ta, cb / tb), "combined": (ca + cb) / (ta + tb)}[metric] >= threshold:
                    out[a, b] = (la, len(both), ca, cb, ta, tb)
    return out


@pytest.mark.parametrize("seed,metric,block_bytes", [(1, "max", 400), (2, "combined", 400), (3, "max", 1 << 20), (4, "combined", 900)])
def test_covered_pairs_equal_all_pairs(spark, seed, metric, block_bytes):
    docs = random_docs(seed)
    reps = spark.createDataFrame(rows_of(docs), SCHEMA).withColumn("class_size", F.col("doc_id") + 1)
    out = cv.covered_pairs(cv.bundled_fingerprints(reps, ("lang",)), 0.3, ("lang",), metric == "combined", block_bytes,
                           most=200)  # many tiles and slices
    got = {(r.doc_a, r.doc_b): r for r in fpo.apply_metric(out, metric, "s").filter("s >= 0.3").collect()}
    want = plain_pairs(docs, 0.3, metric)
    assert {k: (r.lang, r.shared, r.covered_a, r.covered_b, r.total_a, r.total_b) for k, r in got.items()} == want
    assert all((r.size_a, r.size_b) == (a + 1, b + 1) for (a, b), r in got.items())


def test_fingerprints_with_the_same_holders_are_one_row_and_no_pair_is_joined(spark):
    """20 texts share 200 fingerprints: before, each of 190 pairs was joined to all 200."""
    docs = {i: ("x", {**dict.fromkeys(range(200), 1 + i % 2), 1000 + i: 5}) for i in range(20)}
    reps = spark.createDataFrame(rows_of(docs), SCHEMA).withColumn("class_size", F.lit(1).cast("long"))
    assert [(r.n_hash, r.n_pos) for r in cv.bundled_fingerprints(reps).orderBy("doc_id").collect()] == [
        (200, 200 + 200 * (i % 2)) for i in range(20)]
    out = fpo.representative_pairs(reps, 0.3, metric="max")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 190


def test_rows_without_an_id_or_scope_are_in_no_pair(spark):
    rows = [(h, d, 1, 6, lang) for d, lang in ((1, None), (2, None), (None, "x"), (3, "x"), (4, "x")) for h in range(6)]
    reps = spark.createDataFrame(rows, SCHEMA).withColumn("class_size", F.lit(1).cast("long"))
    assert [(r.doc_a, r.doc_b) for r in fpo.representative_pairs(reps, 0.3, ("lang",)).collect()] == [(3, 4)]
    assert fpo.representative_pairs(reps.filter("false"), 0.3).count() == 0


def test_e8_reports_the_pairs_of_copies(spark, tmp_path):
    """Before, only the lowest document of a text was in a pair."""
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(1000)}" for _ in range(40)]
    near = [*base[:30], *[f"v{k}" for k in range(10)]]
    texts = [(1, base), (2, near), (3, base), (4, near), (5, [f"z{k}" for k in range(20)])]
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    every = {(r.doc_a, r.doc_b): r.max_sim for r in QUERIES["e8_apply_metric"](spark, str(tmp_path)).collect()}
    assert set(every) == {(a, b) for a in range(1, 5) for b in range(a + 1, 5)}
    assert every[1, 3] == every[2, 4] == 1.0 and every[2, 3] == every[1, 2] < 1.0
    heads = QUERIES["e8_apply_metric_max"](spark, str(tmp_path)).collect()
    assert [(r.doc_a, r.doc_b) for r in heads] == [(1, 2)]
