"""Evaluation operators against brute force (properties, edge rows of FIXTURES.md)."""

from __future__ import annotations

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import evaluate as ev
from tessera.operators import search as so

SCHEMA = "run_name string, case string, level string, submission_id string, similarity double, is_plagiarized boolean"


def _brute(scores, labels, t):
    tp = sum(1 for s, y in zip(scores, labels) if s >= t and y)
    fp = sum(1 for s, y in zip(scores, labels) if s >= t and not y)
    tn = sum(1 for s, y in zip(scores, labels) if s < t and not y)
    fn = sum(1 for s, y in zip(scores, labels) if s < t and y)
    return tp, fp, tn, fn


def _auc_brute(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    if not pos or not neg:
        return None
    num = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return num / (len(pos) * len(neg))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.0, 0.25, 0.5, 0.75, 1.0]), st.booleans()), min_size=1, max_size=40))
def test_confusion_auc_against_brute_force(spark, rows):
    df = spark.createDataFrame([("r", "c", "L1", f"{i:02d}", s, y) for i, (s, y) in enumerate(rows)], SCHEMA)
    scores, labels = [s for s, _ in rows], [y for _, y in rows]
    c = ev.confusion(ev.predict(df, 0.5), ["run_name"]).first()
    assert (c["tp"], c["fp"], c["tn"], c["fn"]) == _brute(scores, labels, 0.5)  # inclusive threshold
    a = ev.auc(df, ["run_name"]).first()["auc"]
    b = _auc_brute(scores, labels)
    assert (a is None and b is None) or abs(a - b) < 1e-12


def test_metrics_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0, 5, 0), (3, 0, 0, 0)], "tp long, fp long, tn long, fn long")
    m = ev.with_metrics(df).collect()
    assert m[0]["precision"] == 0.0 and m[0]["f1"] == 0.0 and m[0]["mcc"] == 0.0
    assert m[1]["precision"] == 1.0 and m[1]["recall"] == 1.0 and m[1]["mcc"] == 0.0


def test_group_metrics_empty_level_and_one_class(spark):
    rows = [("r", "c1", "L1", "01", 0.9, True), ("r", "c1", "non-plag", "02", 0.1, False),
            ("r", "c2", "L2", "03", 0.4, True)]
    df = spark.createDataFrame(rows, SCHEMA)
    runs = spark.createDataFrame([("r", 0.5)], "run_name string, threshold double")
    gm = {(r["group_type"], r["group_value"]): r for r in ev.group_metrics(df, runs).collect()}
    empty = gm[("level", "L6")]
    assert (empty["tp"], empty["fp"], empty["tn"], empty["fn"]) == (0, 0, 0, 0)
    assert empty["f1"] is None and empty["auc"] is None
    assert gm[("level", "L1")]["auc"] is None  # one class: undefined
    assert gm[("all", "all")]["auc"] == 1.0


def test_degenerate_rules(spark):
    runs = spark.createDataFrame([("a", "T", 1, 5, 0, 4, 0.5, 1), ("b", "T", 3, 5, 2, 0, 0.4, 2),
                                  ("a2", "T", 3, 0, 2, 1, 0.9, 3)],
                                 "run_name string, tool string, tp long, fp long, tn long, fn long, mcc double, run_ord int")
    assert {r["run_name"] for r in ev.prune_degenerate(runs).collect()} == {"b"}
    assert {r["run_name"] for r in so.degenerate_report(runs).collect()} == {"a", "b"}


def test_best_run_skips_nan_and_breaks_ties_by_order(spark):
    runs = spark.createDataFrame([("T", "x", 1, 1, 1, 1, float("nan"), 1), ("T", "y", 1, 1, 1, 1, 0.3, 3),
                                  ("T", "z", 1, 1, 1, 1, 0.3, 2)],
                                 "tool string, run_name string, tp long, fp long, tn long, fn long, mcc double, run_ord int")
    assert ev.best_run_per_tool(runs).first()["run_name"] == "z"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(min_value=0, max_value=1, allow_nan=False), min_size=1, max_size=30))
def test_threshold_sweep_matches_brute_force(spark, scores):
    labels = [i % 3 == 0 for i in range(len(scores))]
    df = spark.createDataFrame([("r", "c", "L1", str(i), s, y) for i, (s, y) in enumerate(zip(scores, labels))], SCHEMA)
    sw = {round(r["threshold"], 6): r for r in ev.threshold_sweep(df, ["run_name"], steps=20).collect()}
    assert len(sw) == 21
    for i in range(21):
        r = sw[round(i / 20.0, 6)]
        assert (r["tp"], r["fp"], r["tn"], r["fn"]) == _brute(scores, labels, i / 20.0)


def test_recall_monotone_in_threshold(spark):
    rows = [("r", "c", "L1", str(i), (i * 37 % 100) / 100, i % 2 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    sw = ev.threshold_sweep(df, ["run_name"], 10).orderBy("threshold").collect()
    rec = [r["recall"] for r in sw]
    assert all(a >= b for a, b in zip(rec, rec[1:]))


def test_auc_invariant_to_monotone_transform(spark):
    rows = [("r", "c", "L1", str(i), (i * 13 % 17) / 17, i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    a = ev.auc(df, ["run_name"]).first()["auc"]
    b = ev.auc(df.withColumn("similarity", F.sqrt("similarity")), ["run_name"]).first()["auc"]
    assert abs(a - b) < 1e-12


def test_erf_polynomial_accuracy(spark):
    xs = [-3.0, -1.2, -0.3, 0.0, 0.4, 1.0, 2.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r["e"] for r in df.select(so.erf(F.col("x")).alias("e")).collect()]
    for x, g in zip(xs, got):
        assert abs(g - math.erf(x)) < 2e-7


def test_parameter_grid(spark):
    from itertools import product

    from tessera.operators import search as so

    dims = {"m": ["x", "y"], "t": [0.05, 0.29, 0.57], "k": [3, 5], "on": [True, False]}
    tried = spark.createDataFrame([("x", 0.29000000001, 5, True), ("y", 0.05, 3, False), ("y", 0.05, 3, False), ("z", 0.05, 3, True),
                                   (None, 0.05, 3, True)], "m string, t double, k int, on boolean")
    want = set(product(*dims.values())) - {("x", 0.29, 5, True), ("y", 0.05, 3, False)}
    rows = [tuple(r) for r in so.parameter_grid(dims, tried).collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert so.parameter_grid({**dims, "k": []}, tried).count() == 0
    assert so.parameter_grid({**dims, "k": [3, 3, 5]}, tried).count() == len(want)
    assert so.parameter_grid(dims, tried.limit(0)).count() == 24


def test_unrounded_scores_in_many_ranges(spark):
    """One run with all scores, cut into ranges: AUC, ROC and quantiles equal the plain operators', ties and nulls included."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [("big", "c", "L1", str(i), float(s), bool(y)) for i, (s, y) in enumerate(zip(rng.random(4000), rng.random(4000) < 0.3))]
    rows += [("big", "c", "L1", f"t{i}", 0.5, i % 2 == 0) for i in range(900)]  # one score holds a sixth of the run
    rows += [("one", "c", "L1", "a", 0.25, True), ("one", "c", "L1", "b", 0.75, True), (None, "c", "L1", "c", 0.1, True),
             (None, "c", "L1", "d", 0.2, False)]
    holes = [("big", "c", "L1", "x", None, True), ("big", "c", "L1", "y", 0.4, None), ("void", "c", "L1", "z", None, False)]
    df, whole = spark.createDataFrame(rows + holes, SCHEMA), spark.createDataFrame(rows, SCHEMA)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        c = ev.running_counts(df, ["run_name"]).select("*", F.spark_partition_id().alias("task")).collect()
        assert max(sum(r.task == t for r in c) for t in {r.task for r in c}) < len(c)
        got = {r.run_name: r for r in ev.auc_unrounded(df, ["run_name"]).collect()}
        roc = {tuple(r) for r in ev.roc_curve_unrounded(df, ["run_name"]).collect()}
        q = {(r.run_name, r.is_plagiarized): r for r in ev.class_quantiles(df, ["run_name"], (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    want = {r.run_name: r.auc for r in ev.auc(whole, ["run_name"]).collect()}
    assert set(got) == {"big", "one", None} == set(want)
    assert all(got[k].auc == want[k] for k in want) and got["one"].auc is None and got[None].auc == 0.0
    assert roc == {tuple(r) for r in ev.roc_curve(whole, ["run_name"]).collect()}
    for (run, y), r in q.items():
        xs = [x[4] for x in rows if x[0] == run and x[5] == y]
        assert r.n == len(xs)
        assert np.allclose(list(r)[3:], np.quantile(xs, (0.0, 0.25, 0.5, 0.9, 1.0)), atol=1e-12)
    assert len(q) == 5  # both classes of the first and the nameless run, one of the second
    assert ev.auc_unrounded(df.limit(0), ["run_name"]).count() == 0
    assert ev.class_quantiles(df.limit(0), ["run_name"]).count() == 0


def test_unrounded_auc_beyond_long(spark):
    """The numerator passes 2^63: 3 x 10^9 rows of each class in two scores (counts given, not rows)."""
    n = 3_000_000_000
    assert 2 * n * n > 2 ** 63
    h = spark.createDataFrame([("r", 0.1, 0, n, 0, 0, n, n), ("r", 0.9, n, 0, 0, n, n, n)],
                              "run_name string, similarity double, pos long, neg long, pos_below long, neg_below long, P long, N long")
    assert ev.auc_from_counts(h, ["run_name"]).first().auc == 1.0
