"""Every registered query: oracle parity (DuckDB) or a successful run, on the
smallest test tables; plus the flagship, streaming and partition invariance."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle import compare, duck
from tessera.plans import catalog

# the library's own queries; subpackages test theirs
QUERIES = dict(catalog.QUERIES)
ORACLES = dict(catalog.ORACLES)

# Physical operators no registered plan may contain: cartesian / nested-loop
# joins anywhere, Python stages outside the per-pair Arrow operators.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
PYTHON_OK = {"d3_lcs_similarity", "e11_greedy_tiling", "e11_text_tiles", "p5_variant_rewrite_loops"}


def _checked(name, fn):
    def build(spark, root):
        df = fn(spark, root)
        plan = df._jdf.queryExecution().executedPlan().toString()
        bad = [k for k in FORBIDDEN if k in plan]
        if name not in PYTHON_OK:
            bad += [k for k in ("ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas") if k in plan]
        assert not bad, f"{name}: {bad}"
        return df
    return build


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle_parity(spark, sf_small, con, name):
    problems, ns, nd = compare(spark, name, _checked(name, QUERIES[name]), ORACLES[name], sf_small, con)
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, sf_small, sf_check, name):
    # the smallest events hold no run of ten that two users share
    df = _checked(name, QUERIES[name])(spark, sf_check if name == "e11_greedy_tiling" else sf_small)
    assert df.count() > 0
    assert len(df.columns) > 0


def test_every_key_has_a_callable():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 100


def test_flagship_entry(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns[:2] == ["item_id", "doc_id"]
    assert all(r["orig_in_sub"] >= 0.5 for r in rows)


def test_stream_check_equals_batch(spark, sf_small):
    s = {(r["item_id"], r["doc_id"], r["covered_orig"]) for r in QUERIES["q1_stream_check"](spark, sf_small).collect()}
    b = {(r["item_id"], r["doc_id"], r["covered_orig"]) for r in QUERIES["e7_coverage"](spark, sf_small).collect()}
    assert s == b


def test_partition_count_invariance(spark, sf_small):
    q = QUERIES["e8_apply_metric"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = sorted(tuple(r) for r in q(spark, sf_small).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        eight = sorted(tuple(r) for r in q(spark, sf_small).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == eight
