"""The stored fingerprint index: appends, replays, reopening, and a probe that does not shuffle it."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import fingerprint as fpo
from tessera.plans.q_pairs import l3_database_check
from tessera.sources.index import create_index, open_index

SCHEMA = "hash long, doc_id string, n_pos long, n_fp long"


@pytest.fixture
def path():
    return tempfile.mkdtemp(prefix="tessera-index-", dir="/tmp") + "/index"


def rows(index):
    return sorted(tuple(r) for r in index.rows().select("hash", "doc_id", "n_pos", "n_fp", "batch").collect())


def batch(spark, lo, hi, key):
    return spark.createDataFrame([(h % 40, f"{key}{h % 7}", 1 + h % 3, 50) for h in range(lo, hi)], SCHEMA)


def test_append_replay_take_back_and_reopen(spark, path):
    index = create_index(spark, path, buckets=4)
    assert rows(index) == [] and index.batches() == []
    one, two = batch(spark, 0, 60, "a"), batch(spark, 30, 90, "b")
    index.append(one, "2024-01")
    index.append(two, "2024-02")
    want = sorted([(*r, "2024-01") for r in one.collect()] + [(*r, "2024-02") for r in two.collect()])
    assert rows(index) == want
    index.append(two, "2024-02")
    assert rows(index) == want and index.batches() == ["2024-01", "2024-02"]
    again = open_index(spark, path)
    assert again.buckets == 4 and rows(again) == want
    index.take_back("2024-01")
    assert rows(open_index(spark, path)) == [r for r in want if r[-1] == "2024-02"]
    with pytest.raises(ValueError):
        index.append(one, "x' OR '1")
    with pytest.raises(Exception):
        create_index(spark, path)


def probe_plan(spark, index, new):
    df = index.probe(new)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def chains_above_scan(plan):
    """Operators between the index scan and the join, from the plan's tree."""
    lines = plan.split("== Initial Plan ==")[0].splitlines()
    at = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and "fingerprints_" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-|"))
    out, level = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < level:
            level = depth(x)
            if "Join" in x:
                return out
            out.append(x)
    raise AssertionError("no join above the index scan")


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_the_probe_does_not_shuffle_the_index(spark, path, broadcast):
    index = create_index(spark, path, buckets=8)
    for k in range(3):
        index.append(batch(spark, 10 * k, 10 * k + 40, f"r{k}"), f"b{k}")
    new = batch(spark, 0, 50, "new").withColumn("doc_id", F.col("hash") % 5)
    new = new.groupBy("hash", "doc_id").agg({"n_pos": "sum", "n_fp": "max"}).toDF("hash", "doc_id", "n_pos", "n_fp")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        plan = probe_plan(spark, index, new)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not any("Exchange" in x for x in chains_above_scan(plan)), plan
    stored = index.rows().select("hash", "doc_id", "n_pos", "n_fp")
    want = fpo.anchor_candidates(new, stored).collect()
    got = index.probe(new).collect()
    assert sorted((r.doc_id, r.repo_key, r.shared, r.covered_new, r.covered_repo, r.total_new) for r in got) == \
        sorted((r.orig_id, r.sub_id, r.shared, r.covered_a, r.covered_b, r.total_a) for r in want)


def test_document_frequency_is_counted_in_the_buckets(spark, path):
    index = create_index(spark, path, buckets=4)
    index.append(batch(spark, 0, 80, "a"), "one")
    freq = index.document_frequency()
    assert {r.hash: r.df for r in freq.collect()} == {
        h: sum(x % 40 == h for x in range(80)) for h in range(40)}
    assert "Exchange" not in freq._jdf.queryExecution().executedPlan().toString()


def test_database_check_reads_the_stored_index(spark, sf_small):
    plan = l3_database_check(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "fingerprints_" in plan and "Bucketed: true" in plan
