"""The registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle import compare, duck
from tessera.llm import queries

NAMES = {"op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13",
         "pipeline"}
REPORTS = {"quality_rule_ablation"}  # operator 6 over its stored ledger


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle_parity(spark, sf_small, con, name):
    problems, ns, nd = compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], sf_small, con)
    assert not problems and ns == nd


def test_entry_has_every_operator_and_the_pipeline():
    assert {q.split("_")[0] for q in queries.QUERIES if q not in REPORTS} == NAMES
    assert REPORTS <= set(queries.ORACLES)
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())
