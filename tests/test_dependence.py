"""F4 on generated scripts: edges of both kinds, next to the generator's own record and to the SQL."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest

from fixtures import LOOP_SUM
from tessera.operators import structure as st
from tessera.operators.tokens import token_positions
from tessera.plans import catalog


class Script:
    """A random nested script; ``control`` holds (keyword, its position, position of the statement)."""

    def __init__(self, rnd: random.Random):
        self.rnd, self.tokens, self.control = rnd, [], set()
        self.body(None, 3)

    def put(self, *tokens):
        self.tokens += tokens

    def here(self, by):
        if by is not None:
            self.control.add((*by, len(self.tokens)))

    def body(self, by, depth):
        for _ in range(self.rnd.randint(1, 4)):
            self.statement(by, depth)

    def statement(self, by, depth):
        kind = self.rnd.choice(["set", "call", "if", "while", "for", "plain"]) if depth else "set"
        self.here(by)
        name = self.rnd.choice("abc")
        if kind == "set":
            self.put(name, "=", self.rnd.choice("abc"), ";")
        elif kind == "call":
            self.put("run", "(", name, ",", "(", "a", ")", ")", ";")
        elif kind == "plain":  # a block that is no condition: its statements belong to what is around it
            self.put("method", "(", ")", "{")
            self.body(by, depth - 1)
            self.put("}")
        else:
            own = (kind, len(self.tokens))
            self.put(kind, "(", *(["a", "=", "b", ";", "b", ";", "c"] if kind == "for" else ["(", "a", ")", "<", "b"]), ")")
            if self.rnd.random() < 0.3:
                self.statement(own, 0)
            else:
                self.put("{")
                self.body(own, depth - 1)
                self.put("}")
                if kind == "if" and self.rnd.random() < 0.5:
                    self.here(by)
                    other = ("else", len(self.tokens))
                    self.put("else", "{")
                    self.body(other, depth - 1)
                    self.put("}")


def edges(spark, pages):
    """The edges of a whole token table, which must be those of the tokens chosen inside the rows."""
    df = spark.createDataFrame(pages, "doc_id long, text string")
    cols = ("doc_id", "kind", "var", "def_pos", "use_pos")
    whole, chosen = ([tuple(r) for r in st.dependence_edges(t).select(*cols).collect()]
                     for t in (token_positions(df), st.dependence_tokens(df)))
    data = [tuple(r) for r in st.flow_edges(st.data_tokens(df)).collect()]
    assert sorted(whole) == sorted(chosen)
    assert sorted(data) == sorted((d, *rest) for d, kind, *rest in whole if kind == "data")
    return set(whole)


@pytest.fixture(scope="module")
def scripts():
    return [Script(random.Random(seed)) for seed in range(40)]


def test_generated_scripts(spark, scripts):
    pages = [(k, " ".join(s.tokens)) for k, s in enumerate(scripts)]
    want = {(k, "control", *c) for k, s in enumerate(scripts) for c in s.control}
    for k, s in enumerate(scripts):
        last = {}
        for pos, token in enumerate(s.tokens):
            if not token.isidentifier() or pos + 1 == len(s.tokens):
                continue
            if s.tokens[pos + 1] == "=":
                last[token] = pos
            elif token in last:
                want.add((k, "data", token, last[token], pos))
    got = edges(spark, pages)
    assert len([e for e in want if e[1] == "control"]) > 200
    assert got == want


def test_generated_scripts_equal_the_sql(spark, scripts):
    pages = [(k, " ".join(s.tokens)) for k, s in enumerate(scripts)]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "html"]))
    rel = con.sql(catalog.ORACLES["f4_dependence_edges"])
    order = [rel.columns.index(c) for c in ("doc_id", "kind", "var", "def_pos", "use_pos")]
    assert {tuple(r[i] for i in order) for r in rel.fetchall()} == edges(spark, pages)


def test_odd_inputs(spark):
    """Brackets without partners open nothing; null and empty texts have no edges; repeated words are no conditions."""
    assert edges(spark, [(0, None), (1, ""), (2, "if ( a ) {"), (3, "} ) ; x"), (4, "if ( a { b ; }")]) == set()
    assert edges(spark, [(5, "if ( a ) b ; c ;")]) == {(5, "control", "if", 0, 4)}
    loop = {e for e in edges(spark, [(0, LOOP_SUM.replace("// accumulate", ""))]) if e[1] == "control"}
    assert len(loop) == 1 and next(iter(loop))[2] == "for"
