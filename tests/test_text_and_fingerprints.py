"""Worked examples and properties for lexing, normalisation, k-grams and winnowing."""

from __future__ import annotations

import os
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fixtures import LOOP_SUM, LOOP_SUM_NOISE, LOOP_SUM_RENAMED
from tessera.functions import text as tx
from tessera.functions.hashing import kgram_hashes, winnow
from tessera.operators import fingerprint as fpo
from tessera.operators.exact import _lcs_length
from tessera.session import cut_lineage


def _rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_renamed_loop_identical_after_normalisation(spark):
    df = _rows(spark, [LOOP_SUM, LOOP_SUM_RENAMED])
    norm = df.select("doc_id", F.array_join(tx.normalize_tokens(tx.tokenize(tx.strip_noise("text")), "generic"), " ")
                     .alias("n")).orderBy("doc_id").collect()
    assert norm[0]["n"] == norm[1]["n"]
    raw = df.select(F.array_join(tx.tokenize("text"), " ").alias("r")).collect()
    assert raw[0]["r"] != raw[1]["r"]


def test_strip_noise_keeps_string_literals(spark):
    df = _rows(spark, ['String u = "http://x.org"; // gone\n/* block */ int a = 1;'])
    out = df.select(tx.strip_noise("text").alias("s")).first()["s"]
    assert out == 'String u = "http://x.org"; int a = 1;'


def test_tokenizer_pieces(spark):
    df = _rows(spark, ["if (a <= 10 && b != 'c') x += 3.5;"])
    toks = df.select(tx.tokenize("text").alias("t")).first()["t"]
    assert toks == ["if", "(", "a", "<=", "10", "&&", "b", "!=", "'c'", ")", "x", "+=", "3.5", ";"]


def test_typed_and_keep_ids_modes(spark):
    df = _rows(spark, ['int x = 4; double y = 2.5; s = "a";'])
    typed = df.select(tx.normalize_tokens(tx.tokenize("text"), "typed").alias("t")).first()["t"]
    assert typed == ["int", "IDF", "=", "INT", ";", "double", "IDF", "=", "FLT", ";", "IDF", "=", "STR", ";"]
    keep = df.select(tx.normalize_tokens(tx.tokenize("text"), "keep_ids").alias("t")).first()["t"]
    assert keep[:4] == ["int", "x", "=", "LIT"]


def _winnow_py(h, w):
    """Reference implementation: rightmost minimum per full window."""
    if not h:
        return []
    if len(h) < w:
        m = min(h)
        return [max(i for i, x in enumerate(h) if x == m)]
    out = []
    for j in range(len(h) - w + 1):
        win = h[j:j + w]
        m = min(win)
        p = j + max(i for i, x in enumerate(win) if x == m)
        if p not in out:
            out.append(p)
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=6), max_size=30), st.integers(min_value=1, max_value=6))
def test_winnow_matches_reference(spark, hs, w):
    df = spark.createDataFrame([(hs,)], "h array<long>")
    got = df.select(winnow("h", w).alias("f")).first()["f"]
    assert [r["pos"] for r in got] == _winnow_py(hs, w)
    assert [r["hash"] for r in got] == [hs[p] for p in _winnow_py(hs, w)]


def test_short_sequences(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "t array<string>")
    r = df.select(F.size(kgram_hashes("t", 5)).alias("n")).collect()
    assert [x["n"] for x in r] == [0, 0]


@settings(max_examples=10, deadline=None)
@given(st.integers(min_value=0, max_value=10_000))
def test_winnow_guarantee(spark, seed):
    """Any shared run of >= k + w - 1 tokens shares at least one fingerprint."""
    rnd = random.Random(seed)
    k, w = 3, 4
    vocab = [f"w{i}" for i in range(50)]
    common = [rnd.choice(vocab) for _ in range(k + w - 1)]
    a = [rnd.choice(vocab) for _ in range(rnd.randint(0, 20))] + common + [rnd.choice(vocab) for _ in range(5)]
    b = [rnd.choice(vocab) for _ in range(rnd.randint(0, 20))] + common
    df = spark.createDataFrame([(0, a), (1, b)], "doc_id long, tokens array<string>")
    fp = fpo.fingerprints(df, k=k, w=w)
    hashes = {r["doc_id"]: {x["hash"] for x in r["fp"]} for r in fp.collect()}
    assert hashes[0] & hashes[1]


def test_self_similarity_and_symmetry(spark):
    df = spark.createDataFrame([(0, LOOP_SUM), (1, LOOP_SUM), (2, LOOP_SUM_NOISE)], "doc_id long, text string")
    toks = df.select("doc_id", tx.normalize_tokens(tx.tokenize("text")).alias("tokens"))
    dh = fpo.doc_hashes(fpo.fingerprint_index(fpo.fingerprints(toks, k=5, w=4)))
    p = fpo.candidate_pairs(dh)
    for m in ("max", "avg", "product", "combined"):
        p = fpo.apply_metric(p, m, m)
    rows = {(r["doc_a"], r["doc_b"]): r for r in p.collect()}
    assert rows[(0, 1)]["combined"] == 1.0
    noisy = rows[(0, 2)]
    assert 0 < noisy["combined"] < 1
    for r in rows.values():
        for m in ("max", "avg", "product", "combined"):
            assert 0.0 <= r[m] <= 1.0


def test_noise_breaks_runs_and_merging_recovers(spark):
    """Two noise statements break the token run; gap merging joins the pieces."""
    from tessera.operators import runs as ro

    df = spark.createDataFrame([(0, LOOP_SUM), (1, LOOP_SUM_NOISE)], "doc_id long, text string")
    toks = df.select("doc_id", tx.normalize_tokens(tx.tokenize(tx.strip_noise("text"))).alias("tokens"))
    g = ro.grams_from_tokens(toks, 4)
    runs = ro.maximal_runs(ro.seeds(g.filter("doc_id = 0"), g.filter("doc_id = 1")), 4)
    long_runs = runs.filter("len >= 8")
    assert long_runs.count() == 2  # the loop run is cut in two by the noise
    merged = ro.merge_matches(runs, max_gap=20, min_len=8).collect()  # 11 noise tokens + cut 4-grams
    assert len(merged) == 1 and merged[0]["n_runs"] == 2


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25))
def test_lcs_matches_dynamic_programming(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
    assert _lcs_length(a, b) == dp[len(a)][len(b)]


# ------------------------------------------------- what fingerprint tables cost on disk

def _exchanges(df):
    return str(df._jdf.queryExecution().executedPlan()).count("Exchange")


def test_document_fingerprints_are_counted_without_a_shuffle(spark):
    words = [f"w{i % 7}" for i in range(40)]
    rows = [(1, "a", words), (2, "a", words[3:]), (3, None, ["x"]), (None, "b", words[:9]), (4, "b", None)]
    toks = spark.createDataFrame(rows, "doc_id int, lang string, tokens array<string>")
    for w, hash_fn in ((1, "xxhash64"), (4, "md5")):
        fp = fpo.fingerprints(toks, k=5, w=w, hash_fn=hash_fn, keep=("lang",))
        made = fpo.doc_hash_rows(fp, ("lang",))
        assert _exchanges(made) == 0
        want = fpo.doc_hashes(fpo.fingerprint_index(fp, ("lang",)), ("lang",)).select(*made.columns)
        assert made.count() > 7 and sorted(map(str, made.collect())) == sorted(map(str, want.collect()))


def test_rows_of_one_id_are_one_document(spark):
    words = [f"w{i % 7}" for i in range(20)]
    rows = [(1, words), (1, words[2:12]), (2, words), (None, words), (None, words[5:]), (3, words[:4])]
    fp = fpo.fingerprints(spark.createDataFrame(rows, "doc_id int, tokens array<string>"), k=5, w=1)
    made = fpo.doc_hash_rows(fp)
    want = fpo.doc_hashes(fpo.fingerprint_index(fp)).select(*made.columns)
    assert sorted(map(str, made.collect())) == sorted(map(str, want.collect()))


def test_fingerprints_are_shuffled_once_to_learn_which_are_shared(spark):
    reps = spark.range(100).selectExpr("id % 30 AS hash", "id AS doc_id", "1L AS n_pos", "3L AS n_fp")
    plan = str(fpo.shared_fingerprints(reps, 0.3)._jdf.queryExecution().executedPlan())
    assert plan.count("Exchange hashpartitioning(hash") == 1 and "Join" not in plan


def test_a_cut_table_is_small_and_leaves_no_shuffle(spark):
    df = spark.range(200_000, numPartitions=4).selectExpr("xxhash64(id) AS hash", "id AS doc_id", "1L AS n_pos", "400L AS n_fp")
    cut = cut_lineage(df)
    files = [f.removeprefix("file:") for f in cut.inputFiles()]
    assert 0 < sum(map(os.path.getsize, files)) < 14 * 200_000  # a checkpoint of rows takes more than 40 bytes each
    assert [(f.name, f.dataType) for f in cut.schema] == [(f.name, f.dataType) for f in df.schema]
    assert cut.exceptAll(df).isEmpty() and df.exceptAll(cut).isEmpty()


def test_batches_pick_the_fingerprints_of_the_expressions(spark):
    rng = random.Random(5)
    rows = [(i, "en", [rng.choice(["a", "b", "c", "d é", "x\x1fy", ""]) for _ in range(n)])
            for i, n in enumerate([0, 1, 4, 5, 6, 7, 8, 9, 12, 200, 3000])]
    rows += [(20, None, None), (21, "en", ["a", None, "b", "c", None, "d", "e", "a", "b"]), (22, "de", [None] * 7),
             (None, "de", ["a"] * 40), (9, "en", ["a", "b"] * 9)]
    df = spark.createDataFrame(rows, "doc_id int, lang string, tokens array<string>").repartition(3)
    for k, w in ((5, 4), (5, 1), (1, 3), (2, 9)):
        hashed = df.select("doc_id", "lang", kgram_hashes("tokens", k, "md5").alias("h"))
        plain = hashed.select("lang", "doc_id", F.size("h").cast("long").alias("n_kgrams"), winnow("h", w).alias("fp"))
        plain = plain.withColumn("n_fp", F.size("fp").cast("long"))
        made = fpo.fingerprints(df, k=k, w=w, hash_fn="md5", keep=("lang",))
        assert made.columns == plain.columns
        assert sorted(map(repr, made.collect())) == sorted(map(repr, plain.collect())), (k, w)


def test_a_filter_does_not_fingerprint_twice(spark):
    df = spark.createDataFrame([(1, list("abcdefgh"))], "doc_id int, tokens array<string>")
    fp = fpo.fingerprints(df, k=5, w=4, hash_fn="md5").filter("n_fp > 0").select("doc_id", F.size("fp").alias("n"))
    plan = fp._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "md5(" not in plan, plan
    ids = fpo.doc_hash_rows(fpo.fingerprints(df, hash_fn="md5"), docs=df)
    assert sorted(r.n_fp for r in ids.collect()) and ids._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
