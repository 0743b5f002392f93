"""Rows-only operators on small fixtures: tiling, runs, trees, blocks, readers, sinks."""

from __future__ import annotations

import os
import random
import tempfile
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from fixtures import CYLINDER, LOOP_SUM, LOOP_SUM_NOISE, LOOP_SUM_WRAPPED
from tessera.functions import text as tx
from tessera.operators import fingerprint as fpo
from tessera.operators import runs as ro
from tessera.operators import structure as stc
from tessera.operators.tiling import _tile_pair, greedy_tiling
from tessera.operators.tokens import segment_blocks, token_positions
from tessera.sources import corpus, reports, sinks


def test_tiling_is_one_to_one_and_longest_first():
    # a run of 6 overlapping a run of 5 on the b side: only 6 + what is left
    runs = [(0, 0, 6), (10, 3, 5)]
    tiled, n = _tile_pair(runs, 3)
    assert (tiled, n) == (6, 1)  # remainder of the second run is b-positions 6..7: 2 < 3
    tiled, n = _tile_pair(runs, 2)
    assert (tiled, n) == (8, 2)


def test_gst_not_above_run_coverage(spark):
    a = "a b c d e f g h a b c d".split()
    b = "x a b c d e f y a b c d".split()
    df = spark.createDataFrame([(0, a), (1, b)], "doc_id long, tokens array<string>")
    g = ro.grams_from_tokens(df, 3)
    seeds = ro.seeds(g.filter("doc_id = 0"), g.filter("doc_id = 1"))
    cov = ro.run_coverage(seeds, 3).first()
    t = greedy_tiling(ro.maximal_runs(seeds, 3), 3).first()
    assert t["tiled"] <= min(cov["covered_a"], cov["covered_b"])
    assert cov["covered_a"] == 10 and cov["covered_b"] == 10  # [0..5] + [8..11] on both sides


def test_maximal_runs_brute_force(spark):
    a = "p q r s t u v".split()
    b = "r s t u z p q".split()
    df = spark.createDataFrame([(0, a), (1, b)], "doc_id long, tokens array<string>")
    g = ro.grams_from_tokens(df, 2)
    runs = {(r["start_a"], r["start_b"], r["len"]) for r in
            ro.maximal_runs(ro.seeds(g.filter("doc_id = 0"), g.filter("doc_id = 1")), 2).collect()}
    assert runs == {(2, 0, 4), (0, 5, 2)}


def test_wrapper_block_keeps_subtrees(spark):
    """Wrapping the body in an extra block: the loop's subtree still matches."""
    html = {0: "<div><ul><li>a</li><li>b</li></ul><p>x</p></div>",
            1: "<div><section><ul><li>a</li><li>b</li></ul><p>x</p></section></div>",
            2: "<div><ol><li>c</li></ol></div>"}
    df = spark.createDataFrame(list(html.items()), "page_id long, html string")
    tree = stc.nesting_tree(df)
    depth = {(r["doc_id"], r["tag"]): r["depth"] for r in tree.collect()}
    assert depth[(0, "ul")] == 1 and depth[(1, "ul")] == 2
    h = stc.subtree_hashes(tree)
    ul = {r["doc_id"]: r["hash"] for r in h.filter("tag = 'ul'").collect()}
    assert ul[0] == ul[1]
    sim = {(r["doc_a"], r["doc_b"]): r["similarity"] for r in stc.tree_similarity(h, threshold=0.01).collect()}
    # shared ul(3) + li + li + p = 6 of max(11, 17) size units; the unrelated page shares one li
    assert abs(sim[(0, 1)] - 6 / 17) < 1e-12 and sim[(0, 1)] > sim[(0, 2)]


def test_one_pass_hashes_are_those_of_the_levels(spark, sf_small):
    """hashed_trees gives the rows of subtree_hashes, on the given pages, broken markup, nulls and repeated rows."""
    given = spark.read.parquet(f"{sf_small}/pages.parquet").select("page_id", "html")
    own = [(-1, "<div></b></div></div><p>x</p><ul><li>a</li></ul>"), (-2, None), (-3, ""), (-4, "no tags"),
           (-5, "<p>a<p>b<table><tr><td>1<td>2<tr><td>3</table><img><br/>")]
    pages = given.unionByName(spark.createDataFrame(own, "page_id long, html string"))
    got = stc.hashed_trees(pages).select("doc_id", "node", "tag", "depth", "hash", "size")
    want = stc.subtree_hashes(stc.nesting_tree(pages)).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() > 1000
    assert stc.hashed_trees(pages.unionByName(pages)).count() == 2 * got.count()
    assert stc.hashed_trees(pages.limit(0)).count() == 0


def test_equal_hashes_mean_equal_trees_whatever_the_order_of_siblings(sf_small):
    """Against brute force over the given pages: a subtree's form is its tag and the sorted forms of its children."""
    import pyarrow.parquet as pq

    forms = {}
    for html in pq.read_table(f"{sf_small}/pages.parquet", columns=["html"]).column(0).to_pylist():
        tree = stc.element_tree(html)
        kids = {}
        for (node, tag, _, parent), (h, size) in zip(reversed(tree), reversed(stc.element_digests(tree))):
            form = (tag, tuple(sorted(kids.pop(node, []))))
            kids.setdefault(parent, []).append(form)
            assert forms.setdefault(h, form) == form
    assert len(set(forms.values())) == len(forms)


def test_a_tree_ten_thousand_deep_is_one_job(spark):
    pages = spark.createDataFrame([(1, "<span>" * 10000), (2, "<b>" + "<span>" * 9999)], "page_id long, html string")
    rows = stc.hashed_trees(pages).filter("size = 9999").collect()
    assert {r.doc_id for r in rows} == {1, 2} and len({r.hash for r in rows}) == 1


def test_broken_markup_keeps_every_node(spark):
    """Stray and unclosed tags, comments, deep nesting: no node is lost, none has a negative depth."""
    pages = [(0, "<div></b></div></div><p>x</p><ul><li>a</li></ul>"), (1, "<p>" * 70), (2, "<span>" * 100),
             (3, "<!-- <div> --><p>a<p>b<table><tr><td>1<td>2<tr><td>3</table></p>"), (4, None), (5, "")]
    tree = stc.nesting_tree(spark.createDataFrame(pages, "page_id long, html string"))
    rows = {}
    for r in sorted(tree.collect(), key=lambda x: (x.doc_id, x.node)):
        rows.setdefault(r.doc_id, []).append((r.tag, r.depth))
    assert rows[0] == [("div", 0), ("p", 0), ("ul", 0), ("li", 1)]
    assert rows[1] == [("p", 0)] * 70
    assert rows[2] == [("span", k) for k in range(100)]
    assert rows[3] == [("p", 0), ("p", 0), ("table", 0), ("tr", 1), ("td", 2), ("td", 2), ("tr", 1), ("td", 2)]
    assert stc.subtree_hashes(tree).count() == sum(map(len, rows.values()))


def test_a_text_copied_many_times_stays_visible(spark):
    """No frequency limit: thirty copies are one class, and near copies are found by their rare prefix."""
    from tessera.operators import fingerprint as fpo
    from tessera.operators import pairs as po

    base = [f"w{k}" for k in range(60)]
    docs = [(k, base) for k in range(30)] + [(100, [*base[:50], *[f"v{k}" for k in range(10)]]),
                                             (101, [f"z{k}" for k in range(60)])]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    dh = fpo.doc_hashes(fpo.fingerprint_index(fpo.fingerprints(df, k=5, w=1)))
    classes = {r.doc_id: (r.class_id, r.class_size) for r in fpo.text_classes(dh).collect()}
    assert all(classes[k] == (0, 30) for k in range(30)) and classes[101] == (101, 1)
    pairs = fpo.similar_pairs(dh, 0.5).collect()
    assert [(r.doc_a, r.doc_b, r.covered_a, r.size_a) for r in pairs] == [(0, 100, 46, 30)]
    edges = [(r.doc_a, r.doc_b) for r in pairs] + [(0, k) for k in range(1, 30)]
    found = po.clusters(spark.createDataFrame(edges, "doc_a long, doc_b long")).collect()
    assert {r.cluster for r in found} == {0} and len(found) == 31


def test_words_of_any_script_and_character_literals(spark):
    from tessera.functions import text as tx

    df = spark.createDataFrame([("Straße, Œuvre \u0416\u0443\u043a 42!", "char c = '\"'; // gone \"x")], "a string, b string")
    r = df.select(tx.word_tokens("a").alias("w"), tx.strip_noise("b").alias("n")).first()
    assert r.w == ["straße", "œuvre", "\u0436\u0443\u043a", "42"]
    assert r.n == "char c = '\"';"


def test_loops_keep_their_meaning():
    from tessera.operators.variants import rewrite_loops

    code = "for (int i = 0; i < 3; i++) { for(j=0;j<2;j++){ f(i, j); } g(); } for (;;) {"
    assert rewrite_loops(code) == ("int i = 0; while (i < 3) { j=0; while (j<2) { f(i, j); j++; } g(); i++; }"
                                   " for (;;) {")


def test_record_report_with_any_rule(spark, tmp_path):
    from tessera.sources import reports

    (tmp_path / "r.txt").write_text("head\n========== 1\nFile A: x\nFile B: y\nSimilarity A: 50\nSimilarity B: 0.2\n"
                                    "---------\nFile A: p = ===== q\nFile B: z\nSimilarity A: 1\nSimilarity B: 100\n")
    got = [tuple(r) for r in reports.read_record_report(spark, str(tmp_path)).collect()]
    assert got == [("x", "y", 0.5, 0.2), ("p", "z", 1.0, 1.0)]


def test_parent_links(spark):
    df = spark.createDataFrame([(0, "<html><head><meta charset='x'><title>t</title></head><body><p>a</p></body></html>")],
                               "page_id long, html string")
    t = {r["tag"]: r for r in stc.nesting_tree(df).collect()}
    assert t["html"]["parent"] is None
    assert t["title"]["parent"] == t["head"]["node"]
    assert t["p"]["parent"] == t["body"]["node"]
    assert t["meta"]["depth"] == 2


def test_segment_blocks_and_flow(spark):
    df = spark.createDataFrame([(0, LOOP_SUM), (1, LOOP_SUM_WRAPPED)], "doc_id long, text string")
    toks = token_positions(df)
    b = segment_blocks(toks)
    assert b.filter("doc_id = 0").count() == 3  # class, main, loop
    assert b.filter("doc_id = 1").count() == 4  # + wrapper
    edges = stc.flow_edges(toks.filter("doc_id = 0")).collect()
    assert any(e["var"] == "total" for e in edges)


def test_token_positions_lines(spark):
    df = spark.createDataFrame([(0, "a b\n\nc")], "doc_id long, text string")
    rows = [(r["pos"], r["line"], r["token"]) for r in token_positions(df).orderBy("pos").collect()]
    assert rows == [(0, 1, "a"), (1, 1, "b"), (2, 3, "c")]


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def _labelled_root(spark):
    root = tempfile.mkdtemp(prefix="tessera-labelled-", dir="/tmp")
    langs = ["en", "de", "fr", "es", "it", None]
    docs = [(i, langs[i % 6], f"text {i}\nline" if i else "") for i in range(40)]
    spark.createDataFrame(docs + [(7, "de", "second 7")], "doc_id long, lang string, text string").write.parquet(
        f"{root}/documents.parquet")
    labels = [(i, (0, 1, 1, None)[i % 4]) for i in range(36)] + [(7, 1), (None, 1), (39, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(i, f"item {i}") for i in range(9)], "item_id long, text string").write.parquet(
        f"{root}/benchmark.parquet")
    return root, docs + [(7, "de", "second 7")], labels


def test_a_text_is_one_file_and_nothing_beside_it(spark):
    root = tempfile.mkdtemp(prefix="tessera-texts-", dir="/tmp")
    texts = [f"text {i}\nof two lines" for i in range(50)] + [""]
    sinks.write_texts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), f"{root}/case-01/original")
    names = os.listdir(f"{root}/case-01/original")
    assert len([x for x in names if x.endswith(".txt")]) == len(texts)
    assert not [x for x in names if x.endswith(".crc")]  # a checksum file for each text doubles the files
    got = corpus.read_submissions(spark, root, "*.txt").collect()
    assert sorted(r["text"] for r in got) == sorted(t + "\n" for t in texts)


def test_a_folder_of_the_tree_is_made_from_its_own_texts(spark):
    from tessera.plans.q_sources import a1_read_submissions, labelled_texts

    root, docs, labels = _labelled_root(spark)
    case = {"en": 1, "de": 2, "fr": 3, "es": 4}
    want = Counter((text, case[lang], 0 if q == 0 else i % 6 + 1) for i, lang, text in docs for j, q in labels
                   if i == j and lang in case and q in (0, 1))
    dealt = labelled_texts(spark, root)
    assert Counter(tuple(r) for r in dealt.collect()) == want
    one = dealt.filter("n = 2 AND level = 2")
    assert Counter(r.text for r in one.collect()) == Counter({t: k for (t, n, v), k in want.items() if (n, v) == (2, 2)})
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "n#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "DataFilters: []" in plan
    tree = Counter((r["case"], r["level"]) for r in a1_read_submissions(spark, root).filter("role <> 'original'").collect())
    assert tree == _levels(want)


def _levels(want):
    out = Counter()
    for (_, n, level), k in want.items():
        out[f"case-0{n}", f"L{level}" if level else "non-plag"] += k
    return out


def test_read_submissions_tree(spark):
    root = tempfile.mkdtemp(prefix="tessera-corpus-", dir="/tmp")
    _write(f"{root}/case-01/original/T1.java", LOOP_SUM)
    _write(f"{root}/case-01/plagiarized/L3/03/T1.java", LOOP_SUM_NOISE)
    _write(f"{root}/case-01/non-plagiarized/07/A.java", CYLINDER)
    _write(f"{root}/case-01/non-plagiarized/07/B.java", CYLINDER)  # multi-file submission
    _write(f"{root}/case-02/plagiarized/L1/01/T2.java", LOOP_SUM)  # case without original
    _write(f"{root}/case-01/.hidden/x.java", "junk")
    subs = corpus.read_submissions(spark, root)
    rows = {(r["case"], r["role"], r["submission_id"], r["file_name"]): r for r in subs.collect()}
    assert ("case-01", "plagiarized", "03", "T1.java") in rows  # "03" stays a string
    assert rows[("case-01", "plagiarized", "03", "T1.java")]["level"] == "L3"
    assert rows[("case-01", "plagiarized", "03", "T1.java")]["key"] == "plag_L3_03"
    assert not any("hidden" in str(k) for k in rows)
    o, s = corpus.split_anchors(subs)
    assert o.count() == 1 and {r["case"] for r in s.collect()} == {"case-01"}
    merged = corpus.merge_files(subs.filter("role = 'non-plagiarized'"), "submission_id", "file_name", "text", "headers")
    m = merged.first()
    assert m["n_files"] == 2 and "// --- FILE: A.java ---" in m["text"]
    try:
        corpus.filter_cases(subs, [])
        raise AssertionError("empty selection must raise")
    except ValueError:
        pass


def test_readers(spark):
    d = tempfile.mkdtemp(prefix="tessera-reports-", dir="/tmp")
    _write(f"{d}/pred.csv", "case,level,submission_id,similarity,is_plagiarized,predicted_plag\n"
                            "case-01,L1,03,0.5,True,False\ncase-01,non-plag,04,0.1,FALSE,true\n")
    p = reports.read_predictions(spark, f"{d}/pred.csv").orderBy("submission_id").collect()
    assert p[0]["submission_id"] == "03" and p[0]["is_plagiarized"] is True and p[1]["predicted_plag"] is True
    _write(f"{d}/files.csv", "path,amountOfKgrams\na.java,10\nb.java,x\nc.java,4\n")
    _write(f"{d}/pairs.csv", "leftFilePath,rightFilePath,leftCovered,rightCovered,similarity\n"
                             "a.java,c.java,5,4,0.64\na.java,b.java,1,1,0.1\na.java,c.java,bad,1,0.3\n")
    pr = reports.read_pair_report(spark, f"{d}/files.csv", f"{d}/pairs.csv").collect()
    assert len(pr) == 1 and pr[0]["left_total"] == 10
    _write(f"{d}/cmp/1.json", '{"id1": "a", "id2": "b", "similarity": 45.0}\n'
                              '{"first_submission": "c", "second_submission": "d", "similarities": {"MAX": 0.8, "BOTH": 0.4}}\n')
    c = {(r["first"], r["second"]): r for r in reports.read_comparison_json(spark, f"{d}/cmp").collect()}
    assert c[("b", "a")]["avg"] == 0.45 and c[("c", "d")]["max"] == 0.8 and abs(c[("d", "c")]["avg"] - 0.6) < 1e-12
    _write(f"{d}/sim.txt", "x.java consists for 52 % of y.java material\nnoise line\n")
    s = reports.read_consists_report(spark, f"{d}/sim.txt").first()
    assert s["x"] == "x.java" and s["fraction"] == 0.52
    _write(f"{d}/blocks.file", "f,A.java,1,9,m,20,12,h,0,1@#@1,2,3@#@foo,bar\nshort,row\n")
    bl = reports.read_blocks(spark, f"{d}/blocks.file").collect()
    assert len(bl) == 1 and bl[0]["metrics"] == [1.0, 2.0, 3.0] and bl[0]["calls"] == ["foo", "bar"]
    _write(f"{d}/pairs.txt", "f,A.java,1,9,f,B.java,3,12\nf,A.java\n")
    assert reports.read_clone_pairs(spark, f"{d}/pairs.txt").count() == 1


def test_upsert_and_cache(spark):
    log = spark.createDataFrame([("T", "r1", 1, 0.1), ("T", "r2", 1, 0.2)], "tool string, run_name string, version int, f1 double")
    new = spark.createDataFrame([("T", "r1", 2, 0.9), ("T", "r3", 2, 0.3)], "tool string, run_name string, version int, f1 double")
    out = {r["run_name"]: r["f1"] for r in sinks.upsert_runs(log, new).collect()}
    assert out == {"r1": 0.9, "r2": 0.2, "r3": 0.3}
    req = spark.createDataFrame([("c1", 5), ("c1", 8)], "case string, k int")
    cached = spark.createDataFrame([("c1", 5, 0.2)], "case string, k int, s double")
    got = sinks.score_cache(req, cached, ["case", "k"], lambda todo: todo.withColumn("s", F.lit(1.0)))
    assert {(r["k"], r["s"]) for r in got.collect()} == {(5, 0.2), (8, 1.0)}


def test_channels(spark):
    df = spark.createDataFrame([(0, 'x = foo("a"); // c\n/* d */ y = 2;')], "doc_id long, text string")
    r = df.select(tx.comments("text").alias("c"), tx.string_literals("text").alias("s"),
                  tx.called_names("text").alias("k"), tx.statements("text").alias("st")).first()
    assert r["c"] == ["// c", "/* d */"] and r["s"] == ['"a"'] and r["k"] == ["foo"]
    assert r["st"][0] == 'x = foo("a")'


def test_hot_sequence_split_across_chunks(spark):
    """One user holds most events: numbering across range chunks must equal a
    plain per-user ordering (positions, grams and sequence length)."""
    import datetime as dt
    import random

    rnd = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = []
    eid = 0
    for user, n in ((1, 900), (2, 30), (3, 4)):
        for i in range(n):
            eid += 1
            rows.append((eid, base + dt.timedelta(seconds=rnd.randint(0, 10_000)), user, rnd.choice("abc")))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    g = ro.grams_from_rows(df, "user_id", ["ts", "event_id"], "event_type", 3, n_parts=8)
    got = {(r["doc_id"], r["pos"]): (r["hash"], r["n"]) for r in g.collect()}
    # brute force: sort per user, hash every 3 consecutive types with the same Spark function
    seqs = {}
    for e, ts, u, t in sorted(rows, key=lambda x: (x[2], x[1], x[0])):
        seqs.setdefault(u, []).append(t)
    exp_rows = [(u, p, seq[p:p + 3], len(seq)) for u, seq in seqs.items() for p in range(len(seq) - 2)]
    exp = spark.createDataFrame(exp_rows, "u long, p int, g array<string>, n long").select(
        "u", "p", F.xxhash64("g").alias("h"), "n").collect()
    assert got == {(r["u"], r["p"]): (r["h"], r["n"]) for r in exp}


def test_record_report(spark):
    d = tempfile.mkdtemp(prefix="tessera-records-", dir="/tmp")
    _write(f"{d}/r.txt", "File A: a.java\nFile B: b.java\nSimilarity A: 80\nSimilarity B: 0.5\n=====\n"
                         "File A: c.java\nFile B: d.java\n=====\n")
    r = reports.read_record_report(spark, f"{d}/r.txt").collect()
    assert len(r) == 1 and r[0]["file_a"] == "a.java" and r[0]["sim_a"] == 0.8 and r[0]["sim_b"] == 0.5


def test_clusters_long_path_and_top_per_group(spark):
    from tessera.operators.pairs import clusters, top_pairs

    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101)]
    edges = spark.createDataFrame(chain, "doc_a long, doc_b long")
    got = {r["node"]: r["cluster"] for r in clusters(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100
    rows = [("g1", i, float(i % 7)) for i in range(200)] + [("g2", i, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, id long, s double")
    top = top_pairs(df, 3, [F.desc("s"), F.asc("id")], keys=("g",)).collect()
    expect = {"g1": [6, 13, 20], "g2": [4, 3, 2]}
    got_top = {}
    for r in sorted(top, key=lambda r: (r["g"], -r["s"], r["id"])):
        got_top.setdefault(r["g"], []).append(r["id"])
    assert got_top == expect


def test_pages_with_equal_trees_are_listed_in_their_class(spark):
    page = "<div><p>a</p><ul><li>x</li><li>y</li></ul></div>"
    pages = [(k, page) for k in (4, 2, 9)] + [(5, page.replace("ul", "ol")), (7, "<b>z</b>")]
    hashes = stc.subtree_hashes(stc.nesting_tree(spark.createDataFrame(pages, "page_id long, html string")))
    got = {r.doc_id: (r.class_id, r.class_size) for r in stc.tree_classes(hashes).collect()}
    assert got == {2: (2, 3), 4: (2, 3), 9: (2, 3), 5: (5, 1), 7: (7, 1)}
    heads = {c for c, _ in got.values()}
    assert all({r.doc_a, r.doc_b} <= heads for r in stc.tree_similarity(hashes, 0.1).collect())


def test_equal_bags_are_listed_in_their_class_and_scope(spark):
    docs = [(3, "s", "a=1; b=2; b=2"), (1, "s", "b=2; a=1; b=2"), (2, "s", "a=1; b=2"), (6, "t", "b=2; b=2; a=1")]
    bags = ro.statement_bags(spark.createDataFrame(docs, "doc_id long, source string, text string"), keep=("source",))
    got = {(r.doc_id, r.source): (r.class_id, r.class_size) for r in ro.bag_classes(bags, ("source",)).collect()}
    assert got == {(1, "s"): (1, 2), (3, "s"): (1, 2), (2, "s"): (2, 1), (6, "t"): (6, 1)}


def test_a_short_text_inside_a_long_one_is_a_pair_by_max(spark):
    from tessera.operators import fingerprint as fpo

    long = [f"w{k}" for k in range(300)]
    docs = [(0, long), (1, long[100:114]), (2, [f"z{k}" for k in range(20)] + long[:6])]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    dh = fpo.doc_hashes(fpo.fingerprint_index(fpo.fingerprints(df, k=5, w=1)))
    found = [(r.doc_a, r.doc_b, r.covered_b, r.total_b) for r in fpo.similar_pairs(dh, 0.3, metric="max").collect()]
    assert found == [(0, 1, 10, 10)]
    assert fpo.similar_pairs(dh, 0.3).count() == 0


def test_all_runs_of_the_log_are_read(spark, sf_small):
    from tessera.plans import catalog
    from tessera.plans import synthetic as syn

    given = {(r.tool, r.run_name): r["count"]
             for r in syn.predictions(spark, sf_small).groupBy("tool", "run_name").count().collect()}
    read = catalog.QUERIES["a5_read_all_predictions"](spark, sf_small).groupBy("run_name").count().collect()
    assert len(given) == 15 and {r.run_name: r["count"] for r in read} == {name: n for (_, name), n in given.items()}
    runs = catalog.QUERIES["a6_read_all_runs"](spark, sf_small).collect()
    assert sorted((r.tool, r.run_name) for r in runs) == sorted(given)
    assert {r.min_run for r in runs if r.tool == "SIM"} == {5}


def test_every_candidate_pair_gets_a_held_out_score(spark, sf_small):
    from tessera.operators import blocks as bo
    from tessera.plans import catalog, q_attributes

    want = bo.overlap_candidates(q_attributes._turn_blocks(spark, sf_small), 0.2).select("block_a", "block_b").collect()
    got = catalog.QUERIES["j3_classify_pairs"](spark, sf_small).collect()
    assert sorted((r.block_a, r.block_b) for r in got) == sorted(map(tuple, want))
    assert all(0 <= r.p_clone <= 1 for r in got)
    x = [(k, float(k % 2), int(k % 2 == k // 10)) for k in range(20)]  # the halves teach opposite models
    scored = bo.classify_held_out(spark.createDataFrame(x, "k long, d double, label int"), F.floor(F.col("k") / 10), ["d"])
    assert all((r.p_clone > 0.5) == (r.label == 0) for r in scored.collect())


# ------------------------------------------------- pairs that share much of the larger side

def test_overlap_search_finds_every_pair_and_few_others(spark):
    rng = random.Random(11)
    bags = {}
    for d in range(90):  # the same few statements everywhere, sizes from 1 to 40, repeats
        bags[d] = [f"s{min(int(rng.expovariate(0.12)), 60)}" for _ in range(rng.choice([1, 3, 8, 20, 40]))]
    for d in range(90, 105):
        bags[d] = [*bags[d - 90][:-1], f"own{d}"]
    rows = [(d, "ab"[d % 2], s, c, len(b)) for d, b in bags.items() for s, c in Counter(b).items()]
    df = spark.createDataFrame(rows, "doc_id int, source string, stmt string, cnt long, n_stmts long")
    reps = {(d % 2, tuple(sorted(b))): d for d, b in sorted(bags.items(), reverse=True)}
    for t in (0.3, 0.5, 1.0):
        want = set()
        for x in reps.values():
            for y in reps.values():
                n = sum((Counter(bags[x]) & Counter(bags[y])).values())
                if x < y and x % 2 == y % 2 and n / max(len(bags[x]), len(bags[y])) >= t:
                    want.add((x, y, n))
        made = {(r.doc_a, r.doc_b, r.overlap) for r in ro.order_free_similarity(df, ("source",), t).collect()}
        assert made == want and (want or t == 1.0), t
    masses = ro._bag_masses(df, ("source",))
    shared = fpo.shared_fingerprints(masses, 0.5, ("source",))
    assert fpo.overlap_pairs(shared, 0.5, ("source",)).count() < fpo.prefix_pairs(masses, 0.5, ("source",)).count() / 2


def test_trees_leave_a_batch_in_parts():
    page = "<div>" + "<p>x</p>" * 50 + "</div>"
    batch = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array([page, None, ""] * 300)], names=["doc_id", "html"])
    out = list(stc._tree_batches(iter([batch])))
    assert len(out) > 1 and max(b.num_rows for b in out) <= stc.ELEMENTS + 51
    assert sum(b.num_rows for b in out) == 300 * 51
    assert {r["doc_id"] for b in out for r in b.to_pylist()} == set(range(0, 900, 3))


def test_labels_of_nodes_are_not_gathered_in_the_driver(spark, monkeypatch):
    """before, files of a few kB with a row a node were broadcast (503 MB on check_l)."""
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(stc, "cut_lineage", kept)
    tree = stc.nesting_tree(spark.createDataFrame([(1, "<a><b></b><c><d></d></c></a>"), (2, "<a><b></b></a>")], "page_id long, html string"))
    assert stc.wl_labels(tree, 2).count() == 3 * 6
    assert sum("SortMergeJoin" in p for p in plans) == 2 and not any("Broadcast" in p for p in plans)


def test_a_corpus_is_listed_case_by_case(spark, tmp_path):
    """Before, the driver held the files of the whole tree at once, and a task read 32 of them."""
    for case, folder in (("case-01", "original"), ("case-01", "plagiarized/L2/03"), ("case-02", "non-plagiarized/01"), ("case-02", "other")):
        (tmp_path / case / folder).mkdir(parents=True)
        (tmp_path / case / folder / "T.java").write_text(f"{case} {folder}")
    (tmp_path / "plagiarized.java").write_text("not in a case")
    (tmp_path / "case-03").mkdir()
    got = corpus.read_submissions(spark, str(tmp_path))
    assert not any(f.endswith(".java") for f in got.inputFiles())
    assert sorted((r["case"], r.role, r.level, r.submission_id, r.text) for r in got.collect()) == [
        ("case-01", "original", None, None, "case-01 original"),
        ("case-01", "plagiarized", "L2", "03", "case-01 plagiarized/L2/03"),
        ("case-02", "non-plagiarized", "non-plag", "01", "case-02 non-plagiarized/01")]
    assert corpus.read_submissions(spark, str(tmp_path / "case-03")).count() == 0
