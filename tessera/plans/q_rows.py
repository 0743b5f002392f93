"""Catalogue entries checked by row count (no exact SQL oracle): block
segmentation, tiling, tree / graph structure, variants, streaming, report
readers. Each is also covered by unit tests on small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..operators import fingerprint as fpo
from ..operators import runs as ro
from ..operators import structure as st
from ..operators import variants as va
from ..operators.tiling import greedy_tiling
from ..operators.tokens import segment_blocks, token_positions
from ..session import cut_lineage
from ..sources import reports, sinks
from ..sources.tables import table
from ..streaming import incremental
from . import detect
from . import sqlparts as S
from .q_fingerprint import _MAX_PAIRS_SQL, doc_pairs
from .q_runs import R_EVENTS, event_grams
from .q_tokens import _strip_sql
from .registry import register


_B9_SQL = f"""
WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS ln,
                  generate_subscripts(string_split(html, chr(10)), 1) AS line FROM pages),
  k AS (SELECT page_id, line, unnest({S.code_tokens('ln')}) AS token,
               generate_subscripts({S.code_tokens('ln')}, 1) AS i FROM l),
  t AS (SELECT page_id, line, token, row_number() OVER (PARTITION BY page_id ORDER BY line, i) - 1 AS pos FROM k),
  d AS (SELECT *, sum(CASE token WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos)
                  + CASE token WHEN '}}' THEN 1 ELSE 0 END AS depth FROM t),
  b AS (SELECT *, min(CASE WHEN token = '}}' THEN pos END) OVER w AS end_pos,
               min(CASE WHEN token = '}}' THEN line END) OVER w AS end_line
        FROM d WHERE token IN ('{{', '}}')
        WINDOW w AS (PARTITION BY page_id, depth ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT page_id AS doc_id, page_id || ':' || pos AS block_id, CAST(depth AS BIGINT) AS depth, CAST(pos AS INTEGER) AS start_pos,
       CAST(end_pos AS INTEGER) AS end_pos, CAST(line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line,
       CAST(end_pos - pos + 1 AS INTEGER) AS n_tokens
FROM b WHERE token = '{{' AND end_pos IS NOT NULL"""


@register("b9_segment_blocks", _B9_SQL)
def b9_segment_blocks(spark, root):
    """Brace blocks (start/end line, depth) of the pages' markup and scripts."""
    toks = token_positions(table(spark, root, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))
    return segment_blocks(toks)


@register("e11_greedy_tiling")
def e11_greedy_tiling(spark, root):
    """GST (min 10) over the maximal event runs of every user pair; tiled fraction per side."""
    g = event_grams(spark, root)
    runs = ro.maximal_runs(ro.seeds(g), R_EVENTS)
    t = greedy_tiling(runs, R_EVENTS)
    n = g.select("doc_id", "n").distinct()
    t = (t.join(n.select(F.col("doc_id").alias("doc_a"), F.col("n").alias("n_a")), "doc_a")
         .join(n.select(F.col("doc_id").alias("doc_b"), F.col("n").alias("n_b")), "doc_b"))
    return t.withColumn("frac_a", F.col("tiled") / F.col("n_a")).withColumn("frac_b", F.col("tiled") / F.col("n_b"))


def _tree(spark, root):
    return st.nesting_tree(table(spark, root, "pages"))


def _hashed(spark, root):
    return st.hashed_trees(table(spark, root, "pages"))


@register("f1_nesting_tree")
def f1_nesting_tree(spark, root):
    """Element tree of every page: node, tag, depth, parent."""
    return _tree(spark, root)


@register("f2_subtree_hashes")
def f2_subtree_hashes(spark, root):
    """Order-free bottom-up subtree hashes and sizes."""
    return _hashed(spark, root)


@register("f3_tree_similarity")
def f3_tree_similarity(spark, root):
    """Size-weighted subtree-multiset overlap of page pairs sharing a rare subtree."""
    return st.tree_similarity(_hashed(spark, root))


@register("f3_tree_classes")
def f3_tree_classes(spark, root):
    """Membership that goes with F3, F5 and F6: pages with equal trees, named by the lowest id."""
    return st.tree_classes(_hashed(spark, root))


# data: the last definition before a use, by a range join; control: the innermost block around a statement, by containment
_F4_CTES = f"""
WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS ln,
                  generate_subscripts(string_split(html, chr(10)), 1) AS line FROM pages),
  k AS (SELECT page_id, line, unnest({S.code_tokens('ln')}) AS token,
               generate_subscripts({S.code_tokens('ln')}, 1) AS i FROM l),
  t AS (SELECT page_id AS doc_id, token,
               CAST(row_number() OVER (PARTITION BY page_id ORDER BY line, i) - 1 AS INTEGER) AS pos FROM k),
  n AS (SELECT *, lead(token) OVER d AS nxt, lag(token) OVER d AS prv FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
  ident AS (SELECT * FROM n WHERE regexp_matches(token, '^[A-Za-z_$][A-Za-z0-9_$]*$')),
  data AS (SELECT u.doc_id, u.token AS var, max(f.pos) AS def_pos, u.pos AS use_pos
           FROM ident u JOIN ident f ON f.doc_id = u.doc_id AND f.token = u.token AND f.pos < u.pos AND f.nxt = '='
           WHERE coalesce(u.nxt <> '=', FALSE) GROUP BY 1, 2, 4)"""

_F4_CONTROL_CTES = """,
  dep AS (SELECT *, sum(CASE token WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS rd,
                    sum(CASE token WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER w AS cd
          FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  heads AS (SELECT c.doc_id, c.pos AS last_pos, o.prv AS word, o.pos - 1 AS at
            FROM dep c JOIN dep o ON o.doc_id = c.doc_id AND o.token = '(' AND c.token = ')' AND o.pos < c.pos AND o.rd = c.rd + 1
            WHERE o.prv IN ('if', 'while', 'for', 'switch', 'catch')
              AND NOT EXISTS (SELECT 1 FROM dep b WHERE b.doc_id = c.doc_id AND b.pos > o.pos AND b.pos < c.pos AND b.rd <= c.rd)
            UNION ALL SELECT doc_id, pos, token, pos FROM n WHERE token IN ('else', 'do')),
  blk AS (SELECT o.doc_id, h.word, h.at, o.pos AS lo, min(c.pos) AS hi
          FROM dep o JOIN heads h ON h.doc_id = o.doc_id AND h.last_pos = o.pos - 1
          JOIN dep c ON c.doc_id = o.doc_id AND c.token = '}' AND c.pos > o.pos AND c.cd = o.cd - 1
          WHERE o.token = '{' GROUP BY 1, 2, 3, 4),
  st AS (SELECT dep.doc_id, dep.pos, h.word, h.at FROM dep LEFT JOIN heads h ON h.doc_id = dep.doc_id AND h.last_pos = dep.pos - 1
         WHERE (h.word IS NOT NULL OR dep.prv IN ('{', '}') OR (dep.prv = ';' AND dep.rd = 0))
           AND dep.token NOT IN ('{', '}', ';', '(', ')')),
  inner_blk AS (SELECT st.doc_id, st.pos, max(blk.lo) AS lo FROM st JOIN blk ON blk.doc_id = st.doc_id AND blk.lo < st.pos AND st.pos < blk.hi
                GROUP BY 1, 2),
  control AS (SELECT st.doc_id, coalesce(st.word, blk.word) AS var, coalesce(st.at, blk.at) AS def_pos, st.pos AS use_pos
              FROM st LEFT JOIN inner_blk i ON i.doc_id = st.doc_id AND i.pos = st.pos
              LEFT JOIN blk ON blk.doc_id = i.doc_id AND blk.lo = i.lo
              WHERE coalesce(st.word, blk.word) IS NOT NULL)"""


@register("f4_dependence_edges", f"""{_F4_CTES}{_F4_CONTROL_CTES}
SELECT *, 'data' AS kind FROM data UNION ALL SELECT *, 'control' FROM control""")
def f4_dependence_edges(spark, root):
    """Data and control dependence edges in the pages' scripts and markup."""
    return st.dependence_edges(st.dependence_tokens(table(spark, root, "pages"), "page_id", "html"))


@register("f4_flow_edges", f"""{_F4_CTES}
SELECT * FROM data""")
def f4_flow_edges(spark, root):
    """Definition -> use edges (last definition before each use) in the pages' scripts and markup."""
    return st.flow_edges(st.data_tokens(table(spark, root, "pages"), "page_id", "html"))


@register("f5_prescreen")
def f5_prescreen(spark, root):
    """F3 candidate pairs kept only when node counts and tag histograms are close."""
    pairs = st.tree_similarity(_hashed(spark, root)).select("doc_a", "doc_b", "similarity")
    return st.prescreen(pairs, st.tree_stats(_tree(spark, root)), 0.3, 0.3)


@register("f6_graph_label_similarity")
def f6_graph_label_similarity(spark, root):
    """Two Weisfeiler-Lehman rounds on page trees, label-bag similarity of F3 candidate pairs."""
    pairs = st.tree_similarity(_hashed(spark, root)).select("doc_a", "doc_b")
    return st.label_bag_similarity(st.wl_labels(_tree(spark, root), 2), pairs)


def _variant_scores(spark, root):
    """Coverage (k=5, w=4) of every benchmark item by each of its variants."""
    s = _separation_scores(spark, root).filter("positive AND method = 'fingerprint'")
    return s.select("item_id", "variant", "similarity")


def _separation_scores(spark, root):
    """(method, variant, item_id, other_id, positive, similarity): every variant against its original and
    against another item of about its size, by fingerprint coverage and by common words."""
    b = table(spark, root, "benchmark").select("item_id", "text", word_tokens("text").alias("tokens"))
    v = cut_lineage(va.all_variants(b, "item_id").select(
        "item_id", "variant", F.concat_ws(":", F.col("item_id").cast("string"), "variant").alias("doc_id"),
        word_tokens("text").alias("tokens")))
    other = va.matched_negatives(b.withColumn("n", F.size("tokens")), "item_id", "n", "text")
    pairs = b.select("item_id", F.col("item_id").alias("other_id"), F.lit(True).alias("positive")).unionByName(
        other.select(F.col("id").alias("item_id"), "other_id", F.lit(False).alias("positive")))
    keys = v.select("item_id", "variant", "doc_id").join(cut_lineage(pairs), "item_id")
    orig = detect.doc_hash_table(b.select(F.col("item_id").alias("doc_id"), F.col("item_id").alias("other_id"), "tokens"),
                                 keep=("other_id",))
    var = detect.doc_hash_table(v).join(keys.select("doc_id", "other_id"), "doc_id")
    p = fpo.apply_metric(fpo.anchor_candidates(orig, var, scope=("other_id",)), "orig_in_sub", "similarity")
    by_fp = keys.join(p.select(F.col("sub_id").alias("doc_id"), "other_id", "similarity"), ["doc_id", "other_id"], "left")
    words = v.select("doc_id", F.array_distinct("tokens").alias("_v"))
    theirs = b.select(F.col("item_id").alias("other_id"), F.array_distinct("tokens").alias("_o"))
    both = F.size(F.array_union("_v", "_o"))
    by_words = keys.join(words, "doc_id").join(theirs, "other_id").withColumn(
        "similarity", fpo.ratio(F.size(F.array_intersect("_v", "_o")), both))
    cols = ("variant", "item_id", "other_id", "positive")
    return by_fp.fillna(0.0, ["similarity"]).select(F.lit("fingerprint").alias("method"), *cols, "similarity").unionByName(
        by_words.select(F.lit("words").alias("method"), *cols, "similarity"))


_SENTS = "string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30))"


def _pick_sql(seed, args, every=3):
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {args})), 1, 7) AS INTEGER) % {every} = 0"


_VARIANT_SQL = {
    "verbatim": f"""array_to_string(list_transform({_SENTS}, lambda s, i: CASE WHEN {_pick_sql(1, 's, CAST(i - 1 AS VARCHAR)')}
                    THEN s || ' // note' || chr(10) ELSE replace(s, ' ', '  ') END), ' ')""",
    "rename": f"""array_to_string(list_transform({S.word_tokens('text')}, lambda t: CASE WHEN {_pick_sql(2, 't', 4)}
                  THEN 'v' || substr(md5('2' || t), 1, 6) ELSE t END), ' ')""",
    "insert": f"""array_to_string(flatten(list_transform({_SENTS}, lambda s, i: CASE WHEN {_pick_sql(3, 's, CAST(i - 1 AS VARCHAR)')}
                  THEN [s, 'x' || substr(md5(s), 1, 5) || ' y' || substr(md5(s), 6, 5) || '.'] ELSE [s] END)), ' ')""",
    "reorder": f"""array_to_string(list_transform(list_sort(list_transform({_SENTS}, lambda s: md5(concat_ws('|', '4', s)) || s)),
                   lambda x: substr(x, 33)), ' ')""",
}

for _k, _name in (("p1_variant_verbatim", "verbatim"), ("p2_variant_rename", "rename"),
                  ("p3_variant_insert", "insert"), ("p4_variant_reorder", "reorder")):
    def _mk(name):
        def fn(spark, root):
            b = table(spark, root, "benchmark")
            return b.select("item_id", va.VARIANTS[name]("text").alias("text"))
        fn.__doc__ = f"Seeded '{name}' variant of every benchmark text."
        return fn
    register(_k, f"SELECT item_id, {_VARIANT_SQL[_name]} AS text FROM benchmark")(_mk(_name))

_P6_SQL = f"""
WITH v AS ({' UNION ALL '.join(f"SELECT item_id, '{k}' AS variant, {e} AS text FROM benchmark" for k, e in _VARIANT_SQL.items())}),
{S.fingerprint_ctes('o', 'benchmark', 'item_id', S.word_tokens('text'), 5, 4)},
{S.fingerprint_ctes('s', 'v', "CAST(item_id AS VARCHAR) || ':' || variant", S.word_tokens('text'), 5, 4)},
  size AS (SELECT item_id, text, length(bin(len({S.word_tokens('text')}))) AS c FROM benchmark),
  nxt AS (SELECT *, coalesce(lead(item_id) OVER w, first_value(item_id) OVER w) AS other_id,
                 coalesce(lead(text) OVER w, first_value(text) OVER w) AS other_text
          FROM size WINDOW w AS (PARTITION BY c ORDER BY item_id)),
  pr AS (SELECT item_id, item_id AS other_id, TRUE AS positive FROM benchmark
         UNION ALL SELECT item_id, other_id, FALSE FROM nxt WHERE item_id <> other_id AND text IS DISTINCT FROM other_text),
  vp AS (SELECT v.*, other_id, positive, CAST(v.item_id AS VARCHAR) || ':' || variant AS k FROM v JOIN pr USING (item_id)),
  cov AS (SELECT vp.k, vp.other_id, sum(o.n_pos) / max(o.n_fp) AS sim
          FROM vp JOIN s_dh s ON s.doc_id = vp.k JOIN o_dh o ON o.h = s.h AND o.doc_id = vp.other_id GROUP BY 1, 2),
  wd AS (SELECT vp.*, list_distinct({S.word_tokens('vp.text')}) AS a, list_distinct({S.word_tokens('b.text')}) AS b
         FROM vp JOIN benchmark b ON b.item_id = vp.other_id),
  sc AS (SELECT 'fingerprint' AS method, variant, positive, coalesce(sim, 0.0) AS similarity
         FROM vp LEFT JOIN cov ON cov.k = vp.k AND cov.other_id = vp.other_id
         UNION ALL SELECT 'words', variant, positive,
                {S.ratio('len(list_intersect(a, b))', 'len(list_distinct(list_concat(a, b)))')} FROM wd)"""


@register("p6_separation", f"""{_P6_SQL},
  med AS (SELECT method, variant, CAST(count_if(positive) AS BIGINT) AS n_positive, CAST(count_if(NOT positive) AS BIGINT) AS n_negative,
                 quantile_cont(similarity, 0.5) FILTER (WHERE positive) AS mp,
                 quantile_cont(similarity, 0.5) FILTER (WHERE NOT positive) AS mn FROM sc GROUP BY 1, 2),
  au AS (SELECT p.method, p.variant, sum(CASE WHEN p.similarity > n.similarity THEN 1.0 WHEN p.similarity = n.similarity THEN 0.5
                                              ELSE 0.0 END) / count(*) AS auc
         FROM sc p JOIN sc n ON n.method = p.method AND n.variant = p.variant AND p.positive AND NOT n.positive GROUP BY 1, 2)
SELECT method, variant, n_positive, n_negative, round(mp, 6) AS median_positive, round(mn, 6) AS median_negative,
       round(mp - mn, 6) AS gap, round(CAST(auc AS DOUBLE), 6) AS auc
FROM med LEFT JOIN au USING (method, variant)""")
def p6_separation(spark, root):
    """Medians, gap and AUC of variants against their originals and against other items, per method and variant."""
    s = va.separation(_separation_scores(spark, root), ["method", "variant"])
    return s.select("method", "variant", "n_positive", "n_negative",
                    *[F.round(c, 6).alias(c) for c in ("median_positive", "median_negative", "gap", "auc")])


@register("p5_variant_rewrite_loops")
def p5_variant_rewrite_loops(spark, root):
    """for-to-while header rewrite applied to the pages' scripts and markup."""
    return table(spark, root, "pages").select("page_id", va.variant_rewrite_loops("html").alias("html"))


@register("p6_robustness", f"""{_P6_SQL}
SELECT method, variant, quantile_cont(similarity, 0.5) AS median, count(*) AS n FROM sc
WHERE positive AND method = 'fingerprint' GROUP BY 1, 2""")
def p6_robustness(spark, root):
    """Median ORIG_IN_SUB of each variant against its original, per variant."""
    s = _variant_scores(spark, root).withColumn("method", F.lit("fingerprint"))
    return va.robustness(s, ["method", "variant"])


_Q1_SQL = f"""
WITH {S.fingerprint_ctes('o', 'benchmark', 'item_id', S.word_tokens('text'), 5, 4)},
{S.fingerprint_ctes('s', 'documents', 'doc_id', S.word_tokens('text'), 5, 4)}
SELECT o.doc_id AS item_id, s.doc_id AS doc_id, count(*) AS shared, CAST(sum(o.n_pos) AS BIGINT) AS covered_orig,
       max(o.n_fp) AS total_orig, CAST(sum(s.n_pos) AS BIGINT) AS covered_sub, max(s.n_fp) AS total_sub,
       CAST(0 AS INTEGER) AS batch_id
FROM o_dh o JOIN s_dh s ON o.h = s.h GROUP BY 1, 2
"""


@register("q1_stream_check", _Q1_SQL)
def q1_stream_check(spark, root):
    """Documents arriving as a file stream, checked against the benchmark index (availableNow)."""
    index = detect.doc_hash_table(detect.word_docs(spark, root, "benchmark", "item_id"))
    out = incremental.stream_check(spark, root, "documents.parquet", index)
    return spark.read.parquet(out)


@register("q2_stream_dedup")
def q2_stream_dedup(spark, root):
    """Events deduplicated on (user, type, props) within a one-hour watermark."""
    out = incremental.stream_dedup(spark, root, "events.parquet", ["user_id", "event_type", "props"])
    return spark.read.parquet(out)


@register("q2_stream_documents", f"""
WITH h AS (SELECT doc_id, sha256({_strip_sql('text')}) AS k FROM documents WHERE text IS NOT NULL),
  f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS first_id FROM h)
SELECT DISTINCT doc_id, first_id FROM f WHERE doc_id <> first_id""")
def q2_stream_documents(spark, root):
    """Documents arriving as a stream: each one whose text (type 1) another holds, with the first holder."""
    out = incremental.stream_documents(spark, root, "documents.parquet")
    return incremental.stream_repeats(spark, out).select("doc_id", "first_id")


_A8_SQL = f"""{_MAX_PAIRS_SQL},
  m AS (SELECT 'd' || doc_a AS x, 'd' || doc_b AS y,
               ({S.ratio('covered_a', 'total_a')} + {S.ratio('covered_b', 'total_b')}) / 2.0 AS avg,
               greatest({S.ratio('covered_a', 'total_a')}, {S.ratio('covered_b', 'total_b')}) AS max FROM max_pairs)
SELECT x AS first, y AS second, avg, max FROM m UNION ALL SELECT y, x, avg, max FROM m"""


def _comparison_json(spark, p):
    p = fpo.apply_metric(fpo.apply_metric(p, "avg", "avg"), "max", "max")
    path = sinks.scratch_path(spark, "comparisons")
    p.select(F.concat(F.lit("d"), F.col("doc_a").cast("string")).alias("first_submission"),
             F.concat(F.lit("d"), F.col("doc_b").cast("string")).alias("second_submission"),
             F.create_map(F.lit("AVG"), F.col("avg"), F.lit("MAX"), F.col("max")).alias("similarities")).write.options(**sinks.MANY_ROWS).json(path)
    return reports.read_comparison_json(spark, path)


@register("a8_read_comparison_json", _A8_SQL)
def a8_read_comparison_json(spark, root):
    """Nested comparison JSON (similarities map) of every pair with MAX >= 0.3, read back in both orderings."""
    return _comparison_json(spark, doc_pairs(spark, root, metric="max"))


@register("a8_read_comparison_json_max", f"""{_MAX_PAIRS_SQL},
  m AS (SELECT 'd' || doc_a AS x, 'd' || doc_b AS y,
               ({S.ratio('covered_a', 'total_a')} + {S.ratio('covered_b', 'total_b')}) / 2.0 AS avg,
               greatest({S.ratio('covered_a', 'total_a')}, {S.ratio('covered_b', 'total_b')}) AS max FROM max_pairs)
SELECT x AS first, y AS second, avg, max FROM m UNION ALL SELECT y, x, avg, max FROM m""")
def a8_read_comparison_json_max(spark, root):
    """As above, for every pair with MAX >= 0.3."""
    return _comparison_json(spark, doc_pairs(spark, root, metric="max"))


_A9_COV = f"""
WITH {S.fingerprint_ctes('o', 'benchmark', 'item_id', S.word_tokens('text'), 5, 4)},
{S.fingerprint_ctes('s', 'documents', 'doc_id', S.word_tokens('text'), 5, 4)},
  cov AS (SELECT s.doc_id, o.doc_id AS item_id, round({S.ratio('sum(o.n_pos)', 'max(o.n_fp)')}, 6) AS a,
                 round({S.ratio('sum(s.n_pos)', 'max(s.n_fp)')}, 6) AS b
          FROM o_dh o JOIN s_dh s ON o.h = s.h GROUP BY 1, 2)"""


@register("a9_read_record_report", f"""{_A9_COV}
SELECT 'b' || item_id || '.txt' AS file_a, 'd' || doc_id || '.txt' AS file_b, a AS sim_a, b AS sim_b FROM cov""")
def a9_read_record_report(spark, root):
    """Records between rules (File A/B, Similarity A/B) written from the benchmark coverage, parsed back."""
    cov = detect.anchor_coverage(spark, root)
    path = sinks.scratch_path(spark, "records")
    rec = F.format_string("File A: b%d.txt\nFile B: d%d.txt\nSimilarity A: %.6f\nSimilarity B: %.6f\n==========",
                          "item_id", "doc_id", "orig_in_sub", "sub_in_orig")
    cov.select(rec.alias("value")).write.text(path)
    return reports.read_record_report(spark, path)


@register("a9_read_text_report", f"""{_A9_COV}
SELECT 'd' || doc_id AS x, 'b' || item_id AS y, round(b * 100, 2) / 100.0 AS fraction FROM cov""")
def a9_read_text_report(spark, root):
    """'X consists for N % of Y material' lines written from the benchmark coverage, parsed back."""
    cov = detect.anchor_coverage(spark, root)
    path = sinks.scratch_path(spark, "consists")
    cov.select(F.format_string("d%d consists for %.2f %% of b%d material", "doc_id", F.col("sub_in_orig") * 100,
                               "item_id").alias("value")).write.text(path)
    return reports.read_consists_report(spark, path)


@register("a10_read_blocks")
def a10_read_blocks(spark, root):
    """'@#@' block records (header, metrics, calls) written from the pages' brace blocks, parsed back."""
    from ..operators.attributes import block_metrics

    toks = token_positions(table(spark, root, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))
    blocks = segment_blocks(toks)
    m = block_metrics(blocks, toks)
    j = blocks.join(m, "block_id")
    header = F.concat_ws(",", F.lit("pages"), F.col("doc_id").cast("string"), F.col("start_line").cast("string"),
                         F.col("end_line").cast("string"), F.lit("block"), F.col("n_tokens").cast("string"),
                         F.col("distinct_operands").cast("string"), F.col("block_id"), F.lit("0"), F.col("block_id"))
    metrics = F.concat_ws(",", *[F.col(c).cast("string") for c in ("distinct_operators", "distinct_operands",
                                                                    "total_operators", "total_operands", "cyclomatic")])
    path = sinks.scratch_path(spark, "blocks")
    j.select(F.concat_ws("@#@", header, metrics, F.lit("")).alias("value")).write.text(path)
    return reports.read_blocks(spark, path)


@register("a10_read_clone_pairs", f"""
WITH b AS (SELECT * FROM ({_B9_SQL})),
  g AS (SELECT n_tokens, depth, min((doc_id, start_pos, start_line, end_line)) AS f FROM b GROUP BY 1, 2)
SELECT 'pages' AS folder1, CAST(f[1] AS VARCHAR) AS file1, f[3] AS start1, f[4] AS end1,
       'pages' AS folder2, CAST(b.doc_id AS VARCHAR) AS file2, b.start_line AS start2, b.end_line AS end2
FROM b JOIN g USING (n_tokens, depth) WHERE (b.doc_id, b.start_pos) <> (f[1], f[2])""")
def a10_read_clone_pairs(spark, root):
    """Clone pair lines (each block of the pages with the first one of its size and depth) written, parsed back."""
    toks = token_positions(table(spark, root, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))
    b = cut_lineage(segment_blocks(toks))
    first = b.groupBy("n_tokens", "depth").agg(F.min(F.struct("doc_id", "start_pos", "start_line", "end_line")).alias("f"))
    pairs = b.join(first, ["n_tokens", "depth"]).filter(
        (F.col("doc_id") != F.col("f.doc_id")) | (F.col("start_pos") != F.col("f.start_pos")))
    path = sinks.scratch_path(spark, "clone-pairs")
    pairs.select(F.concat_ws(",", F.lit("pages"), "f.doc_id", "f.start_line", "f.end_line", F.lit("pages"), "doc_id",
                             "start_line", "end_line").alias("value")).write.text(path)
    return reports.read_clone_pairs(spark, path)
