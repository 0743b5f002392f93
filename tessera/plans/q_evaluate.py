"""Catalogue entries for evaluation (M1-M20) on derived predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from . import detect
from . import sqlparts as S
from . import synthetic as syn
from .registry import register

PC = syn.PRED_CTES
MET = ["precision", "recall", "f1", "accuracy", "mcc"]
CNT = ["tp", "fp", "tn", "fn"]


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _mets(df, extra=()):
    return [*extra, *CNT, *[r6(m).alias(m) for m in MET]]


def _preds(spark, root):
    return syn.predictions(spark, root)


# M1 ----------------------------------------------------------------------
@register("m1_predict", f"""WITH {PC}
SELECT run_name, "case", level, submission_id, similarity, is_plagiarized,
       similarity >= threshold AS predicted_plag FROM preds""")
def m1_predict(spark, root):
    """Inclusive threshold cut; the six-column prediction shape plus run_name."""
    p = ev.predict(_preds(spark, root), "threshold")
    return p.select("run_name", "case", "level", "submission_id", "similarity", "is_plagiarized", "predicted_plag")


# M2 ----------------------------------------------------------------------
@register("m2_confusion", f"""WITH {PC}
SELECT run_name, {S.counts_sql('similarity >= threshold')} FROM preds GROUP BY run_name""")
def m2_confusion(spark, root):
    return ev.confusion(ev.predict(_preds(spark, root), "threshold"), ["run_name"])


# M3 ----------------------------------------------------------------------
@register("m3_metrics", f"""WITH {PC},
  c AS (SELECT run_name, {S.counts_sql('similarity >= threshold')} FROM preds GROUP BY run_name)
SELECT run_name, tp, fp, tn, fn, {S.metrics_sql()} FROM c""")
def m3_metrics(spark, root):
    c = ev.with_metrics(ev.confusion(ev.predict(_preds(spark, root), "threshold"), ["run_name"]))
    return c.select(*_mets(c, ["run_name"]))


# M4 ----------------------------------------------------------------------
_AUC_SQL = f"""WITH {PC},
  grp AS (SELECT DISTINCT run_name, "case" FROM preds),
  pairs AS (
    SELECT p.run_name, p."case",
           2 * count_if(p.similarity > n.similarity) + count_if(p.similarity = n.similarity) AS num,
           count(*) AS pn
    FROM preds p JOIN preds n ON p.run_name = n.run_name AND p."case" = n."case"
    WHERE p.is_plagiarized AND NOT n.is_plagiarized GROUP BY 1, 2)
SELECT g.run_name, g."case", round(CAST(num AS DOUBLE) / (2.0 * pn), 6) AS auc
FROM grp g LEFT JOIN pairs USING (run_name, "case")"""


@register("m4_auc", _AUC_SQL)
def m4_auc(spark, root):
    """Exact AUC per (run, case) from score-grouped counts; one class -> NULL."""
    a = ev.auc(_preds(spark, root), ["run_name", "case"])
    return a.select("run_name", "case", r6("auc").alias("auc"))


# M5 ----------------------------------------------------------------------
@register("m5_roc_curve", f"""WITH {PC},
  p AS (SELECT * FROM preds WHERE threshold = 0.5),
  tot AS (SELECT run_name, count_if(is_plagiarized) AS P, count_if(NOT is_plagiarized) AS N FROM p GROUP BY 1),
  cuts AS (SELECT DISTINCT run_name, similarity AS threshold FROM p),
  pts AS (
    SELECT c.run_name, c.threshold, CAST(count_if(p.is_plagiarized) AS BIGINT) AS tp,
           CAST(count_if(NOT p.is_plagiarized) AS BIGINT) AS fp
    FROM cuts c JOIN p ON p.run_name = c.run_name AND p.similarity >= c.threshold GROUP BY 1, 2
    UNION ALL SELECT run_name, NULL, 0, 0 FROM tot)
SELECT pts.run_name, threshold, tp, fp, round({S.ratio('tp', 'P')}, 6) AS tpr, round({S.ratio('fp', 'N')}, 6) AS fpr
FROM pts JOIN tot USING (run_name)""")
def m5_roc_curve(spark, root):
    p = _preds(spark, root).filter(F.col("threshold") == 0.5)
    r = ev.roc_curve(p, ["run_name"])
    return r.select("run_name", "threshold", "tp", "fp", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


# M6 ----------------------------------------------------------------------
_GLOBAL_SQL = f"""WITH {PC},
  c AS (SELECT run_name, threshold, {S.counts_sql('similarity >= threshold')} FROM preds GROUP BY 1, 2),
  pairs AS (
    SELECT p.run_name, 2 * count_if(p.similarity > n.similarity) + count_if(p.similarity = n.similarity) AS num,
           count(*) AS pn
    FROM preds p JOIN preds n ON p.run_name = n.run_name
    WHERE p.is_plagiarized AND NOT n.is_plagiarized GROUP BY 1)
SELECT c.run_name, threshold, tp, fp, tn, fn, {S.metrics_sql()},
       round(CAST(num AS DOUBLE) / (2.0 * pn), 6) AS auc
FROM c LEFT JOIN pairs USING (run_name)"""


@register("m6_global_metrics", _GLOBAL_SQL)
def m6_global_metrics(spark, root):
    p = _preds(spark, root)
    g = ev.global_metrics(p, syn.runs(p))
    return g.select("run_name", "threshold", *_mets(g), r6("auc").alias("auc"))


# M7 ----------------------------------------------------------------------
_LEVELS_VALUES = ", ".join(f"('{x}')" for x in ev.LEVELS)
_GROUP_SQL = f"""WITH {PC},
  g AS (
    SELECT run_name, 'all' AS group_type, 'all' AS group_value, similarity, threshold, is_plagiarized FROM preds
    UNION ALL SELECT run_name, 'level', level, similarity, threshold, is_plagiarized FROM preds
    UNION ALL SELECT run_name, 'case', "case", similarity, threshold, is_plagiarized FROM preds),
  dim AS (SELECT DISTINCT run_name, group_type, group_value FROM g
          UNION SELECT r.run_name, 'level', v.lv FROM syn_runs r, (VALUES {_LEVELS_VALUES}) v(lv)),
  c AS (SELECT run_name, group_type, group_value, {S.counts_sql('similarity >= threshold')} FROM g GROUP BY 1, 2, 3),
  pairs AS (
    SELECT p.run_name, p.group_type, p.group_value,
           2 * count_if(p.similarity > n.similarity) + count_if(p.similarity = n.similarity) AS num, count(*) AS pn
    FROM g p JOIN g n ON p.run_name = n.run_name AND p.group_type = n.group_type AND p.group_value = n.group_value
    WHERE p.is_plagiarized AND NOT n.is_plagiarized GROUP BY 1, 2, 3),
  cc AS (SELECT d.run_name, d.group_type, d.group_value, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp,
                coalesce(tn, 0) AS tn, coalesce(fn, 0) AS fn
         FROM dim d LEFT JOIN c USING (run_name, group_type, group_value))
SELECT cc.*, {S.metrics_sql(null_if_empty=True)}, round(CAST(num AS DOUBLE) / (2.0 * pn), 6) AS auc
FROM cc LEFT JOIN pairs USING (run_name, group_type, group_value)"""


@register("m7_group_metrics", _GROUP_SQL)
def m7_group_metrics(spark, root):
    p = _preds(spark, root)
    g = ev.group_metrics(p, syn.runs(p))
    return g.select("run_name", "group_type", "group_value", *_mets(g), r6("auc").alias("auc"))


# M8 ----------------------------------------------------------------------
_M8_RUNS = [f"{t}-Threshold-0.50" for t in syn.TOOL_SCORES]
_M8_SQL = f"""WITH m7 AS ({_GROUP_SQL})
SELECT group_value, {', '.join(f"max(CASE WHEN run_name = '{r}' THEN f1 END) AS \"{r}\"" for r in _M8_RUNS)}
FROM m7 WHERE group_type = 'level' GROUP BY group_value"""


@register("m8_f1_matrix", _M8_SQL)
def m8_f1_matrix(spark, root):
    p = _preds(spark, root)
    g = ev.group_metrics(p, syn.runs(p)).withColumn("f1", r6("f1"))
    return ev.f1_matrix(g, _M8_RUNS)


# M9 ----------------------------------------------------------------------
@register("m9_prune_degenerate", f"""WITH {PC},
  c AS (SELECT run_name, {S.counts_sql('similarity >= threshold')} FROM preds GROUP BY run_name)
SELECT * FROM c WHERE NOT (tn = 0 OR tp = 0 OR fp = 0)""")
def m9_prune_degenerate(spark, root):
    c = ev.confusion(ev.predict(_preds(spark, root), "threshold"), ["run_name"])
    return ev.prune_degenerate(c)


# M10 ---------------------------------------------------------------------
_RUNLOG_SQL = f"""WITH {PC},
  c AS (SELECT tool, run_name, run_ord, threshold, {S.counts_sql('similarity >= threshold')}
        FROM preds GROUP BY ALL),
  pairs AS (
    SELECT p.run_name, 2 * count_if(p.similarity > n.similarity) + count_if(p.similarity = n.similarity) AS num,
           count(*) AS pn
    FROM preds p JOIN preds n ON p.run_name = n.run_name
    WHERE p.is_plagiarized AND NOT n.is_plagiarized GROUP BY 1)
SELECT c.*, {S.metrics_sql(nd=12)}, CAST(num AS DOUBLE) / (2.0 * pn) AS auc
FROM c LEFT JOIN pairs USING (run_name)"""


def run_log(spark, root):
    """Run log (tool, run_name, run_ord, threshold, counts, metrics, auc)."""
    p = _preds(spark, root)
    r = syn.runs(p)
    g = ev.global_metrics(p, r).drop("threshold")
    return r.join(g, "run_name")


@register("m10_best_run_per_tool", f"""WITH rl AS ({_RUNLOG_SQL}),
  ok AS (SELECT * FROM rl WHERE NOT (tn = 0 OR tp = 0 OR fp = 0) AND mcc IS NOT NULL AND NOT isnan(mcc)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY mcc DESC, run_ord) AS rn FROM ok)
SELECT tool, run_name, round(mcc, 6) AS mcc FROM ranked WHERE rn = 1""")
def m10_best_run_per_tool(spark, root):
    b = ev.best_run_per_tool(run_log(spark, root), "mcc")
    return b.select("tool", "run_name", r6("mcc").alias("mcc"))


# M11 ---------------------------------------------------------------------
_TOOL_ORDER = "'JPlag', 'Dolos', 'SIM', 'Plaggie', 'Oreo', 'CodeBERT', 'CodeLlama'"  # by hand, not the engine's list
_M11_SQL = f"""WITH rl AS ({_RUNLOG_SQL}),
  ok AS (SELECT * FROM rl WHERE NOT (tn = 0 OR tp = 0 OR fp = 0) AND mcc IS NOT NULL AND NOT isnan(mcc)),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY mcc DESC, run_ord) AS rn
                          FROM ok) WHERE rn = 1),
  gm AS ({_GROUP_SQL}),
  lv AS (SELECT b.tool, gm.run_name, gm.group_value AS level, gm.f1,
                list_position([{_TOOL_ORDER}], b.tool) AS tool_ord
         FROM gm JOIN best b ON gm.run_name = b.run_name
         WHERE gm.group_type = 'level' AND gm.group_value IN ('L1','L2','L3','L4','L5','L6') AND gm.f1 IS NOT NULL)
SELECT level, tool, run_name, f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY level ORDER BY f1 DESC, tool_ord, tool) AS rn FROM lv) WHERE rn = 1"""


@register("m11_best_tool_per_level", _M11_SQL)
def m11_best_tool_per_level(spark, root):
    p = _preds(spark, root)
    best = ev.best_run_per_tool(run_log(spark, root), "mcc").select("tool", "run_name")
    gm = ev.group_metrics(p, syn.runs(p)).withColumn("f1", r6("f1"))
    gm = gm.join(best, "run_name").withColumn("tool_ord", ev.tool_order())
    b = ev.best_tool_per_level(gm)
    return b.select(F.col("group_value").alias("level"), "tool", "run_name", "f1")


# M12 ---------------------------------------------------------------------
@register("m12_best_per_tool_table", f"""WITH rl AS ({_RUNLOG_SQL}),
  ok AS (SELECT * FROM rl WHERE NOT (tn = 0 OR tp = 0 OR fp = 0) AND mcc IS NOT NULL AND NOT isnan(mcc)),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY mcc DESC, run_ord) AS rn
                          FROM ok) WHERE rn = 1)
SELECT tool, run_name, threshold, tp, fp, tn, fn, round(precision, 4) AS precision, round(recall, 4) AS recall,
       round(f1, 4) AS f1, round(accuracy, 4) AS accuracy, round(auc, 4) AS auc, round(mcc, 4) AS mcc FROM best""")
def m12_best_per_tool_table(spark, root):
    b = ev.best_run_per_tool(run_log(spark, root), "mcc")
    return b.select("tool", "run_name", "threshold", *CNT,
                    *[F.round(m, 4).alias(m) for m in ["precision", "recall", "f1", "accuracy", "auc", "mcc"]])


# M13 ---------------------------------------------------------------------
@register("m13_all_runs", f"""WITH rl AS ({_RUNLOG_SQL})
SELECT tool, run_name, round(f1, 6) AS f1, round(mcc, 6) AS mcc FROM rl
WHERE NOT (tn = 0 OR tp = 0 OR fp = 0) AND tool IN ('Dolos', 'SIM')""")
def m13_all_runs(spark, root):
    rl = ev.prune_degenerate(run_log(spark, root)).filter(F.col("tool").isin("Dolos", "SIM"))
    return rl.select("tool", "run_name", r6("f1").alias("f1"), r6("mcc").alias("mcc"))


# M14 ---------------------------------------------------------------------
@register("m14_level_curve", f"""WITH gm AS ({_GROUP_SQL})
SELECT run_name, group_value AS level, list_position(['L1','L2','L3','L4','L5','L6'], group_value) AS level_ord, f1
FROM gm WHERE group_type = 'level' AND group_value IN ('L1','L2','L3','L4','L5','L6')""")
def m14_level_curve(spark, root):
    p = _preds(spark, root)
    gm = ev.group_metrics(p, syn.runs(p))
    lv = gm.filter((F.col("group_type") == "level") & F.col("group_value").isin(ev.LEVELS[:6]))
    lv = lv.withColumnRenamed("group_value", "level")
    return lv.select("run_name", "level", ev.level_order().alias("level_ord"), r6("f1").alias("f1"))


# M15 ---------------------------------------------------------------------
@register("m15_class_distribution", f"""WITH {PC},
  p AS (SELECT * FROM preds WHERE threshold = 0.5),
  st AS (SELECT tool, is_plagiarized, count(*) AS n, min(similarity) AS min_sim, max(similarity) AS max_sim,
                quantile_cont(similarity, 0.25) AS q1, quantile_cont(similarity, 0.5) AS median,
                quantile_cont(similarity, 0.75) AS q3 FROM p GROUP BY 1, 2),
  h AS (SELECT tool, is_plagiarized, CAST(least(floor(similarity * 10), 9) AS INTEGER) AS bin, count(*) AS bin_count
        FROM p GROUP BY 1, 2, 3)
SELECT st.tool, st.is_plagiarized, n, min_sim, max_sim, round(q1, 6) AS q1, round(median, 6) AS median,
       round(q3, 6) AS q3, bin, bin_count FROM st JOIN h USING (tool, is_plagiarized)""")
def m15_class_distribution(spark, root):
    p = _preds(spark, root).filter(F.col("threshold") == 0.5)
    d = ev.class_distribution(p, ["tool"])
    return d.select("tool", "is_plagiarized", "n", "min_sim", "max_sim", r6("q1").alias("q1"),
                    r6("median").alias("median"), r6("q3").alias("q3"), "bin", "bin_count")


# M4, M5, M15 on scores as they are measured ---------------------------------
@register("m4_auc_unrounded", f"""WITH {syn.MEASURED_CTES},
  g AS (SELECT detector, similarity, count_if(is_plagiarized) AS pos, count_if(NOT is_plagiarized) AS neg
        FROM measured GROUP BY 1, 2),
  w AS (SELECT *, sum(neg) OVER (PARTITION BY detector ORDER BY similarity) - neg AS below FROM g)
SELECT detector, CAST(sum(pos) AS BIGINT) AS "P", CAST(sum(neg) AS BIGINT) AS "N",
       round(CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / (2.0 * sum(pos) * sum(neg)), 6) AS auc
FROM w GROUP BY 1""")
def m4_auc_unrounded(spark, root):
    """Exact AUC of three measures of whole texts, scores not rounded."""
    a = ev.auc_unrounded(syn.measured(spark, root), ["detector"])
    return a.select("detector", "P", "N", r6("auc").alias("auc"))


@register("m5_roc_unrounded", f"""WITH {syn.MEASURED_CTES},
  g AS (SELECT detector, similarity, count_if(is_plagiarized) AS pos, count_if(NOT is_plagiarized) AS neg
        FROM measured GROUP BY 1, 2),
  w AS (SELECT detector, similarity AS threshold,
               CAST(sum(pos) OVER (PARTITION BY detector ORDER BY similarity DESC) AS BIGINT) AS tp,
               CAST(sum(neg) OVER (PARTITION BY detector ORDER BY similarity DESC) AS BIGINT) AS fp,
               sum(pos) OVER (PARTITION BY detector) AS P, sum(neg) OVER (PARTITION BY detector) AS N FROM g
        UNION ALL SELECT detector, NULL, 0, 0, sum(pos), sum(neg) FROM g GROUP BY 1)
SELECT detector, round(threshold, 6) AS threshold, tp, fp, round({S.ratio('tp', 'P')}, 6) AS tpr,
       round({S.ratio('fp', 'N')}, 6) AS fpr FROM w""")
def m5_roc_unrounded(spark, root):
    """Every ROC point of three measures of whole texts, scores not rounded."""
    r = ev.roc_curve_unrounded(syn.measured(spark, root), ["detector"])
    return r.select("detector", r6("threshold").alias("threshold"), "tp", "fp", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@register("m15_class_quantiles", f"""WITH {syn.MEASURED_CTES}
SELECT detector, is_plagiarized, count(*) AS n, round(quantile_cont(similarity, 0.25), 6) AS q1,
       round(quantile_cont(similarity, 0.5), 6) AS median, round(quantile_cont(similarity, 0.75), 6) AS q3
FROM measured GROUP BY 1, 2""")
def m15_class_quantiles(spark, root):
    """Exact quartiles per measure and class, picked out of the running counts."""
    q = ev.class_quantiles(syn.measured(spark, root), ["detector"])
    return q.select("detector", "is_plagiarized", "n", r6("q_0").alias("q1"), r6("q_1").alias("median"), r6("q_2").alias("q3"))


# M16 ---------------------------------------------------------------------
@register("m16_threshold_sweep", f"""WITH {PC},
  p AS (SELECT * FROM preds WHERE threshold = 0.5),
  cuts AS (SELECT DISTINCT p.tool, CAST(r.i AS DOUBLE) / 200 AS cut FROM p, range(0, 201) r(i)),
  c AS (SELECT c.tool, c.cut AS threshold, {S.counts_sql('p.similarity >= c.cut', 'p.is_plagiarized')}
        FROM cuts c JOIN p ON p.tool = c.tool GROUP BY 1, 2)
SELECT tool, threshold, tp, fp, tn, fn, {S.metrics_sql()} FROM c""")
def m16_threshold_sweep(spark, root):
    """F1 etc. at 201 cuts on [0, 1] per tool, via score buckets + running sums."""
    p = _preds(spark, root).filter(F.col("threshold") == 0.5).drop("threshold")
    s = ev.threshold_sweep(p, ["tool"], steps=200)
    return s.select("tool", "threshold", *_mets(s))


@register("m16_best_threshold", f"""WITH {PC},
  cuts AS (SELECT DISTINCT preds.tool, "case", CAST(r.i AS DOUBLE) / 200 AS cut FROM preds, range(0, 201) r(i)),
  c AS (SELECT c.tool, c."case", c.cut AS threshold, {S.counts_sql('p.similarity >= c.cut', 'p.is_plagiarized')}
        FROM cuts c JOIN preds p ON p.tool = c.tool AND p."case" = c."case" AND p.threshold = 0.5 GROUP BY 1, 2, 3),
  m AS (SELECT *, {S.metrics_sql(nd=12)} FROM c),
  b AS (SELECT *, row_number() OVER (PARTITION BY tool, "case" ORDER BY f1 DESC, threshold) AS rn FROM m)
SELECT tool, "case", threshold, tp, fp, tn, fn, round(f1, 6) AS f1 FROM b WHERE rn = 1""")
def m16_best_threshold(spark, root):
    """The cut of 201 with the highest F1, per tool and case; ties go to the lowest cut."""
    # a tool's five runs hold the same scores
    p = _preds(spark, root).filter(F.col("threshold") == 0.5).drop("threshold")
    s = ev.threshold_sweep(p, ["tool", "case"], steps=200).withColumn("f1", F.round("f1", 12))
    b = ev.best_threshold(s, ["tool", "case"])
    return b.select("tool", "case", "threshold", *CNT, r6("f1").alias("f1"))


# On the real detector (benchmark coverage of documents) -
_M17_METRICS = ["max", "avg", "orig_in_sub", "sub_in_orig", "product"]
_M17_T = [0.1, 0.3, 0.5, 0.7, 0.9]


def doc_scores(spark, root):
    """Per labelled document: best directional coverage by any benchmark item
    (each direction maxed separately; 0 when nothing is shared)."""
    from ..operators.pairs import max_over_anchors

    cov = detect.anchor_coverage(spark, root)
    lab = syn.base(spark, root).select("doc_id", "case", "is_plagiarized")
    return max_over_anchors(lab, cov, "doc_id", ["orig_in_sub", "sub_in_orig", "combined"])


def _cov_sql():
    return f"""
{S.fingerprint_ctes('o', 'benchmark', 'item_id', S.word_tokens('text'), 5, 4)},
{S.fingerprint_ctes('s', 'documents', 'doc_id', S.word_tokens('text'), 5, 4)},
  cov AS (
    SELECT s.doc_id, o.doc_id AS item_id, {S.ratio('sum(o.n_pos)', 'max(o.n_fp)')} AS a,
           {S.ratio('sum(s.n_pos)', 'max(s.n_fp)')} AS b,
           {S.ratio('sum(o.n_pos) + sum(s.n_pos)', 'max(o.n_fp) + max(s.n_fp)')} AS c
    FROM o_dh o JOIN s_dh s ON o.h = s.h GROUP BY 1, 2),
  dsc AS (
    SELECT b.doc_id, b."case", b.is_plagiarized, coalesce(max(round(a, 6)), 0.0) AS orig_in_sub,
           coalesce(max(round(b, 6)), 0.0) AS sub_in_orig, coalesce(max(round(c, 6)), 0.0) AS combined
    FROM syn_base b LEFT JOIN cov ON cov.doc_id = b.doc_id GROUP BY 1, 2, 3)"""


def _metric_sql(m):
    return {"combined": "combined", "max": "greatest(orig_in_sub, sub_in_orig)", "avg": "(orig_in_sub + sub_in_orig) / 2.0",
            "orig_in_sub": "orig_in_sub", "sub_in_orig": "sub_in_orig",
            "product": "orig_in_sub * sub_in_orig"}[m]


_M17_SQL = f"""WITH {PC}, {_cov_sql()},
  x AS ({' UNION ALL '.join(f"SELECT '{m.upper()}' AS metric, is_plagiarized, {_metric_sql(m)} AS similarity FROM dsc" for m in _M17_METRICS)}),
  t AS (SELECT * FROM (VALUES {', '.join(f'({t}::DOUBLE)' for t in _M17_T)}) v(threshold)),
  c AS (SELECT metric, threshold, {S.counts_sql('similarity >= threshold')} FROM x, t GROUP BY 1, 2)"""


@register("m17_param_sweep", f"""{_M17_SQL}
SELECT metric, threshold, tp, fp, tn, fn, {S.metrics_sql()} FROM c""")
def m17_param_sweep(spark, root):
    """5 metrics x 5 thresholds = 25 runs from one directional score table."""
    s = ev.param_sweep(doc_scores(spark, root), _M17_METRICS, _M17_T, ["doc_id"])
    return s.select("metric", "threshold", *_mets(s))


@register("m18_run_name", f"""{_M17_SQL}
SELECT printf('Dolos-Threshold-%.2f-KGram-%d-Window-%d-Metric-%s', threshold, 5, 4, metric) AS run_name,
       tp, fp, tn, fn FROM c""")
def m18_run_name(spark, root):
    s = ev.param_sweep(doc_scores(spark, root), _M17_METRICS, _M17_T, ["doc_id"])
    name = ev.run_name("Dolos", [("Threshold", F.col("threshold"), "%.2f"), ("KGram", F.lit(5), "%d"),
                                 ("Window", F.lit(4), "%d"), ("Metric", F.col("metric"), "%s")])
    return s.select(name.alias("run_name"), *CNT)


@register("m19_data_summary", f"""WITH {PC}
SELECT run_name, count(*) AS rows, CAST(count_if(is_plagiarized) AS BIGINT) AS positives, threshold FROM preds
GROUP BY 1, 4""")
def m19_data_summary(spark, root):
    p = _preds(spark, root)
    return ev.data_summary(p, syn.runs(p))


@register("m20_match_rate", f"""WITH {PC}, {_cov_sql()}
SELECT "case", CAST(count_if(orig_in_sub > 0) AS BIGINT) AS matched, count(*) AS total,
       round({S.ratio('count_if(orig_in_sub > 0)', 'count(*)')}, 6) AS match_rate FROM dsc GROUP BY 1""")
def m20_match_rate(spark, root):
    m = ev.match_rate(doc_scores(spark, root).withColumnRenamed("orig_in_sub", "similarity"), ["case"])
    return m.select("case", "matched", "total", r6("match_rate").alias("match_rate"))
