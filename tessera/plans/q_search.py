"""Catalogue entries for parameter search over a run log.

The run log is a real parameter sweep: the benchmark-coverage detector at
5 metrics x 5 thresholds (target F1) from one cached score table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import search as so
from ..session import cut_lineage
from . import sqlparts as S
from . import synthetic as syn
from .q_evaluate import _RUNLOG_SQL, _cov_sql, _metric_sql, doc_scores
from .q_evaluate import run_log as ev_run_log
from .registry import register

METRICS = ["combined", "max", "avg", "sub_in_orig", "orig_in_sub"]
THRESH = [0.1, 0.3, 0.5, 0.7, 0.9]
H, XI, DIV = 1.0, 0.01, 0.4


def run_log(spark, root):
    s = ev.param_sweep(doc_scores(spark, root), METRICS, THRESH, ["doc_id"])
    name = ev.run_name("Dolos", [("Threshold", F.col("threshold"), "%.2f"), ("KGram", F.lit(5), "%d"),
                                 ("Window", F.lit(4), "%d"), ("Metric", F.col("metric"), "%s")])
    # a run log is a table: written once (one row per metric and threshold), then read by every step
    return cut_lineage(s.withColumn("run_name", name))


_LOG_SQL = f"""WITH {syn.PRED_CTES}, {_cov_sql()},
  x AS ({' UNION ALL '.join(f"SELECT '{m.upper()}' AS metric, is_plagiarized, {_metric_sql(m)} AS similarity FROM dsc" for m in METRICS)}),
  t AS (SELECT * FROM (VALUES {', '.join(f'({t}::DOUBLE)' for t in THRESH)}) v(threshold)),
  c AS (SELECT metric, threshold, {S.counts_sql('similarity >= threshold')} FROM x, t GROUP BY 1, 2),
  log AS (SELECT c.*, {S.metrics_sql(nd=15)},
                 printf('Dolos-Threshold-%.2f-KGram-%d-Window-%d-Metric-%s', threshold, 5, 4, metric) AS run_name
          FROM c),
  enc AS (SELECT *, CAST(CASE metric {' '.join(f"WHEN '{k}' THEN {v}" for k, v in so.METRIC_ENCODE.items())} END AS DOUBLE)
                   AS x_metric,
                 threshold AS x_threshold FROM log),
  st AS (SELECT avg(x_metric) AS mm, CASE WHEN stddev_pop(x_metric) > 0 THEN stddev_pop(x_metric) ELSE 1.0 END AS sm,
                avg(x_threshold) AS mt, CASE WHEN stddev_pop(x_threshold) > 0 THEN stddev_pop(x_threshold) ELSE 1.0 END AS stt
         FROM enc),
  obs AS (SELECT enc.*, (x_metric - mm) / sm AS z_metric, (x_threshold - mt) / stt AS z_threshold FROM enc, st),
  grid AS (SELECT m.metric, CAST(g.c AS DOUBLE) / 100 AS threshold
           FROM (SELECT DISTINCT metric FROM log) m, (VALUES {', '.join(f'({c})' for c in so.THRESHOLD_GRID_CENTS)}) g(c)
           WHERE (m.metric, g.c) NOT IN (SELECT (metric, CAST(round(threshold * 100) AS INTEGER)) FROM log)),
  cz AS (SELECT grid.*, ((CASE metric {' '.join(f"WHEN '{k}' THEN {v}" for k, v in so.METRIC_ENCODE.items())} END) - mm) / sm
                AS z_metric, (threshold - mt) / stt AS z_threshold FROM grid, st),
  est AS (SELECT cz.metric, cz.threshold, cz.z_metric, cz.z_threshold,
                 sum(exp(-((cz.z_metric - o.z_metric) * (cz.z_metric - o.z_metric)
                          + (cz.z_threshold - o.z_threshold) * (cz.z_threshold - o.z_threshold)) / (2.0 * {H} * {H}))) AS sw,
                 sum(exp(-((cz.z_metric - o.z_metric) * (cz.z_metric - o.z_metric)
                          + (cz.z_threshold - o.z_threshold) * (cz.z_threshold - o.z_threshold)) / (2.0 * {H} * {H})) * o.f1) AS swy,
                 sum(exp(-((cz.z_metric - o.z_metric) * (cz.z_metric - o.z_metric)
                          + (cz.z_threshold - o.z_threshold) * (cz.z_threshold - o.z_threshold)) / (2.0 * {H} * {H})) * o.f1 * o.f1) AS swy2
          FROM cz, obs o GROUP BY 1, 2, 3, 4),
  mus AS (SELECT metric, threshold, swy / sw AS mu, sqrt(greatest(swy2 / sw - (swy / sw) * (swy / sw), 0.0)) AS sigma FROM est)"""


def _erf_sql(x):
    a1, a2, a3, a4, a5 = so.AS_A
    t = f"(1.0 / (1.0 + {so.AS_P} * abs({x})))"
    poly = f"({t} * ({a1} + {t} * ({a2} + {t} * ({a3} + {t} * ({a4} + {t} * {a5})))))"
    y = f"(1.0 - {poly} * exp(-abs({x}) * abs({x})))"
    return f"(CASE WHEN {x} < 0 THEN -{y} ELSE {y} END)"


_EI_SQL = f"""{_LOG_SQL},
  fb AS (SELECT max(f1) AS f_best FROM log),
  zz AS (SELECT mus.*, mu - f_best - {XI} AS imp, CASE WHEN sigma > 1e-9 THEN (mu - f_best - {XI}) / sigma ELSE 0.0 END AS z
         FROM mus, fb),
  ei AS (SELECT metric, threshold, mu, sigma,
                CASE WHEN sigma <= 1e-9 THEN 0.0 ELSE greatest(imp * (0.5 * (1.0 + {_erf_sql('z / sqrt(2.0)')}))
                     + sigma * (exp(-0.5 * z * z) / sqrt(2.0 * pi())), 0.0) END AS ei FROM zz)"""


def _cands(spark, root):
    log = run_log(spark, root)
    enc = log.withColumn("x_metric", so.encode_metric(F.col("metric"))).withColumn("x_threshold", F.col("threshold"))
    stats = so.standardize_stats(enc, ["x_metric", "x_threshold"])
    obs = so.standardize(enc, stats)
    cands = so.candidate_grid(log)
    cands = cands.withColumn("x_metric", so.encode_metric(F.col("metric"))).withColumn("x_threshold", F.col("threshold"))
    cz = so.standardize(cands, stats)
    arr = so.observed_array(obs, ["z_x_metric", "z_x_threshold"], "f1")
    est = so.local_estimate(cz, arr, ["z_x_metric", "z_x_threshold"], H)
    f_best = log.select(F.max("f1")).scalar()
    return log, obs, est, f_best


def r6(c):
    return F.round(c, 6)


@register("n1_candidate_grid", f"""{_LOG_SQL}
SELECT metric, threshold FROM grid""")
def n1_candidate_grid(spark, root):
    """Untried (metric, threshold) points of the 0.05..0.95 grid."""
    return so.candidate_grid(run_log(spark, root))


# The grid of fingerprint parameters beside metric and threshold.
KGRAMS, WINDOWS = [3, 5, 8, 13], [1, 2, 4, 8]


@register("n1_parameter_grid", f"""{_LOG_SQL},
  full_grid AS (SELECT m.metric, CAST(g.c AS DOUBLE) / 100 AS threshold, k.kgram, w."window"
                FROM (VALUES {', '.join(f"('{m.upper()}')" for m in METRICS)}) m(metric),
                     (VALUES {', '.join(f'({c})' for c in so.THRESHOLD_GRID_CENTS)}) g(c),
                     (VALUES {', '.join(f'({k})' for k in KGRAMS)}) k(kgram),
                     (VALUES {', '.join(f'({w})' for w in WINDOWS)}) w("window"))
SELECT * FROM full_grid f WHERE NOT EXISTS (
  SELECT 1 FROM log WHERE log.metric = f.metric AND round(log.threshold * 100) = round(f.threshold * 100)
                          AND f.kgram = 5 AND f."window" = 4)""")
def n1_parameter_grid(spark, root):
    """Every untried combination of metric, threshold, k-gram length and window: four dimensions, all in the key."""
    log = run_log(spark, root).select("metric", "threshold", F.lit(5).alias("kgram"), F.lit(4).alias("window"))
    return so.parameter_grid({"metric": [m.upper() for m in METRICS], "threshold": [c / 100 for c in so.THRESHOLD_GRID_CENTS],
                              "kgram": KGRAMS, "window": WINDOWS}, log)


@register("n2_unknown_params", f"""{_LOG_SQL}
SELECT metric, threshold, CAST(CASE metric WHEN 'MAX' THEN 0.0 WHEN 'AVG' THEN 1.0 ELSE 0.5 END AS DOUBLE) AS x_metric
FROM log""")
def n2_unknown_params(spark, root):
    """A mapping that knows two of the log's categories; every other one takes the default in the middle."""
    log = run_log(spark, root)
    return log.select("metric", "threshold", so.encode_with_default(F.col("metric"), {"MAX": 0, "AVG": 1}, 0.5).alias("x_metric"))


@register("n2_encode_params", f"""{_LOG_SQL}
SELECT metric, threshold, x_metric, x_threshold FROM enc""")
def n2_encode_params(spark, root):
    log = run_log(spark, root)
    return log.select("metric", "threshold", so.encode_metric(F.col("metric")).alias("x_metric"),
                      F.col("threshold").alias("x_threshold"))


@register("n3_standardize", f"""{_LOG_SQL}
SELECT metric, threshold, round(z_metric, 6) AS z_metric, round(z_threshold, 6) AS z_threshold FROM obs""")
def n3_standardize(spark, root):
    _, obs, _, _ = _cands(spark, root)
    return obs.select("metric", "threshold", r6("z_x_metric").alias("z_metric"), r6("z_x_threshold").alias("z_threshold"))


@register("n4_local_estimate", f"""{_LOG_SQL}
SELECT metric, threshold, round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM mus""")
def n4_local_estimate(spark, root):
    """RBF-weighted mean / spread of F1 around each untried point (stands in for the GP posterior)."""
    _, _, est, _ = _cands(spark, root)
    return est.select("metric", "threshold", r6("mu").alias("mu"), r6("sigma").alias("sigma"))


@register("n5_expected_improvement", f"""{_EI_SQL}
SELECT metric, threshold, round(ei, 6) AS ei FROM ei""")
def n5_expected_improvement(spark, root):
    _, _, est, f_best = _cands(spark, root)
    e = so.expected_improvement(est, f_best, XI)
    return e.select("metric", "threshold", r6("ei").alias("ei"))


@register("n6_diverse_top")
def n6_diverse_top(spark, root):
    """Top 5 suggestions by EI with a 0.4 standardized-distance diversity filter."""
    _, _, est, f_best = _cands(spark, root)
    e = so.expected_improvement(est, f_best, XI)
    return so.diverse_top(e, 5, DIV, ["z_x_metric", "z_x_threshold"], [F.desc("ei"), "metric", "threshold"])


@register("n7_suggestion_notes", f"""{_EI_SQL},
  p AS (SELECT quantile_cont(sigma, 0.75) AS p75 FROM mus)
SELECT metric, threshold, CASE WHEN mu > (SELECT max(f1) FROM log) THEN 'likely better than the best run'
                               WHEN sigma > p75 THEN 'uncertain region' ELSE '' END AS note
FROM ei, p""")
def n7_suggestion_notes(spark, root):
    _, _, est, f_best = _cands(spark, root)
    return so.suggestion_notes(est, f_best).select("metric", "threshold", "note")


@register("n8_landscape", f"""{_LOG_SQL}
SELECT metric, count(*) AS n, round(max(f1), 6) AS best, round(avg(f1), 6) AS mean FROM log GROUP BY metric""")
def n8_landscape(spark, root):
    land = so.landscape(run_log(spark, root), "metric")
    return land.select("metric", "n", r6("best").alias("best"), r6("mean").alias("mean"))


@register("n9_best_per_param", f"""{_LOG_SQL}
SELECT metric, run_name, round(f1, 6) AS f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY f1 DESC, run_name) AS rn FROM log) WHERE rn = 1""")
def n9_best_per_param(spark, root):
    b = so.best_per_param(run_log(spark, root), "metric")
    return b.select("metric", "run_name", r6("f1").alias("f1"))


@register("n10_degenerate_report", f"""WITH rl AS ({_RUNLOG_SQL})
SELECT run_name, tp, fp, tn, fn FROM rl WHERE tn = 0 OR fn = 0""")
def n10_degenerate_report(spark, root):
    """The advisor's degenerate rule (TN = 0 or FN = 0) over the evaluation run log."""
    return so.degenerate_report(ev_run_log(spark, root)).select("run_name", "tp", "fp", "tn", "fn")


@register("n11_local_slope", f"""{_LOG_SQL},
  sh AS (SELECT metric, threshold, greatest(threshold - 0.05, 0.05) AS lo, least(threshold + 0.05, 0.95) AS hi FROM log),
  pts AS (SELECT metric, threshold, 'lo' AS side, lo AS t FROM sh UNION ALL SELECT metric, threshold, 'hi', hi FROM sh),
  pz AS (SELECT pts.*, ((CASE metric {' '.join(f"WHEN '{k}' THEN {v}" for k, v in so.METRIC_ENCODE.items())} END) - mm) / sm
                AS z_metric, (t - mt) / stt AS z_threshold FROM pts, st),
  e AS (SELECT p.metric, p.threshold, p.side, p.t,
               sum(exp(-((p.z_metric - o.z_metric) * (p.z_metric - o.z_metric) + (p.z_threshold - o.z_threshold)
                        * (p.z_threshold - o.z_threshold)) / (2.0 * {H} * {H})) * o.f1)
               / sum(exp(-((p.z_metric - o.z_metric) * (p.z_metric - o.z_metric) + (p.z_threshold - o.z_threshold)
                        * (p.z_threshold - o.z_threshold)) / (2.0 * {H} * {H}))) AS mu
        FROM pz p, obs o GROUP BY 1, 2, 3, 4)
SELECT l.metric, l.threshold, round((h.mu - l.mu) / (h.t - l.t), 6) AS slope
FROM e l JOIN e h ON l.metric = h.metric AND l.threshold = h.threshold AND l.side = 'lo' AND h.side = 'hi'""")
def n11_local_slope(spark, root):
    """Finite difference of the local F1 estimate along the threshold (+-0.05, clipped to the grid)."""
    log, obs, _, _ = _cands(spark, root)
    enc = log.withColumn("x_metric", so.encode_metric(F.col("metric"))).withColumn("x_threshold", F.col("threshold"))
    stats = so.standardize_stats(enc, ["x_metric", "x_threshold"])
    arr = so.observed_array(obs, ["z_x_metric", "z_x_threshold"], "f1")
    pts = log.select("metric", "threshold", F.explode(F.array(
        F.struct(F.lit("lo").alias("side"), F.greatest(F.col("threshold") - 0.05, F.lit(0.05)).alias("t")),
        F.struct(F.lit("hi").alias("side"), F.least(F.col("threshold") + 0.05, F.lit(0.95)).alias("t")))).alias("p"))
    pts = pts.select("metric", "threshold", "p.side", F.col("p.t").alias("x_threshold"),
                     so.encode_metric(F.col("metric")).alias("x_metric"))
    est = so.local_estimate(so.standardize(pts, stats), arr, ["z_x_metric", "z_x_threshold"], H)
    lo = est.filter("side = 'lo'").select("metric", "threshold", F.col("x_threshold").alias("t_lo"),
                                          F.col("mu").alias("mu_lo"))
    hi = est.filter("side = 'hi'").select("metric", "threshold", F.col("x_threshold").alias("t_hi"),
                                          F.col("mu").alias("mu_hi"))
    j = lo.join(hi, ["metric", "threshold"])
    return j.select("metric", "threshold", r6((F.col("mu_hi") - F.col("mu_lo")) / (F.col("t_hi") - F.col("t_lo")))
                    .alias("slope"))


@register("n11_switch_effect", f"""{_LOG_SQL},
  pz AS (SELECT l.metric, l.threshold, m.metric AS switched_to,
                ((CASE m.metric {' '.join(f"WHEN '{k}' THEN {v}" for k, v in so.METRIC_ENCODE.items())} END) - mm) / sm AS zm,
                (l.threshold - mt) / stt AS zt FROM log l, (SELECT DISTINCT metric FROM log) m, st),
  e AS (SELECT p.metric, p.threshold, p.switched_to,
               sum(exp(-((p.zm - o.z_metric) * (p.zm - o.z_metric) + (p.zt - o.z_threshold) * (p.zt - o.z_threshold))
                       / (2.0 * {H} * {H})) * o.f1)
               / sum(exp(-((p.zm - o.z_metric) * (p.zm - o.z_metric) + (p.zt - o.z_threshold) * (p.zt - o.z_threshold))
                         / (2.0 * {H} * {H}))) AS mu
        FROM pz p, obs o GROUP BY 1, 2, 3)
SELECT a.metric, a.threshold, a.switched_to, round(a.mu - b.mu, 6) AS effect
FROM e a JOIN e b ON b.metric = a.metric AND b.threshold = a.threshold AND b.switched_to = a.metric
WHERE a.switched_to <> a.metric""")
def n11_switch_effect(spark, root):
    """Change of the local F1 estimate if a run takes another metric at its own threshold."""
    log = run_log(spark, root)
    enc = log.withColumn("x_metric", so.encode_metric(F.col("metric"))).withColumn("x_threshold", F.col("threshold"))
    stats = so.standardize_stats(enc, ["x_metric", "x_threshold"])
    arr = so.observed_array(so.standardize(enc, stats), ["z_x_metric", "z_x_threshold"], "f1")

    def estimate(pts):
        x = pts.withColumn("x_metric", so.encode_metric(F.col("metric"))).withColumn("x_threshold", F.col("threshold"))
        return so.local_estimate(so.standardize(x, stats), arr, ["z_x_metric", "z_x_threshold"], H)

    values = [r.metric for r in log.select("metric").distinct().orderBy("metric").collect()]  # the metrics of the log
    out = so.switch_effect(log.select("metric", "threshold"), values, "metric", estimate)
    return out.select("metric", "threshold", "switched_to", r6("effect").alias("effect"))


@register("n12_usable_runs", f"""{_LOG_SQL}
SELECT run_name, metric, threshold FROM log WHERE metric <> 'SUB_IN_ORIG'""")
def n12_usable_runs(spark, root):
    """Legacy rows dropped before fitting: here the sweep's SUB_IN_ORIG runs are
    tagged as an older pooling ('N/A') in the stand-in log columns."""
    log = run_log(spark, root).withColumn("input_mode", F.lit(None).cast("string")).withColumn(
        "pooling", F.when(F.col("metric") == "SUB_IN_ORIG", "N/A").otherwise("mean"))
    return so.usable_runs(log, 3).select("run_name", "metric", "threshold")
