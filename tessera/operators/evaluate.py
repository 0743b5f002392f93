"""Evaluation of detectors against labels.

Inputs are prediction tables with at least ``run_name``, ``similarity``
(double) and ``is_plagiarized`` (boolean), plus group columns. Every metric is
an aggregation keyed by run (and group): map-side partial counts, one shuffle.
AUC and ROC first collapse each run to its distinct scores (bounded by the
score resolution, 10^4 after 4-digit rounding), so the cumulative windows run
over a small table, never over all predictions. Scores that are not rounded
go through ``running_counts``: ranges of scores, each counted by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# The level taxonomy and its order.
LEVELS = ["L1", "L2", "L3", "L4", "L5", "L6", "non-plag"]
# Tool order used to break ties between tools.
TOOLS = ["JPlag", "Dolos", "SIM", "Plaggie", "Oreo", "CodeBERT", "CodeLlama"]

COUNT_COLS = ("tp", "fp", "tn", "fn")
METRIC_COLS = ("precision", "recall", "f1", "accuracy", "mcc")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))


def predict(df: DataFrame, threshold, score: str = "similarity", out: str = "predicted_plag") -> DataFrame:
    """M1: inclusive cut ``score >= threshold`` (a column name or a number)."""
    t = _c(threshold) if isinstance(threshold, (str, Column)) else F.lit(float(threshold))
    return df.withColumn(out, _c(score) >= t)


def confusion_aggs(pred: str = "predicted_plag", truth: str = "is_plagiarized") -> list[Column]:
    p, y = _c(pred), _c(truth)
    return [F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
            F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn")]


def confusion(df: DataFrame, keys: list[str], pred: str = "predicted_plag",
              truth: str = "is_plagiarized") -> DataFrame:
    """M2: tp, fp, tn, fn per key."""
    return df.groupBy(*keys).agg(*confusion_aggs(pred, truth))


def metric_columns(tp="tp", fp="fp", tn="tn", fn="fn") -> list[Column]:
    """M3: precision, recall, F1, accuracy, MCC; zero denominators give 0."""
    tp, fp, tn, fn = (_c(x).cast("double") for x in (tp, fp, tn, fn))
    p = safe_div(tp, tp + fp)
    r = safe_div(tp, tp + fn)
    f1 = F.when((p + r) != 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    acc = safe_div(tp + tn, tp + fp + tn + fn)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.when(den != 0, (tp * tn - fp * fn) / den).otherwise(F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), f1.alias("f1"), acc.alias("accuracy"), mcc.alias("mcc")]


def with_metrics(counts: DataFrame) -> DataFrame:
    return counts.select("*", *metric_columns())


def score_histogram(df: DataFrame, keys: list[str], score: str = "similarity",
                    truth: str = "is_plagiarized") -> DataFrame:
    """(keys, score, pos, neg): predictions collapsed to distinct scores."""
    y = _c(truth)
    return df.groupBy(*keys, score).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))


def auc(df: DataFrame, keys: list[str], score: str = "similarity", truth: str = "is_plagiarized",
        auc_default: float | None = None) -> DataFrame:
    """M4: exact ROC AUC with ties counted half (Mann-Whitney), per key.

    Numerator kept in integers: 2*sum(pos*neg_below) + sum(pos*neg_tied),
    over 2*P*N. One class -> NULL (or ``auc_default``).
    """
    h = score_histogram(df, keys, score, truth)
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("neg_below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    g = h.groupBy(*keys).agg(
        (2 * F.sum(F.col("pos") * F.col("neg_below")) + F.sum(F.col("pos") * F.col("neg"))).alias("num"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    val = F.when((F.col("P") > 0) & (F.col("N") > 0),
                 F.col("num").cast("double") / (2.0 * F.col("P") * F.col("N")))
    if auc_default is not None:
        val = val.otherwise(F.lit(float(auc_default)))
    return g.select(*keys, val.alias("auc"))


def roc_curve(df: DataFrame, keys: list[str], score: str = "similarity",
              truth: str = "is_plagiarized") -> DataFrame:
    """M5: one point per distinct score (descending cut) plus the (0,0) start.

    All points are kept (no collinear-point dropping). ``threshold`` is the
    score used as inclusive cut; the start point has a NULL threshold.
    """
    h = score_histogram(df, keys, score, truth)
    w = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(*keys)
    pts = h.select(*keys, F.col(score).alias("threshold"),
                   F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
                   F.sum("pos").over(tot).alias("P"), F.sum("neg").over(tot).alias("N"))
    start = h.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("tp"),
        F.lit(0).cast("long").alias("fp"), "P", "N")
    pts = pts.unionByName(start)
    return pts.select(*keys, "threshold", "tp", "fp",
                      safe_div(F.col("tp"), F.col("P")).alias("tpr"),
                      safe_div(F.col("fp"), F.col("N")).alias("fpr"))


def running_counts(df: DataFrame, keys: list[str], score: str = "similarity", truth: str = "is_plagiarized") -> DataFrame:
    """(keys, score, pos, neg, pos_below, neg_below, P, N) per distinct score, for any number of distinct scores.

    The distinct scores are dealt into ranges of (keys, score), written, and
    counted within their range; a small table with a row for each range of a key
    gives what lies below a range. No task holds more than a range, also where
    one key has all scores. Rows without a score or truth are left out; NaN is the
    highest score; an empty table gives an empty table.
    """
    src = df.filter(_c(score).isNotNull() & _c(truth).isNotNull())
    h = score_histogram(src, keys, score, truth)
    h = cut_lineage(h.repartitionByRange(*keys, score).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    base = h.groupBy(*keys, "_range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}_before") for c in ("p", "n")],
        F.sum("p").over(whole).alias("P"), F.sum("n").over(whole).alias("N"))
    own = h.select(*keys, score, "pos", "neg", "_range",
                   *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_{c}_inside") for c in ("pos", "neg")])
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return own.join(base, same).select(
        *keys, score, "pos", "neg", (F.col("_pos_inside") + F.col("_p_before")).alias("pos_below"),
        (F.col("_neg_inside") + F.col("_n_before")).alias("neg_below"), "P", "N")


def auc_from_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, P, N, auc) of ``running_counts``; the numerator is summed beyond 64 bits."""
    wide = "decimal(19,0)"
    g = counts.groupBy(*keys).agg(
        F.max("P").alias("P"), F.max("N").alias("N"),
        F.sum(F.col("pos").cast(wide) * (2 * F.col("neg_below") + F.col("neg")).cast(wide)).alias("_num"))
    return g.select(*keys, "P", "N", F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_num").cast("double")
                                            / (2.0 * F.col("P") * F.col("N"))).alias("auc"))


def auc_unrounded(df: DataFrame, keys: list[str], score: str = "similarity", truth: str = "is_plagiarized") -> DataFrame:
    """M4 for scores of any resolution: (keys, P, N, auc), exact, ties counted half; one class -> NULL."""
    return auc_from_counts(running_counts(df, keys, score, truth), keys)


def roc_curve_unrounded(df: DataFrame, keys: list[str], score: str = "similarity",
                        truth: str = "is_plagiarized") -> DataFrame:
    """M5 for scores of any resolution: the rows of ``roc_curve``, its start point included."""
    c = cut_lineage(running_counts(df, keys, score, truth))
    pts = c.select(*keys, F.col(score).cast("double").alias("threshold"), (F.col("P") - F.col("pos_below")).alias("tp"),
                   (F.col("N") - F.col("neg_below")).alias("fp"), "P", "N")
    zero = F.lit(0).cast("long")
    start = c.groupBy(*keys).agg(F.max("P").alias("P"), F.max("N").alias("N")).select(
        *keys, F.lit(None).cast("double").alias("threshold"), zero.alias("tp"), zero.alias("fp"), "P", "N")
    return pts.unionByName(start).select(*keys, "threshold", "tp", "fp", safe_div(F.col("tp"), F.col("P")).alias("tpr"),
                                         safe_div(F.col("fp"), F.col("N")).alias("fpr"))


def class_quantiles(df: DataFrame, keys: list[str], qs: tuple[float, ...] = (0.25, 0.5, 0.75), score: str = "similarity",
                    truth: str = "is_plagiarized") -> DataFrame:
    """M15 for scores of any resolution: (keys, truth, n, q_0, q_1, ...), exact quantiles by linear interpolation.

    The place of a quantile is known from the counts, so its two neighbours are
    picked out of the running counts: nothing is buffered or sorted by key. A key
    without a row of a class has no row for it.
    """
    c = running_counts(df, keys, score, truth)
    sides = F.array(*[F.struct(F.lit(flag).alias("_truth"), F.col(k).alias("_n"), F.col(f"{k}_below").alias("_below"),
                               F.col(total).alias("n")) for flag, k, total in ((True, "pos", "P"), (False, "neg", "N"))])
    rows = c.select(*keys, F.col(score).cast("double").alias("_score"), F.inline(sides)).filter("_n > 0")

    def at(place: Column) -> Column:  # the score that holds the place, counted from 0
        return F.max(F.when((F.col("_below") <= place) & (place < F.col("_below") + F.col("_n")), F.col("_score")))

    picks, ends = [], []
    for i, q in enumerate(qs):
        place = (F.col("n") - 1) * F.lit(float(q))
        picks += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}")]
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        # equal neighbours need no interpolation (and would lose bits in it)
        ends.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (place - F.floor(place))).alias(f"q_{i}"))
    got = rows.groupBy(*keys, "_truth", "n").agg(*picks)
    return got.select(*keys, F.col("_truth").alias(truth), "n", *ends)


def run_metrics(preds: DataFrame, keys: list[str], auc_default: float | None = None) -> DataFrame:
    """M2-M4 together for predictions that already carry ``predicted_plag``."""
    c = with_metrics(confusion(preds, keys))
    return c.join(auc(preds, keys, auc_default=auc_default), keys, "left")


def _with_threshold(preds: DataFrame, runs: DataFrame) -> DataFrame:
    """Attach each run's stored threshold (the runs table is one row per run)."""
    return preds.drop("threshold").join(runs.select("run_name", "threshold"), "run_name")


def global_metrics(preds: DataFrame, runs: DataFrame) -> DataFrame:
    """M6: metrics per run at its stored threshold (runs: run_name, threshold).

    The analyzer recomputes the prediction from the score; the stored
    ``predicted_plag`` is ignored.
    """
    p = predict(_with_threshold(preds, runs), "threshold")
    return run_metrics(p, ["run_name"]).join(runs.select("run_name", "threshold"), "run_name")


def group_metrics(preds: DataFrame, runs: DataFrame, case_col: str = "case",
                  level_col: str = "level") -> DataFrame:
    """M7: metrics per run, per (run, level) and per (run, case) in one
    GROUPING SETS aggregation. Levels of the fixed taxonomy without rows get
    zero counts and NULL metrics.

    Output: run_name, group_type ('all'|'level'|'case'), group_value, counts, metrics, auc.
    """
    p = predict(_with_threshold(preds, runs), "threshold")
    p = p.select("run_name", F.col(level_col).alias("level"), F.col(case_col).alias("case"),
                 "similarity", "is_plagiarized", "predicted_plag")
    agg = (p.groupingSets([["run_name"], ["run_name", "level"], ["run_name", "case"]], "run_name", "level", "case")
           .agg(*confusion_aggs(), F.grouping_id().alias("gid")))
    gtype = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "level").otherwise("case")
    gval = F.when(F.col("gid") == 3, F.lit("all")).when(F.col("gid") == 1, F.col("level")).otherwise(F.col("case"))
    counts = agg.select("run_name", gtype.alias("group_type"), gval.alias("group_value"), *COUNT_COLS)
    # AUC per group: histogram per (run, group) from the same scan.
    keyed = p.select("run_name", "similarity", "is_plagiarized",
                     F.explode(F.array(
                         F.struct(F.lit("all").alias("t"), F.lit("all").alias("v")),
                         F.struct(F.lit("level").alias("t"), F.col("level").alias("v")),
                         F.struct(F.lit("case").alias("t"), F.col("case").alias("v")))).alias("g"))
    keyed = keyed.select("run_name", F.col("g.t").alias("group_type"), F.col("g.v").alias("group_value"),
                         "similarity", "is_plagiarized")
    aucs = auc(keyed, ["run_name", "group_type", "group_value"])
    # Fixed level dimension per run: explode a literal list, no cartesian join.
    level_dim = runs.select("run_name", F.lit("level").alias("group_type"),
                            F.explode(F.array(*[F.lit(x) for x in LEVELS])).alias("group_value"))
    counts = counts.join(level_dim, ["run_name", "group_type", "group_value"], "full_outer")
    counts = counts.select("run_name", "group_type", "group_value",
                           *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in COUNT_COLS])
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    out = counts.select("*", *metric_columns())
    out = out.select("run_name", "group_type", "group_value", *COUNT_COLS,
                     *[F.when(n > 0, F.col(m)).alias(m) for m in METRIC_COLS])
    return out.join(aucs, ["run_name", "group_type", "group_value"], "left")


def f1_matrix(gm: DataFrame, run_names: list[str], group_type: str = "level") -> DataFrame:
    """M8: groups x runs pivot of F1 (explicit pivot values: no extra job)."""
    return (gm.filter(F.col("group_type") == group_type).groupBy("group_value")
            .pivot("run_name", run_names).agg(F.first("f1")))


def degenerate(tn="tn", tp="tp", fp="fp") -> Column:
    """M9 rule: TN = 0 or TP = 0 or FP = 0."""
    return (_c(tn) == 0) | (_c(tp) == 0) | (_c(fp) == 0)


def prune_degenerate(runs: DataFrame) -> DataFrame:
    """M9: drop degenerate runs."""
    return runs.filter(~degenerate())


def best_run_per_tool(runs: DataFrame, metric: str = "mcc", order_col: str = "run_ord") -> DataFrame:
    """Per tool, the first non-degenerate run with the highest metric;
    NULL / NaN metrics are skipped (Spark would sort NaN as largest)."""
    ok = prune_degenerate(runs).filter(F.col(metric).isNotNull() & ~F.isnan(metric))
    w = Window.partitionBy("tool").orderBy(F.desc(metric), F.asc(order_col))
    return ok.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def tool_order() -> Column:
    """Position of a tool in the fixed order (unknown tools last)."""
    return F.coalesce(F.array_position(F.array(*[F.lit(t) for t in TOOLS]), F.col("tool")).cast("int"),
                      F.lit(len(TOOLS) + 1))


def best_tool_per_level(gm: DataFrame) -> DataFrame:
    """Per level L1..L6 the tool with the best F1 (NULL excluded; ties
    go to the earlier tool in the fixed order)."""
    lv = gm.filter((F.col("group_type") == "level") & F.col("group_value").isin(LEVELS[:6])
                   & F.col("f1").isNotNull() & ~F.isnan("f1"))
    w = Window.partitionBy("group_value").orderBy(F.desc("f1"), F.asc("tool_ord"), F.asc("tool"))
    return lv.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def level_order() -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level")).cast("int")


def class_distribution(preds: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Per key and class, quartiles (linear interpolation), min, max,
    count, and a density histogram of ``bins`` equal bins on [0, 1]."""
    stats = preds.groupBy(*keys, "is_plagiarized").agg(
        F.count(F.lit(1)).alias("n"), F.min("similarity").alias("min_sim"), F.max("similarity").alias("max_sim"),
        F.percentile("similarity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    stats = stats.select(*keys, "is_plagiarized", "n", "min_sim", "max_sim",
                         F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    b = F.least(F.floor(F.col("similarity") * bins), F.lit(bins - 1)).cast("int")
    hist = preds.groupBy(*keys, "is_plagiarized", b.alias("bin")).agg(F.count(F.lit(1)).alias("bin_count"))
    return stats.join(hist, [*keys, "is_plagiarized"])


def sweep_index(score: Column, steps: int) -> Column:
    """Largest i in [-1, steps] with i/steps <= score (float-safe, -1 = below every cut)."""
    b = F.floor(score * steps).cast("int")
    b = (F.when((b + 1) / F.lit(float(steps)) <= score, b + 1)
         .when(b / F.lit(float(steps)) > score, b - 1).otherwise(b))
    return F.least(F.greatest(b, F.lit(-1)), F.lit(steps))


def threshold_sweep(preds: DataFrame, keys: list[str], steps: int = 200) -> DataFrame:
    """Metrics at every cut t = i/steps, i = 0..steps, without a
    scores x thresholds product: scores are bucketed by the highest cut they
    pass, then counts are accumulated from the top cut down per key."""
    y = F.col("is_plagiarized")
    bucket = preds.groupBy(*keys, sweep_index(F.col("similarity"), steps).alias("i")).agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    grid = preds.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i"))
    g = grid.join(bucket, [*keys, "i"], "left").fillna(0, ["pos", "neg"])
    w = Window.partitionBy(*keys).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(*keys)
    # Scores below cut 0 (negative) sit in bucket -1: only in the totals.
    below = bucket.filter("i < 0").groupBy(*keys).agg(F.sum("pos").alias("pos_lo"), F.sum("neg").alias("neg_lo"))
    g = g.join(below, keys, "left").fillna(0, ["pos_lo", "neg_lo"])
    c = g.select(*keys, (F.col("i") / F.lit(float(steps))).alias("threshold"),
                 F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
                 (F.sum("pos").over(tot) + F.col("pos_lo")).alias("P"),
                 (F.sum("neg").over(tot) + F.col("neg_lo")).alias("N"))
    c = c.select(*keys, "threshold", "tp", "fp", (F.col("N") - F.col("fp")).alias("tn"),
                 (F.col("P") - F.col("tp")).alias("fn"))
    return with_metrics(c)


def best_threshold(sweep: DataFrame, keys: list[str], metric: str = "f1") -> DataFrame:
    """Best cut per key by ``metric``; ties go to the lowest threshold."""
    w = Window.partitionBy(*keys).orderBy(F.desc(metric), F.asc("threshold"))
    return sweep.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def param_sweep(scores: DataFrame, metrics: list[str], thresholds: list[float], id_cols: list[str],
                a_col: str = "orig_in_sub", b_col: str = "sub_in_orig") -> DataFrame:
    """Many runs from one cached directional score table.

    Each row is expanded to one score per metric (explode of an array of
    structs), then to one prediction per threshold (explode of a literal
    array), and one aggregation keyed by (metric, threshold) counts them.
    """
    from .fingerprint import metric_expr

    a, b = F.col(a_col), F.col(b_col)
    per_metric = F.array(*[F.struct(F.lit(m.upper()).alias("metric"),
                                    metric_expr(m, a, b, None if m != "combined" else F.col("combined"))
                                    .alias("similarity")) for m in metrics])
    x = scores.select(*id_cols, "is_plagiarized", F.inline(per_metric))
    x = x.select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    x = x.withColumn("predicted_plag", F.col("similarity") >= F.col("threshold"))
    return with_metrics(confusion(x, ["metric", "threshold"]))


def run_name(tool: str, params: list[tuple[str, Column, str]]) -> Column:
    """E.g. Dolos-Threshold-0.25-KGram-23-Window-17-Metric-MAX.

    ``params`` = [(label, column, printf format)], formats like '%.2f', '%d', '%s'.
    """
    parts = [F.lit(tool)]
    for label, col, fmt in params:
        parts += [F.lit(label), F.format_string(fmt, col)]
    return F.concat_ws("-", *parts)


def data_summary(preds: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows, positives and threshold per run."""
    s = preds.groupBy("run_name").agg(F.count(F.lit(1)).alias("rows"),
                                      F.count_if(F.col("is_plagiarized")).alias("positives"))
    return s.join(runs.select("run_name", "threshold"), "run_name")


def match_rate(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Submissions with a score > 0, of all, per key."""
    return preds.groupBy(*keys).agg(F.count_if(F.col("similarity") > 0).alias("matched"),
                                    F.count(F.lit(1)).alias("total")).withColumn(
        "match_rate", safe_div(F.col("matched"), F.col("total")))
