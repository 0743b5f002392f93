"""Parameter search over a run log.

The run log (one row per tried configuration) is small by nature -- one row
per experiment -- but the candidate grid can be large. Candidates stay a
distributed DataFrame; the observed runs reach every candidate as ONE
scalar-subquery value (an array of structs, size-checked by ``observed``),
so the kernel estimate is a per-row ``aggregate`` with no join at all.

The reference fits a Gaussian process; here the surrogate is an RBF-weighted
local average of the observed target (mean and spread), which needs no
single-machine solver (see README).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ordinal encoding of the Dolos metric and the threshold grid.
METRIC_ENCODE = {"COMBINED": 0.0, "MAX": 0.25, "AVG": 0.5, "SUB_IN_ORIG": 0.75, "ORIG_IN_SUB": 1.0}
THRESHOLD_GRID_CENTS = list(range(5, 100, 5))  # 0.05 .. 0.95

# Abramowitz & Stegun 7.1.26 rational approximation of erf
# (|error| <= 1.5e-7); Spark has no erf builtin.
AS_P = 0.3275911
AS_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def encode_metric(c: Column) -> Column:
    """Categorical -> ordinal in [0, 1]; an unknown metric raises at run time."""
    m = F.create_map(*[x for k, v in METRIC_ENCODE.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[c], F.raise_error(F.concat(F.lit("unknown metric: "), c)).cast("double"))


def encode_with_default(c: Column, mapping: dict, default: float) -> Column:
    """N2 for model / pooling / context / quantisation: unknown -> default."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(m[c], F.lit(float(default)))


def erf(x: Column) -> Column:
    ax = F.abs(x)
    t = 1.0 / (1.0 + AS_P * ax)
    a1, a2, a3, a4, a5 = AS_A
    poly = t * (a1 + t * (a2 + t * (a3 + t * (a4 + t * a5))))
    y = 1.0 - poly * F.exp(-ax * ax)
    return F.when(x < 0, -y).otherwise(y)


def norm_cdf(z: Column) -> Column:
    return 0.5 * (1.0 + erf(z / math.sqrt(2.0)))


def norm_pdf(z: Column) -> Column:
    return F.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi)


def candidate_grid(tried: DataFrame, cat_col: str = "metric", num_col: str = "threshold",
                   grid_cents: list[int] = THRESHOLD_GRID_CENTS) -> DataFrame:
    """Every (category, grid threshold) not tried yet.

    Categories come from the log; the numeric grid is exploded per category
    row (a generator, not a join); tried points are removed by a left-anti
    join on the integer-hundredths key (no float equality). Other
    parameters of the log are not part of the key: see ``parameter_grid``.
    """
    cats = tried.select(cat_col).distinct()
    grid = cats.select(cat_col, F.explode(F.array(*[F.lit(c) for c in grid_cents])).alias("cents"))
    done = tried.select(cat_col, F.round(F.col(num_col) * 100).cast("int").alias("cents")).distinct()
    out = grid.join(done, [cat_col, "cents"], "left_anti")
    return out.select(cat_col, (F.col("cents") / 100.0).alias(num_col))


def parameter_grid(dims: dict[str, list], tried: DataFrame) -> DataFrame:
    """N1 in any number of dimensions: every combination of ``dims`` that the log does not hold.

    Combination number i of a distributed range is written in mixed radix, one
    digit a dimension, so the grid needs no join of its dimensions and no list of
    its points. A point is tried if all its values are in one row of the log;
    doubles are compared in hundredths. Repeated values of a dimension count once.
    """
    dims = {c: list(dict.fromkeys(v)) for c, v in dims.items()}
    spark = tried.sparkSession
    digits, total = [], 1
    for c, values in reversed(dims.items()):  # the last dimension varies fastest
        at = F.expr(f"cast((id div {total}) % {max(len(values), 1)} as int)")
        digits.append(F.get(F.array(*[F.lit(v) for v in values]), at).alias(c) if values else F.lit(None).alias(c))
        total *= len(values)

    def key(df):
        return [F.round(F.col(c) * 100).cast("long") if isinstance(v[0], float) else F.col(c) for c, v in dims.items()]

    grid = spark.range(total).select(*reversed(digits))
    if total == 0:
        return grid
    marked = grid.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(key(grid))])
    done = tried.select(*[k.alias(f"_k{i}") for i, k in enumerate(key(tried))]).distinct()
    return marked.join(done, [f"_k{i}" for i in range(len(dims))], "left_anti").select(*dims)


def switch_effect(runs: DataFrame, values: list[str], column: str, estimate) -> DataFrame:
    """N11 for a categorical dimension: what changes if a run switches ``column`` to each other value.

    ``estimate`` maps rows with ``column`` (and the run's other parameters) to the
    same rows with ``mu``. Returns the run's columns, ``switched_to`` and ``effect``.
    """
    keep = [c for c in runs.columns if c != column]
    pts = runs.withColumn("_from", F.col(column)).withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))
    est = estimate(pts)
    base = est.filter(F.col(column).eqNullSafe(F.col("_from"))).select(
        *[F.col(c).alias(f"_b_{c}") for c in keep], F.col("_from").alias("_b"), F.col("mu").alias("_mu"))
    same = F.col("_from") == F.col("_b")
    for c in keep:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    other = est.filter(F.col(column) != F.col("_from")).join(base, same)
    return other.select(F.col("_from").alias(column), *keep, F.col(column).alias("switched_to"),
                        (F.col("mu") - F.col("_mu")).alias("effect"))


def standardize_stats(observed: DataFrame, cols: list[str]) -> dict[str, tuple[Column, Column]]:
    """Mean and population std per feature from the observed rows, as
    scalar subqueries; std 0 -> 1."""
    st = observed.select(F.struct(*[x for i, c in enumerate(cols) for x in (
        F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))])).scalar()  # one pass for all features
    return {c: (st[f"m{i}"], F.when(st[f"s{i}"] > 0, st[f"s{i}"]).otherwise(F.lit(1.0))) for i, c in enumerate(cols)}


def standardize(df: DataFrame, stats: dict[str, tuple[Column, Column]], prefix: str = "z_") -> DataFrame:
    return df.select("*", *[((F.col(c) - mu) / sd).alias(prefix + c) for c, (mu, sd) in stats.items()])


def observed_array(observed: DataFrame, zcols: list[str], target: str) -> Column:
    """The run log as one array<struct> value (scalar subquery), aggregated to
    its distinct parameter points (n, sum y, sum y^2): exact for every size of
    log, and bounded by the parameter grid, not by the number of runs."""
    points = observed.filter(F.col(target).isNotNull()).groupBy(*zcols).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(target).alias("sy"),
        F.sum(F.col(target) * F.col(target)).alias("syy"))
    return points.select(F.collect_list(F.struct(*[F.col(c).alias(f"x{i}") for i, c in enumerate(zcols)],
                                                 "n", "sy", "syy"))).scalar()


def local_estimate(cands: DataFrame, obs: Column, zcols: list[str], h: float = 1.0) -> DataFrame:
    """RBF-weighted mean ``mu`` and spread ``sigma`` of the target around
    each candidate: w = exp(-d^2 / (2 h^2)) over standardized features."""
    def w(o):
        d2 = None
        for i, c in enumerate(zcols):
            term = (F.col(c) - o[f"x{i}"]) * (F.col(c) - o[f"x{i}"])
            d2 = term if d2 is None else d2 + term
        return F.exp(-d2 / (2.0 * h * h))

    zero = F.struct(F.lit(0.0).alias("sw"), F.lit(0.0).alias("swy"), F.lit(0.0).alias("swy2"))
    # The scalar subquery is projected first: subqueries may not sit inside
    # a higher-order function, a column reference may.
    cands = cands.withColumn("_obs", obs)
    acc = F.aggregate(F.col("_obs"), zero, lambda a, o: F.struct(
        (a["sw"] + w(o) * o["n"]).alias("sw"), (a["swy"] + w(o) * o["sy"]).alias("swy"),
        (a["swy2"] + w(o) * o["syy"]).alias("swy2")))
    x = cands.withColumn("_acc", acc)
    cols = [c for c in cands.columns if c != "_obs"]
    mu = F.when(F.col("_acc.sw") > 0, F.col("_acc.swy") / F.col("_acc.sw"))
    var = F.when(F.col("_acc.sw") > 0, F.col("_acc.swy2") / F.col("_acc.sw")) - mu * mu
    return x.select(*cols, mu.alias("mu"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sigma"))


def expected_improvement(df: DataFrame, f_best: Column, xi: float = 0.01) -> DataFrame:
    """EI = imp * Phi(z) + sigma * phi(z), imp = mu - f_best - xi,
    0 where sigma <= 1e-9, clipped at 0."""
    imp = F.col("mu") - f_best - xi
    z = F.when(F.col("sigma") > 1e-9, imp / F.col("sigma")).otherwise(F.lit(0.0))
    ei = imp * norm_cdf(z) + F.col("sigma") * norm_pdf(z)
    ei = F.when(F.col("sigma") <= 1e-9, F.lit(0.0)).otherwise(F.greatest(ei, F.lit(0.0)))
    return df.withColumn("ei", ei)


def diverse_top(df: DataFrame, n: int, min_dist: float, zcols: list[str], order: list[Column]) -> DataFrame:
    """Walk candidates by descending EI, skipping any nearer than
    ``min_dist`` (standardized distance) to one already chosen.

    n rounds; each round is one distributed argmax over the remaining
    candidates (``limit(1)``) and brings back one row; the distance filter
    runs on the executors.
    """
    from ..session import cut_lineage

    chosen = []
    df = cut_lineage(df)  # scored once; the rounds re-read the checkpoint
    rest = df
    for _ in range(n):
        top = rest.orderBy(*order).limit(1).collect()
        if not top:
            break
        row = top[0]
        chosen.append(row)
        d2 = None
        for c in zcols:
            t = (F.col(c) - F.lit(row[c])) * (F.col(c) - F.lit(row[c]))
            d2 = t if d2 is None else d2 + t
        rest = rest.filter(F.sqrt(d2) >= min_dist)
    spark = df.sparkSession
    out = spark.createDataFrame(chosen, schema=df.schema) if chosen else df.limit(0)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def suggestion_notes(df: DataFrame, f_best: Column) -> DataFrame:
    """N7: 'exploit' when mu > f_best, 'explore' when sigma is above the 75th
    percentile of the candidates' sigma, else ''."""
    p75 = df.select(F.percentile("sigma", 0.75)).scalar()
    note = (F.when(F.col("mu") > f_best, F.lit("likely better than the best run"))
            .when(F.col("sigma") > p75, F.lit("uncertain region")).otherwise(F.lit("")))
    return df.withColumn("note", note)


def landscape(runs: DataFrame, col: str, target: str = "f1") -> DataFrame:
    """Count, max and mean of the target per parameter value."""
    return runs.groupBy(col).agg(F.count(F.lit(1)).alias("n"), F.max(target).alias("best"),
                                 F.avg(target).alias("mean"))


def best_per_param(runs: DataFrame, col: str, target: str = "f1", tie: str = "run_name") -> DataFrame:
    """Best row per parameter value (ties -> smallest ``tie``)."""
    w = Window.partitionBy(col).orderBy(F.desc(target), F.asc(tie))
    return runs.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def degenerate_report(runs: DataFrame) -> DataFrame:
    """The advisor's rule TN = 0 or FN = 0 (rows are kept, only reported)."""
    return runs.filter((F.col("tn") == 0) | (F.col("fn") == 0))


def usable_runs(runs: DataFrame, min_n: int = 3) -> DataFrame:
    """Drop legacy rows (input_mode other than 'single' after null-fill,
    pooling 'N/A'); raises when fewer than ``min_n`` remain."""
    ok = runs.filter((F.coalesce(F.col("input_mode"), F.lit("single")) == "single")
                     & (F.coalesce(F.col("pooling"), F.lit("")) != "N/A"))
    n = ok.count()
    if n < min_n:
        raise ValueError(f"need at least {min_n} usable runs, have {n}")
    return ok
