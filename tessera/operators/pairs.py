"""Pair scopes, orientation, clusters and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def max_over_anchors(subs: DataFrame, pair_scores: DataFrame, key: str, score_cols: list[str]) -> DataFrame:
    """L1 / H5: every submission gets a row; each score column is the max over
    its pairs (directions maxed separately), 0.0 when it has no pair.

    The pair table is aggregated to one row per submission *before* the join
    (partial aggregation map-side), so the join is one-to-one.
    """
    best = pair_scores.groupBy(key).agg(*[F.max(c).alias(c) for c in score_cols])
    out = subs.join(best, key, "left")
    return out.select(*[c for c in subs.columns], *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in score_cols])


def anchor_scores(subs: DataFrame, pair_scores: DataFrame, sub_col: str = "sub_id",
                  score_col: str = "similarity") -> DataFrame:
    """L1: score per submission against its case's original(s); a submission
    without any matching pair still gets a row with score 0.0."""
    return max_over_anchors(subs, pair_scores, sub_col, [score_col])


def orient_pairs(pairs: DataFrame, left: str, right: str, is_orig_left: Column, is_orig_right: Column,
                 swap_cols: list[tuple[str, str]] = ()) -> DataFrame:
    """L4: orient each pair original-first; pairs without an original side
    are dropped. ``swap_cols`` lists (left_col, right_col) pairs swapped along."""
    keep = pairs.filter(is_orig_left | is_orig_right)
    flip = ~is_orig_left & is_orig_right
    cols = [F.when(flip, F.col(right)).otherwise(F.col(left)).alias(left),
            F.when(flip, F.col(left)).otherwise(F.col(right)).alias(right)]
    for a, b in swap_cols:
        cols += [F.when(flip, F.col(b)).otherwise(F.col(a)).alias(a),
                 F.when(flip, F.col(a)).otherwise(F.col(b)).alias(b)]
    used = {left, right, *[x for ab in swap_cols for x in ab]}
    return keep.select(*cols, *[c for c in pairs.columns if c not in used])


# Corpus path layout (case-NN/original, plagiarized/L?/NN, non-plagiarized/NN).
PLAG_PATH_RE = r"/plagiarized/(L[1-6])/([0-9]+)/"
NONPLAG_PATH_RE = r"/non-plagiarized/([0-9]+)/"
ORIGINAL_PATH_RE = r"/original/"
CASE_PATH_RE = r"(case-[0-9]+)"


def path_key(path) -> Column:
    """Path -> 'original' | 'plag_L3_02' | 'nonplag_04' | NULL."""
    p = F.col(path) if isinstance(path, str) else path
    lvl = F.regexp_extract(p, PLAG_PATH_RE, 1)
    pid = F.regexp_extract(p, PLAG_PATH_RE, 2)
    nid = F.regexp_extract(p, NONPLAG_PATH_RE, 1)
    return (F.when(p.rlike(ORIGINAL_PATH_RE), F.lit("original"))
            .when(lvl != "", F.concat(F.lit("plag_"), lvl, F.lit("_"), pid))
            .when(nid != "", F.concat(F.lit("nonplag_"), nid)))


def clusters(edges: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """Connected components of the similarity graph (node, cluster = min node id).

    Each round: min-label propagation over the edges (edge join + groupBy
    min, partial aggregation map-side), then pointer jumping -- every node
    also takes its label's label -- so labels travel along long paths in
    O(log diameter) rounds. Labels always stay inside the component, so the
    fixpoint is the component minimum. The label table is checkpointed to the
    shared checkpoint folder every round (lineage one round deep; a lost
    executor recomputes at most one round). Stops when no label changes.
    """
    e = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    e = cut_lineage(e)
    labels = e.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    labels = cut_lineage(labels)
    while True:
        prop = e.join(labels, e.src == labels.node).select(F.col("dst").alias("node"), "label")
        new = labels.unionByName(prop).groupBy("node").agg(F.min("label").alias("label"))
        jump = new.join(new.select(F.col("node").alias("label"), F.col("label").alias("label2")), "label", "left")
        new = jump.select("node", F.least("label", F.coalesce("label2", "label")).alias("label"))
        new = cut_lineage(new)
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old").limit(1).count()
        labels = new
        if changed == 0:
            return labels.withColumnRenamed("label", "cluster")


def similarity_distribution(pairs: DataFrame, score: str = "similarity", bins: int = 10,
                            keys: tuple[str, ...] = (), count: str | None = None) -> DataFrame:
    """Histogram of pair scores on [0, 1] in ``bins`` equal bins (1.0 in the
    last); ``count`` names a column with the number of pairs a row stands for."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    n = F.sum(count) if count else F.count(F.lit(1))
    return pairs.groupBy(*keys, b.alias("bin")).agg(n.alias("n_pairs"))


def outliers(pairs: DataFrame, score: str = "similarity", z: float = 3.0) -> DataFrame:
    """Pairs whose score lies more than ``z`` population deviations above
    the mean (statistics from one global aggregate, joined as one row)."""
    st = pairs.select(F.struct(F.avg(score).alias("mu"), F.stddev_pop(score).alias("sd"))).scalar()
    return pairs.filter((st["sd"] > 0) & ((F.col(score) - st["mu"]) / st["sd"] > z))


def top_pairs(pairs: DataFrame, n: int, order: list[Column], keys: tuple[str, ...] = (), salts: int = 16) -> DataFrame:
    """Top ``n`` rows (n = -1 keeps all), globally or per key group.

    Global: ``orderBy().limit()`` (per-partition top-n, then a merge). Per
    group, exactly and without ranking a whole group in one task: rows are
    first ranked inside (group, salt) sub-groups and only each sub-group's
    top n survive -- the group's top n is contained in their union -- then
    one final ranking per group runs over at most n * salts rows.
    """
    if n < 0:
        return pairs
    if not keys:
        return pairs.orderBy(*order).limit(n)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in pairs.columns]), F.lit(salts))
    x = pairs.withColumn("_salt", salt)
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    x = x.withColumn("_rn", F.row_number().over(w1)).filter(F.col("_rn") <= n).drop("_rn", "_salt")
    w = Window.partitionBy(*keys).orderBy(*order)
    return x.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
