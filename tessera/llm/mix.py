"""Operator 4, mixing sources to target weights.

Sizes are word counts. Targets come from weights by water-filling: the budget
is shared by weight, a source is capped at ``max_epochs`` times its size, and
the excess is shared again by weight until no source is above its cap.

Documents get a hash-random key, are range-sorted by (source, key), and a
distributed running sum of sizes inside each source gives every document its
place. A source that takes ``target`` words takes whole epochs of all its
documents first and then the documents up to its exact remaining budget; the
document at the cut is taken in part, so a source takes floor(target) words.

Nothing is gathered per source: a source with a third of all rows is split
into range chunks (``common.running_sum``). Only the per-source table is
visited once per water-filling round, and the driver sees two numbers a round.

Defined results: null texts have size 0 and take 0; a null source is a source
of its own, last in the order; repeated rows are documents of their own; ties
of the key fall back to (doc_id, size), and rows equal in those take
interchangeable places. An empty table gives an empty mix. Input columns named
like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, running_sum, written

WEIGHTS = (3, 1, 2)          # repeated over the sources in code-point order, null last
SHARE = (3, 2)               # the mix holds 3/2 of all sizes
MAX_EPOCHS = 2
SEED = "mix-1"


def with_sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("size", F.coalesce(
        F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD_RE)), F.lit(0)).cast("long"))


def source_weights(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """sources (source, source_size) plus ``weight`` by place in code-point order, null last."""
    numbered = running_sum(sources.withColumn("__one", F.lit(1).cast("long")).withColumn("__all", F.lit(0)),
                           "__all", [F.col("source").asc_nulls_last()], "__one", "__place", "mix-places")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__place") % len(weights) + 1).cast("int"))
    return numbered.withColumn("weight", weight.cast("long")).drop("__one", "__all", "__place")


def targets(weighted: DataFrame, share=SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """weighted (source, source_size, weight) plus ``target``: water-filling.

    Each round caps the sources whose share is above their cap; a capped
    source stays capped because the level only rises, so the loop ends after
    at most as many rounds as there are distinct size-to-weight ratios.
    """
    total = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    budget = total * share[0] / share[1]
    cap = F.lit(max_epochs) * F.col("source_size")
    level, capped = None, F.lit(False)
    while True:
        got = weighted.agg(F.sum(F.when(capped, cap).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight"))),
                           F.sum(F.when(capped, 1).otherwise(0))).first()
        n_capped = got[2] or 0
        if not got[1]:  # no source is left under its cap
            return weighted.withColumn("target", cap.cast("double"))
        level = (budget - got[0]) / got[1]
        above = F.col("weight") * F.lit(level) > cap
        now = weighted.filter(above).count()
        if now <= n_capped:
            return weighted.withColumn("target", F.when(capped, cap.cast("double"))
                                       .otherwise(F.col("weight") * F.lit(level)))
        capped = above


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix as a manifest: doc_id, source, size, source_size, target, taken.

    ``taken`` counts words, repeats included: 0 to ``max_epochs`` times size.
    """
    thin = written(with_sizes(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                          F.col(text_col).alias("__text")), "__text").drop("__text")
                   .withColumn("__key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"),
                                                                                       F.lit("null")))))
                   .withColumn("__row", F.monotonically_increasing_id()), "mix-sizes")
    per_source = written(thin.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    goal = written(targets(written(source_weights(per_source, weights), "mix-weights"), share, max_epochs),
                   "mix-targets").select(F.col("source").alias("__s"), "source_size", "target")
    placed = running_sum(thin, "source", [F.col("__key"), F.col("doc_id"), F.col("size"), F.col("__row")],
                         "size", "__before", "mix-keys")
    joined = placed.join(goal, F.col("source").eqNullSafe(F.col("__s")))
    epochs = F.when(F.col("source_size") > 0,
                    F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor("target").cast("long") - F.col("__epochs") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("__before")))
    return (joined.withColumn("__epochs", epochs)
            .withColumn("taken", F.col("__epochs") * F.col("size") + part)
            .select("doc_id", "source", "size", "source_size", "target", "taken"))
