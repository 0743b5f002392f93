"""Detection plans: corpus -> fingerprints -> pairs -> directional scores.

Test-table mapping: ``benchmark`` rows are the originals (anchors),
``documents`` rows are the submissions, ``lang`` plays the case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..operators import fingerprint as fpo
from ..sources.tables import table

K, W = 5, 4  # word-level defaults (23/17 are the code-level ones)


def word_docs(spark: SparkSession, root: str, name: str = "documents", id_col: str = "doc_id",
              keep: tuple[str, ...] = ()) -> DataFrame:
    return table(spark, root, name).select(F.col(id_col).alias("doc_id"), *keep,
                                           word_tokens("text").alias("tokens"))


def doc_hash_table(docs: DataFrame, k: int = K, w: int = W, hash_fn: str = "md5",
                   keep: tuple[str, ...] = ()) -> DataFrame:
    fp = fpo.fingerprints(docs, k=k, w=w, hash_fn=hash_fn, keep=keep)
    return fpo.doc_hash_rows(fp, keep=keep, docs=docs)


def anchor_coverage(spark: SparkSession, root: str, k: int = K, w: int = W, hash_fn: str = "md5",
                    max_df: int | None = None) -> DataFrame:
    """Coverage of every (benchmark item, document) pair sharing a fingerprint.

    ``max_df`` drops fingerprints held by more than max_df documents (counted
    on the submissions) before the join.
    """
    orig = doc_hash_table(word_docs(spark, root, "benchmark", "item_id"), k, w, hash_fn)
    if max_df is not None:
        subs = doc_hash_table(word_docs(spark, root), k, w, hash_fn)
        subs = fpo.drop_common(subs, max_df=max_df)
        orig = fpo.drop_common(orig, max_df=max_df, df_source=subs)
        pairs = fpo.anchor_candidates(orig, subs)
    else:
        sub_index = fpo.fingerprint_index(fpo.fingerprints(word_docs(spark, root), k=k, w=w, hash_fn=hash_fn))
        pairs = fpo.anchor_candidates_from_index(orig, sub_index)
    a = fpo.ratio("covered_a", "total_a")
    b = fpo.ratio("covered_b", "total_b")
    comb = fpo.ratio(F.col("covered_a") + F.col("covered_b"), F.col("total_a") + F.col("total_b"))
    return pairs.select(
        F.col("orig_id").alias("item_id"), F.col("sub_id").alias("doc_id"), "shared",
        F.col("covered_a").alias("covered_orig"), F.col("covered_b").alias("covered_sub"),
        F.col("total_a").alias("total_orig"), F.col("total_b").alias("total_sub"),
        F.round(a, 6).alias("orig_in_sub"), F.round(b, 6).alias("sub_in_orig"),
        F.round(comb, 6).alias("combined"))


def benchmark_passages(spark: SparkSession, root: str, min_orig_in_sub: float = 0.5) -> DataFrame:
    """Flagship: documents that contain a benchmark passage, best pairs first."""
    cov = anchor_coverage(spark, root)
    return cov.filter(F.col("orig_in_sub") >= min_orig_in_sub).orderBy(
        F.desc("orig_in_sub"), "item_id", "doc_id")
