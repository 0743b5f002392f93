"""Catalogue entries for exact / normalised duplicates (D1, D2, D4) and LCS (D3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exact
from ..sources.tables import table
from .q_tokens import _norm_sql, _strip_sql
from .registry import register


def _groups(spark, root, digest_fn):
    d = table(spark, root, "documents")
    g = exact.duplicate_groups(d, digest_fn(F.col("text")))
    return g.select(F.col("min_id").alias("min_doc_id"), "group_size")


def _groups_sql(key_expr):
    return f"""SELECT min(doc_id) AS min_doc_id, count(*) AS group_size
FROM (SELECT doc_id, {key_expr} AS k FROM documents) GROUP BY k HAVING count(*) >= 2"""


@register("d1_exact_duplicates", _groups_sql("sha256(text)"))
def d1_exact_duplicates(spark, root):
    """Groups of byte-identical texts: size and smallest id, no member lists."""
    return _groups(spark, root, exact.digest_exact)


@register("d2_verbatim_duplicates", _groups_sql(f"sha256({_strip_sql('text')})"))
def d2_verbatim_duplicates(spark, root):
    """Type-1 groups: identical after comment / whitespace removal."""
    return _groups(spark, root, exact.digest_verbatim)


@register("d4_renamed_duplicates", _groups_sql(f"sha256(array_to_string({_norm_sql('generic')}, chr(31)))"))
def d4_renamed_duplicates(spark, root):
    """Type-2 groups: identical after identifier / literal normalisation."""
    return _groups(spark, root, exact.digest_renamed)


@register("d3_lcs_similarity")
def d3_lcs_similarity(spark, root):
    """LCS of word tokens for every benchmark x document pair sharing a
    5-gram fingerprint (winnowed, w=4), via Hunt-Szymanski in Arrow batches."""
    from . import detect

    cov = detect.anchor_coverage(spark, root).select(F.col("item_id").alias("doc_a"), F.col("doc_id").alias("doc_b"))
    bench = detect.word_docs(spark, root, "benchmark", "item_id")
    docs = detect.word_docs(spark, root)
    return exact.lcs_similarity(cov, bench, docs).select("doc_a", "doc_b", "lcs", "len_a", "len_b")
