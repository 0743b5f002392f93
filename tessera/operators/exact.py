"""Exact and normalised duplicates (D1, D2, D4) and LCS similarity (D3).

Duplicate groups are one aggregation keyed by a content digest: count and
min id per group with map-side partial aggregation, so a group of copies
holding a third of the corpus costs one partial row per map task. Members
are never collected into a list; ``duplicate_members`` joins the group
summary back when per-document assignment is needed (AQE splits the hot key).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_tokens, strip_noise, tokenize

SEP = "\x1f"


def digest_exact(text: Column) -> Column:
    return F.sha2(text, 256)


def digest_verbatim(text: Column) -> Column:
    """Type 1: equal modulo comments and whitespace."""
    return F.sha2(strip_noise(text), 256)


def digest_renamed(text: Column) -> Column:
    """Type 2: equal after identifier / literal normalisation."""
    return F.sha2(F.array_join(normalize_tokens(tokenize(text), "generic"), SEP), 256)


def duplicate_groups(df: DataFrame, digest: Column, id_col: str = "doc_id", min_size: int = 2) -> DataFrame:
    """(digest, group_size, min_id) for every digest held by >= min_size rows."""
    g = df.groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("group_size"),
                                               F.min(id_col).alias("min_id"))
    return g.filter(F.col("group_size") >= min_size)


def duplicate_members(df: DataFrame, digest: Column, id_col: str = "doc_id", min_size: int = 2) -> DataFrame:
    """(id, group_id = min id of its group, group_size) for duplicated rows."""
    keyed = df.select(F.col(id_col).alias("id"), digest.alias("digest"))
    groups = duplicate_groups(keyed, F.col("digest"), "id", min_size)
    return keyed.join(groups, "digest").select("id", F.col("min_id").alias("group_id"), "group_size")


# ---------------------------------------------------------------------------
# D3: longest common subsequence per candidate pair
# ---------------------------------------------------------------------------

def _lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """LCS length, bit-parallel: bit i of ``v`` is 0 where a match chain ends at
    a[i]. One big-integer step for each token of b, whatever the number of
    matching index pairs (frequent words don't make it quadratic)."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_similarity(pairs: DataFrame, seqs: DataFrame, seqs_b: DataFrame | None = None, a: str = "doc_a",
                   b: str = "doc_b", id_col: str = "doc_id", seq_col: str = "tokens") -> DataFrame:
    """D3: LCS length of two token (or line) sequences for every candidate pair.

    Candidate pairs come from the fingerprint join (never all pairs). Both
    sequences are attached by equi-joins (``seqs_b`` when the b side lives
    in another table), then each Arrow batch of pairs is
    scored in Python by ``mapInPandas`` -- one pair per row, so no group can
    grow beyond two documents. Output adds lcs, len_a, len_b and
    lcs_sim = 2*lcs / (len_a + len_b).
    """
    sa = seqs.select(F.col(id_col).alias(a), F.col(seq_col).alias("_sa"))
    sb = (seqs_b if seqs_b is not None else seqs).select(F.col(id_col).alias(b), F.col(seq_col).alias("_sb"))
    j = pairs.select(a, b).join(sa, a).join(sb, b)

    def score(batches):
        for pdf in batches:
            lcs = [_lcs_length(np.asarray(x), np.asarray(y)) for x, y in zip(pdf["_sa"], pdf["_sb"])]
            la = pdf["_sa"].map(len)
            lb = pdf["_sb"].map(len)
            yield pd.DataFrame({a: pdf[a], b: pdf[b], "lcs": np.asarray(lcs, dtype="int64"),
                                "len_a": la.astype("int64"), "len_b": lb.astype("int64")})

    out = j.mapInPandas(score, schema=f"{a} long, {b} long, lcs long, len_a long, len_b long")
    tot = F.col("len_a") + F.col("len_b")
    return out.withColumn("lcs_sim", F.when(tot > 0, 2.0 * F.col("lcs") / tot).otherwise(F.lit(0.0)))
