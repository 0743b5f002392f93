"""Fingerprints, index, candidate pairs and coverage.

Plan shape at scale (documents -> pair scores):

1. narrow projection: tokens -> k-gram hashes -> winnowed fingerprints
   (arrays, no shuffle) -> explode to (doc_id, pos, hash, n_fp);
2. ``doc_hashes``: groupBy(hash, doc_id) -- spreads evenly even when one hash
   is in a third of all documents, because doc_id is part of the key;
3. ``document_frequency``: groupBy(hash).count with map-side partial
   aggregation -- a hot hash ships one partial row per map task;
4. ``similar_pairs``: texts with equal fingerprints are one class; a document's
   rare prefix (the fingerprints that any similar text must meet) is joined to
   the index, and coverage counts all shared fingerprints of a candidate;
5. ``drop_common`` (E5) is a feature of its own and in no pair search;
6. totals ride along as columns (computed from the array size before the
   explode), so no join back to a per-document table is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import kgram_hashes, let, md5_fingerprints, safe_range, winnow
from ..session import cut_lineage
from .coverage import bundled_fingerprints, covered_pairs

METRICS = ("combined", "max", "avg", "orig_in_sub", "sub_in_orig", "product")


def fingerprints(df: DataFrame, k: int = 5, w: int = 4, hash_fn: str = "xxhash64",
                 id_col: str = "doc_id", tokens_col: str = "tokens", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document ``n_kgrams``, ``fp`` (winnowed array<struct<pos,hash>>), ``n_fp``.

    md5 fingerprints are made in Arrow batches (``hashing.md5_fingerprints``); no filter
    or projection behind it can make Spark evaluate them a second time.
    """
    if hash_fn == "md5":
        src = df.select(*keep, F.col(id_col).alias("doc_id"), F.col(tokens_col).cast("array<string>").alias("tokens"))
        kept = T.StructType([src.schema[c] for c in (*keep, "doc_id")])
        return src.mapInArrow(md5_fingerprints(k, w), T.StructType([
            *kept, T.StructField("n_kgrams", T.LongType()),
            T.StructField("fp", T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()),
                                                          T.StructField("hash", T.LongType())]))),
            T.StructField("n_fp", T.LongType())]))
    # The hash array is projected as its own column first: referenced inside
    # the winnowing lambdas as an expression it would be recomputed per window.
    hashed = df.select(*keep, F.col(id_col).alias("doc_id"),
                       kgram_hashes(tokens_col, k, hash_fn).alias("_h"))
    out = hashed.select(*keep, "doc_id", F.size("_h").cast("long").alias("n_kgrams"),
                        winnow("_h", w).alias("fp"))
    return out.withColumn("n_fp", F.size("fp").cast("long"))


def fingerprint_index(fp: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per selected fingerprint (doc_id, pos, hash, n_fp)."""
    # inline_outer + null filter instead of inline: for a plain generator
    # Catalyst infers ``size(fp) > 0`` and pushes it below the projections,
    # re-inlining the whole hashing/winnowing expression into the scan filter.
    return (fp.select(*keep, "doc_id", "n_fp", F.inline_outer("fp"))
            .filter(F.col("pos").isNotNull()).select(*keep, "doc_id", "pos", "hash", "n_fp"))


def doc_hashes(index: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(hash, doc_id, n_pos, n_fp): distinct fingerprints per document, with
    the number of positions each one covers."""
    return (index.groupBy("hash", "doc_id", *keep)
            .agg(F.count(F.lit(1)).alias("n_pos"), F.max("n_fp").alias("n_fp")))


def _counted(hashes: Column) -> Column:
    """array<struct<hash, n_pos>>: the distinct values of an array and how often each is found."""
    def runs(s: Column) -> Column:
        starts = F.filter(safe_range(F.size(s) - 1, 0), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda p, k: F.struct(
            F.get(s, p).alias("hash"), (F.coalesce(F.get(at, k + 1), F.size(s)) - p).cast("long").alias("n_pos"))))

    return let(F.sort_array(hashes), runs)


def doc_hash_rows(fp: DataFrame, keep: tuple[str, ...] = (), docs: DataFrame | None = None) -> DataFrame:
    """``doc_hashes`` of ``fingerprints``, counted inside each document's array: no
    fingerprint is shuffled, and a document's rows leave one task in a row.

    Rows that share an id (and ``keep``) are one document, as in ``doc_hashes``.
    Where there are any, those alone are grouped by fingerprint. They are looked
    for in ``docs`` (the rows that ``fp`` was made of), where that is given, so that
    no fingerprint is made for it.
    """
    key = ["doc_id", *keep]
    cols = ["hash", *key, "n_pos", "n_fp"]

    def inside(rows: DataFrame) -> DataFrame:
        counted = rows.select(*key, "n_fp", F.inline_outer(_counted(F.transform("fp", lambda x: x["hash"]))))
        return counted.filter("hash IS NOT NULL").select(*cols)

    again = (fp if docs is None else docs).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    if again.isEmpty():
        return inside(fp)
    again = again.select(*[F.col(c).alias(f"_{c}") for c in key])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    several = doc_hashes(fingerprint_index(fp.join(again, same, "left_semi"), keep), keep)
    return inside(fp.join(again, same, "left_anti")).unionByName(several.select(*cols))


def document_frequency(dh: DataFrame) -> DataFrame:
    """(hash, df): number of documents holding each fingerprint."""
    return dh.groupBy("hash").agg(F.count(F.lit(1)).alias("df"))


def drop_common(dh: DataFrame, max_df: int | None = None, min_df: int = 1,
                template: DataFrame | None = None, df_source: DataFrame | None = None) -> DataFrame:
    """E5: keep fingerprints with min_df <= df <= max_df; drop template hashes.

    ``df_source`` lets the frequency be counted on another corpus (e.g. the
    submissions) than the one filtered. Ignored fingerprints count neither as
    shared nor as covered; document totals stay unchanged.
    """
    out = dh
    if max_df is not None or min_df > 1:
        freq = document_frequency(df_source if df_source is not None else dh)
        cond = F.col("df") >= min_df
        if max_df is not None:
            cond = cond & (F.col("df") <= max_df)
        out = out.join(freq.filter(cond).select("hash"), "hash", "left_semi")
    if template is not None:
        out = out.join(template.select("hash").distinct(), "hash", "left_anti")
    return out


def candidate_pairs(dh: DataFrame, min_shared: int = 1, scope: tuple[str, ...] = ()) -> DataFrame:
    """E6+E7 over one corpus: unordered pairs doc_a < doc_b sharing fingerprints.

    Returns (doc_a, doc_b, shared, covered_a, covered_b, total_a, total_b).
    ``scope`` columns (e.g. case) must match too (peer pairs within a group).
    """
    a = dh.select("hash", *scope, F.col("doc_id").alias("doc_a"), F.col("n_pos").alias("n_a"),
                  F.col("n_fp").alias("t_a"))
    b = dh.select("hash", *scope, F.col("doc_id").alias("doc_b"), F.col("n_pos").alias("n_b"),
                  F.col("n_fp").alias("t_b"))
    j = a.join(b, ["hash", *scope]).filter(F.col("doc_a") < F.col("doc_b"))
    out = (j.groupBy(*scope, "doc_a", "doc_b")
           .agg(F.count(F.lit(1)).alias("shared"), F.sum("n_a").alias("covered_a"),
                F.sum("n_b").alias("covered_b"), F.max("t_a").alias("total_a"), F.max("t_b").alias("total_b")))
    return out.filter(F.col("shared") >= min_shared) if min_shared > 1 else out


def text_classes(dh: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, class_id, class_size): documents (of one scope) with the same
    fingerprints and counts form a class named by its lowest doc_id.

    Two order-free 64-bit digests stand for a document's fingerprints, so a
    text copied a million times costs a million narrow rows, never pairs.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "hash", "n_pos")).alias(f"_x{seed}") for seed in (1, 2)]
    digest = cut_lineage(dh.groupBy("doc_id", *scope).agg(F.max("n_fp").alias("_n"), F.count(F.lit(1)).alias("_k"), *marks))
    key = [*scope, "_n", "_k", "_x1", "_x2"]
    heads = digest.groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return digest.join(heads, key).select("doc_id", *scope, "class_id", "class_size")


def shared_fingerprints(reps: DataFrame, threshold: float, scope: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``reps`` whose fingerprint another document holds too, with
    ``in_prefix``: whether it is in the document's rare prefix, the fingerprints
    in the order (document frequency, hash) that hold more than 1 - threshold of
    its mass (n_pos of n_fp). Fingerprints of one document alone come first in
    that order, so their mass is all that is needed of them; no pair can share
    them, and they are most of the rows. ``rest`` is the mass of the shared ones
    from this one on: no pair whose first common fingerprint this is covers more."""
    held = Window.partitionBy("hash", *scope)
    often = reps.withColumn("df", F.count(F.lit(1)).over(held)).filter("df > 1")
    return _with_prefixes(often, threshold, scope).drop("df")


def shared_bundles(reps: DataFrame, threshold: float, scope: tuple[str, ...] = ()) -> DataFrame:
    """``shared_fingerprints`` with those that the same documents hold as one (see ``coverage``): several times fewer
    rows, for all that counts positions. A bundle is in the prefix with its first fingerprint."""
    return _with_prefixes(bundled_fingerprints(reps, scope), threshold, scope).drop("df", "n_hash")


def _with_prefixes(often: DataFrame, threshold: float, scope: tuple[str, ...]) -> DataFrame:
    doc = Window.partitionBy("doc_id", *scope)
    order = doc.orderBy("df", "hash").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("n_pos").over(doc) - F.coalesce(F.sum("n_pos").over(order), F.lit(0))
    often = often.withColumn("rest", rest)
    return often.withColumn("in_prefix", F.col("n_fp") - F.col("rest") <= (1 - threshold) * F.col("n_fp") + 1e-9)


def _met(shared: DataFrame, scope: tuple[str, ...], threshold: float = 0.0) -> DataFrame:
    """Pairs that meet in a prefix; with a threshold, those that can have COMBINED >= threshold.

    All documents of a scope have one order of fingerprints, so at a pair's first
    common one the ``rest`` of both sides holds all that they share."""
    p, q = (shared.select("hash", *scope, F.col("doc_id").alias(f"_{x}"), F.col("n_fp").alias(f"_n{x}"),
                          F.col("rest").alias(f"_r{x}"), F.col("in_prefix").alias(f"_in{x}")) for x in "pq")
    seeds = p.filter("_inp").join(q, ["hash", *scope]).filter("_p <> _q")
    if threshold > 0:
        seeds = seeds.filter(F.col("_rp") + F.col("_rq") >= threshold * (F.col("_np") + F.col("_nq")) - 1e-6)
    return seeds.select(*scope, F.least("_p", "_q").alias("doc_a"), F.greatest("_p", "_q").alias("doc_b")).distinct()


def overlap_pairs(shared: DataFrame, threshold: float, scope: tuple[str, ...] = ()) -> DataFrame:
    """(doc_a, doc_b): all pairs that can share ``threshold`` of the *larger* side's mass
    (E13, F3), of ``shared_fingerprints``: both sides must then share that much of
    themselves, so they meet in both prefixes, and both rests hold the overlap."""
    p, q = (shared.filter("in_prefix").select("hash", *scope, F.col("doc_id").alias(f"doc_{x}"), F.col("n_fp").alias(f"_n{x}"),
                                              F.col("rest").alias(f"_r{x}")) for x in "ab")
    met = p.join(q, ["hash", *scope]).filter("doc_a < doc_b").filter(
        F.least("_ra", "_rb") >= threshold * F.greatest("_na", "_nb") - 1e-6)
    return met.select(*scope, "doc_a", "doc_b").distinct()


def prefix_pairs(reps: DataFrame, threshold: float, scope: tuple[str, ...] = ()) -> DataFrame:
    """(doc_a, doc_b): all pairs that can share at least ``threshold`` of one
    side's mass (n_pos of n_fp), found through that side's rare prefix."""
    return _met(shared_fingerprints(reps, threshold, scope), scope)


def pair_coverage(pairs: DataFrame, shared: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Coverage of the pairs (doc_a, doc_b) over all fingerprints that both hold.

    ``shared`` must have the rows of every fingerprint held by two documents."""
    extra = [c for c in ("class_size",) if c in shared.columns]
    side = (lambda d, x: shared.select("hash", *scope, F.col("doc_id").alias(d), F.col("n_pos").alias(f"n_{x}"),
                                       F.col("n_fp").alias(f"t_{x}"), *[F.col(c).alias(f"s_{x}") for c in extra]))
    both = pairs.join(side("doc_a", "a"), ["doc_a", *scope]).join(side("doc_b", "b"), ["doc_b", "hash", *scope])
    sizes = [F.max(f"s_{x}").alias(f"size_{x}") for x in "ab" if extra]
    return (both.groupBy(*scope, "doc_a", "doc_b")
            .agg(F.count(F.lit(1)).alias("shared"), F.sum("n_a").alias("covered_a"), F.sum("n_b").alias("covered_b"),
                 F.max("t_a").alias("total_a"), F.max("t_b").alias("total_b"), *sizes))


def similar_pairs(dh: DataFrame, threshold: float, scope: tuple[str, ...] = (), metric: str = "combined") -> DataFrame:
    """E6+E7 with a similarity threshold instead of a frequency cap: all pairs of
    class representatives (see ``text_classes``) with ``metric`` >= threshold.

    COMBINED loses a short text inside a long one; with metric "max" a pair
    stays if either side is covered enough. COMBINED, AVG and PRODUCT are never
    above MAX, so these pairs include those of every other metric.

    Exact. If COMBINED >= t, at least one side has a share >= t of its positions
    covered, so any of its fingerprints that together hold more than 1 - t of
    its positions include a shared one. Each document's fingerprints are taken
    in the order (document frequency, hash) until they do; only this rare
    prefix is joined to the index. Coverage then counts *all* shared
    fingerprints, frequent ones included, against full totals.
    Returns the columns of ``candidate_pairs`` plus size_a, size_b (class sizes).
    """
    classes = text_classes(dh, scope).filter(F.col("doc_id") == F.col("class_id"))
    return representative_pairs(dh.join(classes.select("doc_id", *scope, "class_size"), ["doc_id", *scope]),
                                threshold, scope, metric)


def representative_pairs(reps: DataFrame, threshold: float, scope: tuple[str, ...] = (),
                         metric: str = "combined") -> DataFrame:
    """``similar_pairs`` of the fingerprints of class representatives (with their ``class_size``).

    Pairs are found and counted where two blocks of documents meet (``coverage``); no row is made for a pair
    and a fingerprint."""
    out = covered_pairs(bundled_fingerprints(reps, scope), threshold, scope, both=metric == "combined")
    return apply_metric(out, metric, "_similarity").filter(F.col("_similarity") >= threshold).drop("_similarity")


def anchor_candidates(orig_dh: DataFrame, sub_dh: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """E6+E7 between originals (a side) and submissions (b side).

    Returns (orig_id, sub_id, shared, covered_a, covered_b, total_a, total_b)
    where a = original and b = submission.
    """
    a = orig_dh.select("hash", *scope, F.col("doc_id").alias("orig_id"), F.col("n_pos").alias("n_a"),
                       F.col("n_fp").alias("t_a"))
    b = sub_dh.select("hash", *scope, F.col("doc_id").alias("sub_id"), F.col("n_pos").alias("n_b"),
                      F.col("n_fp").alias("t_b"))
    return (a.join(b, ["hash", *scope]).groupBy(*scope, "orig_id", "sub_id")
            .agg(F.count(F.lit(1)).alias("shared"), F.sum("n_a").alias("covered_a"),
                 F.sum("n_b").alias("covered_b"), F.max("t_a").alias("total_a"), F.max("t_b").alias("total_b")))


def anchor_candidates_from_index(orig_dh: DataFrame, sub_index: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """E6+E7 between originals and submissions without grouping the (big)
    submission index first: raw fingerprint rows (hash, doc_id, pos, n_fp)
    are joined to the originals' per-hash table, then collapsed per
    (orig, sub, hash) and per pair -- only matched rows are shuffled, and
    when the originals' side is small AQE turns the join into a broadcast,
    so the index is not shuffled at all. Same output as ``anchor_candidates``.
    """
    a = orig_dh.select("hash", *scope, F.col("doc_id").alias("orig_id"), F.col("n_pos").alias("n_a"),
                       F.col("n_fp").alias("t_a"))
    b = sub_index.select("hash", *scope, F.col("doc_id").alias("sub_id"), F.col("n_fp").alias("t_b"))
    per_hash = (a.join(b, ["hash", *scope]).groupBy(*scope, "orig_id", "sub_id", "hash")
                .agg(F.count(F.lit(1)).alias("n_b"), F.max("n_a").alias("n_a"), F.max("t_a").alias("t_a"),
                     F.max("t_b").alias("t_b")))
    return (per_hash.groupBy(*scope, "orig_id", "sub_id")
            .agg(F.count(F.lit(1)).alias("shared"), F.sum("n_a").alias("covered_a"),
                 F.sum("n_b").alias("covered_b"), F.max("t_a").alias("total_a"), F.max("t_b").alias("total_b")))


def ratio(num, den) -> Column:
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def metric_expr(metric: str, a_frac: Column, b_frac: Column, combined: Column | None = None) -> Column:
    """One score from the two directional fractions (a = original side)."""
    m = metric.lower()
    if m == "orig_in_sub":
        return a_frac
    if m == "sub_in_orig":
        return b_frac
    if m == "max":
        return F.greatest(a_frac, b_frac)
    if m == "avg":
        return (a_frac + b_frac) / 2.0
    if m == "product":
        return a_frac * b_frac
    if m == "combined":
        if combined is None:
            raise ValueError("combined needs covered and total counts")
        return combined
    raise ValueError(f"unknown metric {metric!r}")


def apply_metric(df: DataFrame, metric: str = "combined", out: str = "similarity") -> DataFrame:
    """E8 on a coverage table (covered_a, covered_b, total_a, total_b).

    combined = (covered_a + covered_b) / (total_a + total_b); every ratio is 0
    when its denominator is 0.
    """
    a_frac = ratio("covered_a", "total_a")
    b_frac = ratio("covered_b", "total_b")
    combined = ratio(F.col("covered_a") + F.col("covered_b"), F.col("total_a") + F.col("total_b"))
    return df.withColumn(out, metric_expr(metric, a_frac, b_frac, combined))
