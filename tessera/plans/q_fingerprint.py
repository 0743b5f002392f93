"""Catalogue entries for fingerprints, coverage and metrics."""

from __future__ import annotations

import uuid

from . import detect
from . import sqlparts as S
from .registry import register

_E7_SQL = f"""
WITH {S.fingerprint_ctes('o', 'benchmark', 'item_id', S.word_tokens('text'), 5, 4)},
{S.fingerprint_ctes('s', 'documents', 'doc_id', S.word_tokens('text'), 5, 4)},
  pairs AS (
    SELECT o.doc_id AS item_id, s.doc_id AS doc_id, count(*) AS shared,
           CAST(sum(o.n_pos) AS BIGINT) AS covered_orig, CAST(sum(s.n_pos) AS BIGINT) AS covered_sub,
           max(o.n_fp) AS total_orig, max(s.n_fp) AS total_sub
    FROM o_dh o JOIN s_dh s ON o.h = s.h GROUP BY 1, 2)
SELECT item_id, doc_id, shared, covered_orig, covered_sub, total_orig, total_sub,
       {S.r6(S.ratio('covered_orig', 'total_orig'))} AS orig_in_sub,
       {S.r6(S.ratio('covered_sub', 'total_sub'))} AS sub_in_orig,
       {S.r6(S.ratio('covered_orig + covered_sub', 'total_orig + total_sub'))} AS combined
FROM pairs
"""


@register("e7_coverage", _E7_SQL)
def e7_coverage(spark, root):
    """Winnowed (k=5, w=4, md5) coverage of every benchmark item x document pair."""
    return detect.anchor_coverage(spark, root)


# ---------------------------------------------------------------------------
# E1-E6, E8 on documents (word 5-grams)
# ---------------------------------------------------------------------------
from pyspark.sql import functions as F  # noqa: E402

from ..functions.hashing import kgram_hashes, kgrams  # noqa: E402
from ..functions.text import word_tokens  # noqa: E402
from ..operators import fingerprint as fpo  # noqa: E402
from ..session import cut_lineage, ensure_checkpoint_dir  # noqa: E402
from ..sources.index import FingerprintIndex, create_index  # noqa: E402
from ..sources.tables import table  # noqa: E402

_WT = S.word_tokens("text")


@register("e1_kgrams", f"""
SELECT doc_id, CAST(greatest(len(t) - 4, 0) AS BIGINT) AS n_kgrams,
       md5(array_to_string(list_transform(range(0, greatest(len(t) - 4, 0)),
           lambda i: array_to_string(t[i + 1 : i + 5], ' ')), chr(30))) AS digest
FROM (SELECT doc_id, {_WT} AS t FROM documents)""")
def e1_kgrams(spark, root):
    """Overlapping 5-token slices per document (fewer than 5 tokens -> none)."""
    d = detect.word_docs(spark, root)
    g = kgrams("tokens", 5)
    return d.select("doc_id", F.size(g).cast("long").alias("n_kgrams"),
                    F.md5(F.array_join(F.transform(g, lambda x: F.array_join(x, " ")), "\x1e")).alias("digest"))


@register("e2_hash_kgrams", f"""
SELECT doc_id, CAST(greatest(len(t) - 4, 0) AS BIGINT) AS n_hashes,
       md5(array_to_string(list_transform(range(0, greatest(len(t) - 4, 0)),
           lambda i: substr(md5(array_to_string(t[i + 1 : i + 5], chr(31))), 1, 15)), ',')) AS digest
FROM (SELECT doc_id, {_WT} AS t FROM documents)""")
def e2_hash_kgrams(spark, root):
    """One 60-bit md5 hash per 5-gram, in position order."""
    d = detect.word_docs(spark, root).select("doc_id", kgram_hashes("tokens", 5, "md5").alias("h"))
    hexes = F.transform("h", lambda x: F.lpad(F.lower(F.hex(x)), 15, "0"))
    return d.select("doc_id", F.size("h").cast("long").alias("n_hashes"), F.md5(F.array_join(hexes, ",")).alias("digest"))


@register("e3_winnow", f"""
WITH {S.fingerprint_ctes('s', 'documents', 'doc_id', _WT, 5, 4)}
SELECT doc_id, count(*) AS n_fp, md5(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos)) AS digest
FROM s_fp GROUP BY doc_id""")
def e3_winnow(spark, root):
    """Winnowed fingerprints (w=4, rightmost minimum, full windows only)."""
    fp = fpo.fingerprints(detect.word_docs(spark, root), k=5, w=4, hash_fn="md5").filter("n_fp > 0")
    return fp.select("doc_id", "n_fp",
                     F.md5(F.array_join(F.transform("fp", lambda x: x["pos"].cast("string")), ",")).alias("digest"))


@register("e4_fingerprint_index", f"""
WITH {S.fingerprint_ctes('s', 'documents', 'doc_id', _WT, 5, 4)},
  freq AS (SELECT h, count(*) AS df FROM s_dh GROUP BY h)
SELECT df, count(*) AS n_hashes FROM freq GROUP BY df""")
def e4_fingerprint_index(spark, root):
    """Fingerprint index and its document-frequency profile (hashes per df)."""
    dh = detect.doc_hash_table(detect.word_docs(spark, root))
    return fpo.document_frequency(dh).groupBy("df").agg(F.count(F.lit(1)).alias("n_hashes"))


def new_index(spark) -> FingerprintIndex:
    """An empty stored index in the shared folder, with as many buckets as a shuffle has partitions."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    return create_index(spark, path, int(spark.conf.get("spark.sql.shuffle.partitions")))


@register("e4_stored_index", f"""
WITH {S.fingerprint_ctes('s', 'documents', 'doc_id', _WT, 5, 4, extra='lang')}
SELECT coalesce(lang, 'none') AS batch, CAST(doc_id AS VARCHAR) AS doc_id, h AS hash, n_pos, n_fp FROM s_dh""")
def e4_stored_index(spark, root):
    """The stored index of all documents, read back: one batch a language, each appended to the same table."""
    index = new_index(spark)
    dh = cut_lineage(detect.doc_hash_table(detect.word_docs(spark, root, keep=("lang",)), keep=("lang",))
                     .withColumn("lang", F.coalesce("lang", F.lit("none"))))
    for r in dh.select("lang").distinct().orderBy("lang").collect():  # a handful of languages
        index.append(dh.filter(F.col("lang") == r.lang), r.lang)
    return index.rows().select("batch", "doc_id", F.lpad(F.lower(F.hex("hash")), 15, "0").alias("hash"), "n_pos", "n_fp")


@register("e5_drop_common", f"""
WITH {S.fingerprint_ctes('s', 'documents', 'doc_id', _WT, 5, 4)}, {S.df_filter('s', 20, 2)}
SELECT doc_id, count(*) AS kept_hashes, CAST(sum(n_pos) AS BIGINT) AS kept_positions FROM s_keep GROUP BY doc_id""")
def e5_drop_common(spark, root):
    """Fingerprints kept per document once df < 2 and df > 20 are dropped."""
    dh = cut_lineage(detect.doc_hash_table(detect.word_docs(spark, root)))  # counted, then filtered
    kept = fpo.drop_common(dh, max_df=20, min_df=2)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept_hashes"), F.sum("n_pos").alias("kept_positions"))


@register("e5_drop_template", f"""
WITH {S.fingerprint_ctes('s', 'documents', 'doc_id', _WT, 5, 4)},
{S.fingerprint_ctes('o', 'benchmark', 'item_id', _WT, 5, 4)}
SELECT doc_id, count(*) AS kept_hashes, CAST(sum(n_pos) AS BIGINT) AS kept_positions, max(n_fp) AS n_fp
FROM s_dh WHERE h NOT IN (SELECT h FROM o_dh) GROUP BY doc_id""")
def e5_drop_template(spark, root):
    """Fingerprints kept per document once those of a template (here every benchmark text) are dropped."""
    dh = detect.doc_hash_table(detect.word_docs(spark, root))
    kept = fpo.drop_common(dh, template=detect.doc_hash_table(detect.word_docs(spark, root, "benchmark", "item_id")))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept_hashes"), F.sum("n_pos").alias("kept_positions"),
                                      F.max("n_fp").alias("n_fp"))


MIN_COMBINED = 0.3  # similarity from which a pair of documents is reported


def rep_ctes(src: str = "s_dh", scope: str = "", t: str = "0.3") -> str:
    """CTEs cls (doc_id, class_id, size) and pairs: all pairs of class
    representatives that share a hash, without any frequency limit, then COMBINED >= t."""
    sc, on = (f"{scope}, ", f" AND a.{scope} = b.{scope}") if scope else ("", "")
    return f"""
  sig AS (SELECT doc_id, {sc}string_agg(h || ':' || CAST(n_pos AS VARCHAR), ',' ORDER BY h) AS d FROM {src}
          GROUP BY doc_id{', ' + scope if scope else ''}),
  cls AS (SELECT doc_id, {sc}min(doc_id) OVER (PARTITION BY {sc}d) AS class_id,
                 count(*) OVER (PARTITION BY {sc}d) AS size FROM sig),
  rep AS (SELECT x.*, cls.size FROM {src} x JOIN cls ON cls.doc_id = x.doc_id WHERE cls.class_id = cls.doc_id),
  cand AS (SELECT {'a.' + scope + ' AS ' + scope + ', ' if scope else ''}a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS shared,
                  CAST(sum(a.n_pos) AS BIGINT) AS covered_a, CAST(sum(b.n_pos) AS BIGINT) AS covered_b,
                  max(a.n_fp) AS total_a, max(b.n_fp) AS total_b, max(a.size) AS size_a, max(b.size) AS size_b
           FROM rep a JOIN rep b ON a.h = b.h AND a.doc_id < b.doc_id{on} GROUP BY {'1, 2, 3' if scope else '1, 2'}),
  pairs AS (SELECT * FROM cand WHERE CAST(covered_a + covered_b AS DOUBLE) / (total_a + total_b) >= {t})"""


_PAIRS_SQL = f"""
WITH {S.fingerprint_ctes('s', 'documents', 'doc_id', _WT, 5, 1)}, {rep_ctes()}"""


def doc_hashes(spark, root, w=1, scope=()):
    """Word 5-gram fingerprints of the documents.

    Without winnowing (w=1) only hash equality matters, so the fast xxhash64
    k-gram hash is used; winnowed tables use md5 so DuckDB can reproduce them.
    """
    return detect.doc_hash_table(detect.word_docs(spark, root, keep=scope), w=w, keep=scope,
                                 hash_fn="xxhash64" if w == 1 else "md5")


def class_reps(spark, root, w=1, scope=()):
    """(classes, reps): ``text_classes`` of the documents, and the fingerprints of
    each class's lowest document with its ``class_size``.

    Classes come from digests made inside the scan; the texts, narrower than
    their fingerprints, are then joined to them and fingerprinted again.
    """
    classes = cut_lineage(fpo.text_classes(doc_hashes(spark, root, w, scope), scope))
    heads = classes.filter("doc_id = class_id").select("doc_id", *scope, "class_size")
    docs = table(spark, root, "documents").select("doc_id", *scope, "text").join(heads, ["doc_id", *scope])
    tokens = docs.select("doc_id", *scope, "class_size", word_tokens("text").alias("tokens"))
    return classes, detect.doc_hash_table(tokens, w=w, keep=(*scope, "class_size"),
                                          hash_fn="xxhash64" if w == 1 else "md5")


def doc_pairs(spark, root, w=1, scope=(), threshold=MIN_COMBINED, metric="combined"):
    """Pairs of class representatives with the metric >= threshold (coverage counts)."""
    return fpo.representative_pairs(class_reps(spark, root, w, scope)[1], threshold, scope, metric)


@register("e6_candidate_pairs", f"""{_PAIRS_SQL}
SELECT doc_a, doc_b, shared FROM pairs""")
def e6_candidate_pairs(spark, root):
    """Pairs of distinct texts (class representatives) with COMBINED >= 0.3, found by their rare 5-grams."""
    return doc_pairs(spark, root).select("doc_a", "doc_b", "shared")


@register("e6_text_classes", f"""{_PAIRS_SQL}
SELECT doc_id, class_id, size AS class_size FROM cls""")
def e6_text_classes(spark, root):
    """Membership that goes with the pairs: documents with equal 5-gram sets, named by the lowest id."""
    return fpo.text_classes(doc_hashes(spark, root))


# with max_pairs: pairs of which either side is covered enough, for the queries that report one-sided coverage
_MAX_PAIRS_SQL = f"""{_PAIRS_SQL},
  max_pairs AS (SELECT * FROM cand
                WHERE greatest({S.ratio('covered_a', 'total_a')}, {S.ratio('covered_b', 'total_b')}) >= 0.3)"""


_ALL_METRICS_SQL = f"""
SELECT doc_a, doc_b, covered_a, covered_b, total_a, total_b,
       {S.r6(S.ratio('covered_a + covered_b', 'total_a + total_b'))} AS combined,
       {S.r6(f"greatest({S.ratio('covered_a', 'total_a')}, {S.ratio('covered_b', 'total_b')})")} AS max_sim,
       {S.r6(f"({S.ratio('covered_a', 'total_a')} + {S.ratio('covered_b', 'total_b')}) / 2.0")} AS avg_sim,
       {S.r6(f"{S.ratio('covered_a', 'total_a')} * {S.ratio('covered_b', 'total_b')}")} AS product_sim
FROM max_pairs"""


@register("e8_apply_metric", f"""
WITH {S.fingerprint_ctes('s', 'documents', 'doc_id', _WT, 5, 1)},
  cand AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, CAST(sum(a.n_pos) AS BIGINT) AS covered_a,
                  CAST(sum(b.n_pos) AS BIGINT) AS covered_b, max(a.n_fp) AS total_a, max(b.n_fp) AS total_b
           FROM s_dh a JOIN s_dh b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
  max_pairs AS (SELECT * FROM cand
                WHERE greatest({S.ratio('covered_a', 'total_a')}, {S.ratio('covered_b', 'total_b')}) >= 0.3)
{_ALL_METRICS_SQL}""")
def e8_apply_metric(spark, root):
    """COMBINED / MAX / AVG / PRODUCT of every pair of documents with MAX >= 0.3: a short text inside a long one
    and every copy included."""
    every = doc_hashes(spark, root).withColumn("class_size", F.lit(1).cast("long"))
    return _all_metrics(fpo.representative_pairs(every, MIN_COMBINED, metric="max"))


@register("e8_apply_metric_max", f"""{_MAX_PAIRS_SQL}{_ALL_METRICS_SQL}""")
def e8_apply_metric_max(spark, root):
    """The same metrics of every pair of distinct texts (class representatives) with MAX >= 0.3."""
    return _all_metrics(doc_pairs(spark, root, metric="max"))


def _all_metrics(p):
    for m, name in (("combined", "combined"), ("max", "max_sim"), ("avg", "avg_sim"), ("product", "product_sim")):
        p = fpo.apply_metric(p, m, name).withColumn(name, F.round(name, 6))
    return p.select("doc_a", "doc_b", "covered_a", "covered_b", "total_a", "total_b",
                    "combined", "max_sim", "avg_sim", "product_sim")
