"""Catalogue entries for vectors (H1-H6) and pair judging.

Vectors: ``embeddings`` rows grouped into submissions of five windows
(chunk = vec_id div 5). Judging: the benchmark x document pairs found by the
fingerprint join, word tokens standing in for model tokens.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judge as jo
from ..operators import vectors as vo
from ..sources.tables import table
from . import detect
from . import sqlparts as S
from .q_pairs import _COV
from .registry import register

MAXT, STRIDE = 64, 32
CTX = 256        # I1 shows the truncation rule on a short context
JUDGE_CTX = 4096  # context of the judged prompts (I2-I4)
_WT = S.word_tokens("text")


@register("h1_chunk", f"""
WITH d AS (SELECT doc_id, len({_WT}) AS n FROM documents),
  w AS (SELECT doc_id, n, CASE WHEN n <= {MAXT - 2} THEN 1 ELSE CAST(ceil((n - {MAXT - 2}) / {STRIDE}) AS INTEGER) + 1 END AS nw
        FROM d)
SELECT doc_id, CAST(k AS INTEGER) AS window, CAST(k * {STRIDE} AS INTEGER) AS start,
       CAST(greatest(least({MAXT - 2}, n - k * {STRIDE}), 0) AS INTEGER) AS n_tokens
FROM w, LATERAL (SELECT unnest(range(0, nw)) AS k)""")
def h1_chunk(spark, root):
    """Windows of 62 tokens every 32 tokens (max_tokens 64) until the end is covered."""
    c = vo.chunk(detect.word_docs(spark, root), MAXT, STRIDE, keep=("doc_id",))
    return c.select("doc_id", "window", "start", F.size("tokens").alias("n_tokens"))


@register("h2_embed")
def h2_embed(spark, root):
    """Hashing-encoder vectors (dim 64) of every document window."""
    c = vo.chunk(detect.word_docs(spark, root), MAXT, STRIDE, keep=("doc_id",))
    return vo.embed(c, "tokens", 64)


def _chunks(spark, root):
    e = table(spark, root, "embeddings")
    return e.select((F.col("vec_id") / 5).cast("long").alias("chunk"), "vec_id", "embedding")


_MEAN_SQL = """
  ex AS (SELECT vec_id // 5 AS chunk, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  u AS (SELECT chunk, unnest(v) AS x, unnest(range(0, len(v))) AS i FROM ex),
  m AS (SELECT chunk, i, avg(x) AS v FROM u GROUP BY chunk, i),
  mv AS (SELECT chunk, list(v ORDER BY i) AS mean FROM m GROUP BY chunk),
  cs AS (SELECT ex.chunk, ex.vec_id,
                greatest(0.0, list_dot_product(ex.v, mv.mean)
                  / (sqrt(list_dot_product(ex.v, ex.v)) * sqrt(list_dot_product(mv.mean, mv.mean)))) AS cos
         FROM ex JOIN mv ON ex.chunk = mv.chunk)"""


@register("h3_pool", f"""WITH {_MEAN_SQL}
SELECT chunk, CAST(i AS INTEGER) AS i, round(v, 6) AS v FROM m""")
def h3_pool(spark, root):
    """Mean pooling of each submission's window vectors (long form: chunk, dimension, value)."""
    p = vo.pool(_chunks(spark, root), "chunk", "vec_id", "mean")
    return p.select("chunk", F.posexplode("embedding").alias("i", "v")).select("chunk", "i", F.round("v", 6).alias("v"))


def _cos(spark, root):
    ch = _chunks(spark, root)
    p = vo.pool(ch, "chunk", "vec_id", "mean").withColumnRenamed("embedding", "mean")
    return ch.join(p, "chunk").select("chunk", "vec_id", vo.cosine("embedding", "mean").alias("cos"))


@register("h4_cosine", f"""WITH {_MEAN_SQL}
SELECT chunk, vec_id, round(cos, 6) AS cos FROM cs""")
def h4_cosine(spark, root):
    """Cosine (clipped at 0) between every window vector and its submission's mean vector."""
    return _cos(spark, root).withColumn("cos", F.round("cos", 6))


@register("h5_max_over_files", f"""WITH {_MEAN_SQL}
SELECT chunk, round(greatest(coalesce(max(cos), 0.0), 0.0), 6) AS similarity FROM cs GROUP BY chunk""")
def h5_max_over_files(spark, root):
    """Best score over a submission's files (windows), floor 0."""
    m = vo.max_over_files(_cos(spark, root).withColumnRenamed("cos", "similarity"), "chunk")
    return m.withColumn("similarity", F.round("similarity", 6))


@register("h6_similar_vectors")
def h6_similar_vectors(spark, root):
    """All vector pairs with cosine >= 0.3, exactly: blocks of vectors meet as matrices."""
    return vo.similar_vectors(table(spark, root, "embeddings"), 0.3)


@register("h6_vector_search", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings)
SELECT q.vec_id AS query_id, v.vec_id AS id, round(array_cosine_similarity(q.e, v.e), 6) AS cosine
FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 AND array_cosine_similarity(q.e, v.e) >= 0.3""")
def h6_vector_search(spark, root):
    """Every vector with cosine >= 0.3 to a query vector (ids divisible by 20), exactly."""
    e = table(spark, root, "embeddings")
    return vo.search_vectors(e, e.filter("vec_id % 20 = 0"), 0.3).withColumn("cosine", F.round("cosine", 6))


# ---- judging -------------------------------------------------------------
def _judge_pairs(spark, root):
    cov = detect.anchor_coverage(spark, root).select("item_id", "doc_id")
    b = detect.word_docs(spark, root, "benchmark", "item_id").select(F.col("doc_id").alias("item_id"),
                                                                     F.col("tokens").alias("tokens_a"))
    d = detect.word_docs(spark, root).select("doc_id", F.col("tokens").alias("tokens_b"))
    p = cov.join(b, "item_id").join(d, "doc_id")
    return p.select("item_id", "doc_id", F.size("tokens_a").alias("n_orig"), F.size("tokens_b").alias("n_sub"),
                    "tokens_a", "tokens_b")


def _pair_sql(room: int) -> str:
    return f"""WITH {_COV},
  pp AS (SELECT cov.item_id, cov.doc_id, {S.word_tokens('b.text')} AS ta, {S.word_tokens('d.text')} AS tb
         FROM cov JOIN benchmark b ON b.item_id = cov.item_id JOIN documents d ON d.doc_id = cov.doc_id),
  fit AS (SELECT item_id, doc_id, len(ta) AS n_orig, len(tb) AS n_sub,
                 CASE WHEN len(ta) + len(tb) > {room} AND len(ta) > {room // 2}
                      THEN ta[1:{room // 2}] ELSE ta END AS ua,
                 CASE WHEN len(ta) + len(tb) > {room} AND len(tb) > {room // 2}
                      THEN tb[1:{room // 2}] ELSE tb END AS ub FROM pp),
  lg AS (SELECT *, len(list_intersect(ua, ub)) AS i,
                len(list_distinct(ua)) + len(list_distinct(ub)) - len(list_intersect(ua, ub)) AS un FROM fit),
  lo AS (SELECT *, 8.0 * (CASE WHEN un > 0 THEN i / un ELSE 0.0 END) - 4.0 AS yes_logit, 0.0 AS no_logit FROM lg)"""


# 120 tokens of every context belong to the prompt
_PAIR_SQL, _JUDGE_SQL = _pair_sql(256 - 120), _pair_sql(4096 - 120)


def _fitted(spark, root, context=JUDGE_CTX):
    return jo.fit_budget(_judge_pairs(spark, root), context)


@register("i1_fit_budget", f"""{_PAIR_SQL}
SELECT item_id, doc_id, CAST(n_orig AS INTEGER) AS n_orig, CAST(n_sub AS INTEGER) AS n_sub,
       CAST(len(ua) AS INTEGER) AS n_orig_used, CAST(len(ub) AS INTEGER) AS n_sub_used FROM fit""")
def i1_fit_budget(spark, root):
    """Symmetric truncation when both texts exceed the 256-token context minus 120 of overhead."""
    f = _fitted(spark, root, CTX)
    return f.select("item_id", "doc_id", "n_orig", "n_sub", F.size("tokens_a").alias("n_orig_used"),
                    F.size("tokens_b").alias("n_sub_used"))


_PRE, _REST = jo.PROMPT_TEMPLATE.split("{original}")
_MID, _POST = _REST.split("{submission}")


@register("i2_build_prompt", f"""{_JUDGE_SQL}
SELECT item_id, doc_id, md5({S.q(_PRE)} || array_to_string(ua, ' ') || {S.q(_MID)} || array_to_string(ub, ' ')
                            || {S.q(_POST)}) AS prompt_md5 FROM fit""")
def i2_build_prompt(spark, root):
    f = _fitted(spark, root)
    p = jo.build_prompt(F.array_join("tokens_a", " "), F.array_join("tokens_b", " "))
    return f.select("item_id", "doc_id", F.md5(p).alias("prompt_md5"))


@register("i3_judge", f"""{_JUDGE_SQL}
SELECT item_id, doc_id, round(yes_logit, 6) AS yes_logit, CAST(round(no_logit, 6) AS DOUBLE) AS no_logit FROM lo""")
def i3_judge(spark, root):
    """Batch two-way scoring with the deterministic stand-in scorer (pluggable)."""
    j = jo.judge(_fitted(spark, root), keys=("item_id", "doc_id"))
    return j.select("item_id", "doc_id", F.round("yes_logit", 6).alias("yes_logit"),
                    F.round("no_logit", 6).alias("no_logit"))


@register("i4_two_way_softmax", f"""{_JUDGE_SQL}
SELECT item_id, doc_id, round(1.0 / (1.0 + exp(no_logit - yes_logit)), 6) AS p_yes FROM lo""")
def i4_two_way_softmax(spark, root):
    j = jo.judge(_fitted(spark, root), keys=("item_id", "doc_id"))
    return j.select("item_id", "doc_id", F.round(jo.two_way_softmax(F.col("yes_logit"), F.col("no_logit")), 6)
                    .alias("p_yes"))
