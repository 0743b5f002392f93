"""Prediction and run tables derived from the test tables (both engines).

``labels`` joined to ``documents`` gives one labelled submission per row:
case = lang, level = 'L' || (doc_id % 6 + 1) for positives else 'non-plag'
(levels hold positives only, as in the corpus), submission_id = doc_id
zero-padded to 6, is_plagiarized = quality = 1. Three stand-in detectors
score every submission from its own row; each runs at five thresholds:

* Dolos  -> (n_chars % 1000) / 1000
* JPlag  -> (doc_id * 7919 % 1000) / 1000
* SIM    -> distinct-word ratio truncated to 4 digits (integer arithmetic)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import safe_range
from ..functions.text import word_tokens
from ..sources.tables import table
from . import sqlparts as S

# Fixed values for the derived run log.
THRESHOLDS = [0.2, 0.4, 0.5, 0.6, 0.8]
TOOL_SCORES = ["Dolos", "JPlag", "SIM"]


def base(spark: SparkSession, root: str) -> DataFrame:
    lab = table(spark, root, "labels").select("doc_id", "quality")
    docs = table(spark, root, "documents").select("doc_id", "lang", "n_chars", "text")
    j = lab.join(docs, "doc_id")
    toks = word_tokens("text")
    n_tok = F.size(toks)
    ttr = F.when(n_tok > 0, F.floor(F.size(F.array_distinct(toks)).cast("long") * 10000 / n_tok)).otherwise(F.lit(0))
    return j.select(
        "doc_id", F.col("lang").alias("case"),
        F.when(F.col("quality") == 1, F.concat(F.lit("L"), (F.col("doc_id") % 6 + 1).cast("string")))
        .otherwise(F.lit("non-plag")).alias("level"),
        F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("submission_id"),
        (F.col("quality") == 1).alias("is_plagiarized"),
        ((F.col("n_chars") % 1000).cast("double") / 1000).alias("s_dolos"),
        ((F.col("doc_id") * 7919 % 1000).cast("double") / 1000).alias("s_jplag"),
        (ttr.cast("double") / 10000).alias("s_sim"))


def predictions(spark: SparkSession, root: str) -> DataFrame:
    """(tool, run_name, run_ord, threshold, case, level, submission_id,
    similarity, is_plagiarized) -- one row per run and labelled submission."""
    b = base(spark, root)
    runs = []
    for ti, tool in enumerate(TOOL_SCORES):
        for k, t in enumerate(THRESHOLDS):
            runs.append(F.struct(F.lit(tool).alias("tool"), F.lit(f"{tool}-Threshold-{t:.2f}").alias("run_name"),
                                 F.lit(ti * 10 + k).alias("run_ord"), F.lit(t).alias("threshold"),
                                 F.col(f"s_{tool.lower()}").alias("similarity")))
    return b.select("case", "level", "submission_id", "is_plagiarized", F.inline(F.array(*runs))).select(
        "tool", "run_name", "run_ord", "threshold", "case", "level", "submission_id", "similarity",
        "is_plagiarized")


def runs(preds: DataFrame) -> DataFrame:
    return preds.select("tool", "run_name", "run_ord", "threshold").distinct()


def measured(spark: SparkSession, root: str) -> DataFrame:
    """(detector, submission_id, similarity, is_plagiarized): unrounded measures of whole labelled texts.

    words: distinct words over words; letters: characters of the words over
    words; grams: distinct word 5-grams over word 5-grams. A text without words
    (grams: with fewer than five) has no score and is left out.
    """
    t = table(spark, root, "documents").select("doc_id", word_tokens("text").alias("t"))
    n = F.size("t")
    grams = F.transform(safe_range(n - 4, 1), lambda i: F.concat_ws(" ", F.slice("t", i, 5)))
    letters = F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    scores = {"words": F.when(n > 0, F.size(F.array_distinct("t")) / n), "letters": F.when(n > 0, letters / n),
              "grams": F.when(n > 4, F.size(F.array_distinct(grams)) / (n - 4))}
    # texts are measured where they are read: the join moves three numbers a text
    t = t.select("doc_id", *[v.alias(k) for k, v in scores.items()]).join(
        table(spark, root, "labels").select("doc_id", "quality"), "doc_id")
    per = F.array(*[F.struct(F.lit(k).alias("detector"), F.col(k).alias("similarity")) for k in scores])
    rows = t.select(F.col("doc_id").alias("submission_id"), (F.col("quality") == 1).alias("is_plagiarized"), F.inline(per))
    return rows.filter("similarity IS NOT NULL")


# ---- DuckDB side ---------------------------------------------------------

def _runs_values() -> str:
    rows = []
    for ti, tool in enumerate(TOOL_SCORES):
        for k, t in enumerate(THRESHOLDS):
            rows.append(f"('{tool}', '{tool}-Threshold-{t:.2f}', {ti * 10 + k}, {t}::DOUBLE)")
    return ", ".join(rows)


PRED_CTES = f"""
  syn_base AS (
    SELECT d.doc_id, d.lang AS "case",
           CASE WHEN l.quality = 1 THEN 'L' || CAST(d.doc_id % 6 + 1 AS VARCHAR) ELSE 'non-plag' END AS level,
           lpad(CAST(d.doc_id AS VARCHAR), 6, '0') AS submission_id, l.quality = 1 AS is_plagiarized,
           CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS s_dolos,
           CAST(d.doc_id * 7919 % 1000 AS DOUBLE) / 1000 AS s_jplag,
           CAST(CASE WHEN len(d.t) > 0 THEN floor(CAST(len(list_distinct(d.t)) AS BIGINT) * 10000 / len(d.t))
                ELSE 0 END AS DOUBLE) / 10000 AS s_sim
    FROM labels l JOIN (SELECT doc_id, lang, n_chars, {S.word_tokens('text')} AS t FROM documents) d
      ON l.doc_id = d.doc_id),
  syn_runs AS (SELECT * FROM (VALUES {_runs_values()}) v(tool, run_name, run_ord, threshold)),
  preds AS (
    SELECT r.tool, r.run_name, r.run_ord, r.threshold, b."case", b.level, b.submission_id,
           CASE r.tool WHEN 'Dolos' THEN b.s_dolos WHEN 'JPlag' THEN b.s_jplag ELSE b.s_sim END AS similarity,
           b.is_plagiarized
    FROM syn_base b, syn_runs r)"""

MEASURED_CTES = f"""
  mt AS (SELECT l.doc_id, l.quality = 1 AS is_plagiarized, d.t, len(d.t) AS n
         FROM labels l JOIN (SELECT doc_id, {S.word_tokens('text')} AS t FROM documents) d ON l.doc_id = d.doc_id),
  measured AS (
    SELECT 'words' AS detector, is_plagiarized, len(list_distinct(t)) / n AS similarity FROM mt WHERE n > 0
    UNION ALL SELECT 'letters', is_plagiarized, list_sum(list_transform(t, lambda x: length(x))) / n FROM mt WHERE n > 0
    UNION ALL SELECT 'grams', is_plagiarized,
      len(list_distinct(list_transform(range(1, n - 3), lambda i: array_to_string(t[i:i + 4], ' ')))) / (n - 4)
    FROM mt WHERE n > 4)"""
