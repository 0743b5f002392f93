"""Catalogue entries for run matching.

Events are read as one token sequence per user (event_type ordered by ts,
event_id); documents / benchmark as word-token sequences.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as ro
from ..sources.tables import table
from . import detect
from . import sqlparts as S
from .registry import register

R = 5            # words in a common run of texts
R_EVENTS = 10    # events in a common run: five event types, so short runs are chance
GAP = 2


def event_grams(spark, root, r=R_EVENTS):
    ev = table(spark, root, "events").select("user_id", "ts", "event_id", "event_type")
    return ro.grams_from_rows(ev, "user_id", ["ts", "event_id"], "event_type", r)


_EV_SQL = f"""
  ev AS (SELECT user_id, event_type, CAST(row_number() OVER w - 1 AS INTEGER) AS pos,
                count(*) OVER (PARTITION BY user_id) AS n,
                event_type {' '.join(f"|| chr(31) || lead(event_type, {k}) OVER w" for k in range(1, 10))} AS gram
         FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  g AS (SELECT * FROM ev WHERE gram IS NOT NULL),
  s AS (SELECT a.user_id AS doc_a, b.user_id AS doc_b, a.pos AS i, b.pos AS j, a.n AS n_a, b.n AS n_b
        FROM g a JOIN g b ON a.gram = b.gram AND a.user_id < b.user_id)"""


@register("e9_run_coverage", f"""WITH {_EV_SQL},
  ca AS (SELECT doc_a, doc_b, count(DISTINCT i + k) AS covered_a, max(n_a) AS n_a, max(n_b) AS n_b
         FROM s, range(0, 10) r(k) GROUP BY 1, 2),
  cb AS (SELECT doc_a, doc_b, count(DISTINCT j + k) AS covered_b FROM s, range(0, 10) r(k) GROUP BY 1, 2)
SELECT doc_a, doc_b, covered_a, covered_b, n_a, n_b, round(covered_a / n_a, 6) AS frac_a,
       round(covered_b / n_b, 6) AS frac_b FROM ca JOIN cb USING (doc_a, doc_b)""")
def e9_run_coverage(spark, root):
    """Per pair of users with a common run: events of each side inside common runs of >= 10 events."""
    g = event_grams(spark, root)
    cov = ro.run_coverage(ro.seeds(g), R_EVENTS)
    n = g.select("doc_id", "n").distinct()
    cov = (cov.join(n.select(F.col("doc_id").alias("doc_a"), F.col("n").alias("n_a")), "doc_a")
           .join(n.select(F.col("doc_id").alias("doc_b"), F.col("n").alias("n_b")), "doc_b"))
    return cov.select("doc_a", "doc_b", "covered_a", "covered_b", "n_a", "n_b",
                      F.round(F.col("covered_a") / F.col("n_a"), 6).alias("frac_a"),
                      F.round(F.col("covered_b") / F.col("n_b"), 6).alias("frac_b"))


_RUNS_SQL = f"""WITH {_EV_SQL},
  sd AS (SELECT doc_a, doc_b, i, j, i - j AS d,
                i - row_number() OVER (PARTITION BY doc_a, doc_b, i - j ORDER BY i) AS isl FROM s),
  runs AS (SELECT doc_a, doc_b, CAST(min(i) AS INTEGER) AS start_a, CAST(min(i) - d AS INTEGER) AS start_b,
                  CAST(max(i) - min(i) + 10 AS INTEGER) AS len FROM sd GROUP BY doc_a, doc_b, d, isl)"""


@register("e10_maximal_runs", f"""{_RUNS_SQL}
SELECT * FROM runs""")
def e10_maximal_runs(spark, root):
    """Maximal common runs (>= 10 events) between user sequences: diagonal islands."""
    return ro.maximal_runs(ro.seeds(event_grams(spark, root)), R_EVENTS).select(
        "doc_a", "doc_b", F.col("start_a").cast("int"), F.col("start_b").cast("int"), F.col("len").cast("int"))


@register("e12_merge_matches", f"""{_RUNS_SQL},
  o AS (SELECT *, lag(start_a + len) OVER w AS pa, lag(start_b + len) OVER w AS pb FROM runs
        WINDOW w AS (PARTITION BY doc_a, doc_b ORDER BY start_a, start_b)),
  f AS (SELECT *, CASE WHEN pa IS NULL OR start_a - pa < 0 OR start_a - pa > {GAP} OR start_b - pb < 0
                        OR start_b - pb > {GAP} THEN 1 ELSE 0 END AS nw FROM o),
  gq AS (SELECT *, sum(nw) OVER (PARTITION BY doc_a, doc_b ORDER BY start_a, start_b ROWS UNBOUNDED PRECEDING) AS grp
         FROM f)
SELECT doc_a, doc_b, min(start_a) AS start_a, max(start_a + len) AS end_a, min(start_b) AS start_b,
       max(start_b + len) AS end_b, count(*) AS n_runs, CAST(sum(len) AS BIGINT) AS matched
FROM gq GROUP BY doc_a, doc_b, grp""")
def e12_merge_matches(spark, root):
    """Maximal runs merged across insertions of up to 2 events on both sides."""
    runs = ro.maximal_runs(ro.seeds(event_grams(spark, root)), R_EVENTS).select(
        "doc_a", "doc_b", F.col("start_a").cast("int"), F.col("start_b").cast("int"), F.col("len").cast("int"))
    return ro.merge_matches(runs, GAP)


@register("e13_order_free_similarity", f"""
WITH st AS (SELECT doc_id, source, list_transform(list_filter(list_transform(regexp_split_to_array(text, '[;{{}}\\n]'),
                 lambda s: trim(regexp_replace(s, {S.q('[ \t\r\n\f\x0B]+')}, ' ', 'g'))), lambda s: s <> ''),
                 lambda s: lower(s)) AS ss FROM documents),
  e AS (SELECT doc_id, source, len(ss) AS n, unnest(ss) AS stmt FROM st),
  b AS (SELECT doc_id, source, stmt, count(*) AS cnt, max(n) AS n FROM e GROUP BY 1, 2, 3),
  sig AS (SELECT doc_id, source, string_agg(CAST(cnt AS VARCHAR) || stmt, chr(31) ORDER BY stmt) AS d FROM b GROUP BY 1, 2),
  rep AS (SELECT min(doc_id) AS doc_id FROM sig GROUP BY source, d),
  r AS (SELECT b.* FROM b JOIN rep USING (doc_id)),
  p AS (SELECT x.source, x.doc_id AS doc_a, y.doc_id AS doc_b, CAST(sum(least(x.cnt, y.cnt)) AS BIGINT) AS overlap,
               max(x.n) AS n_a, max(y.n) AS n_b
        FROM r x JOIN r y ON x.stmt = y.stmt AND x.source = y.source AND x.doc_id < y.doc_id GROUP BY 1, 2, 3)
SELECT source, doc_a, doc_b, overlap, n_a, n_b, round(overlap / greatest(n_a, n_b), 6) AS similarity FROM p
WHERE overlap / greatest(n_a, n_b) >= 0.3""")
def e13_order_free_similarity(spark, root):
    """Bag-of-statements overlap >= 0.3 between distinct documents of the same source
    (statements end at ; {{ }} or the line end)."""
    d = table(spark, root, "documents").withColumn("text", F.regexp_replace("text", "\n", ";"))
    bags = ro.statement_bags(d, keep=("source",))
    p = ro.order_free_similarity(bags, scope=("source",), threshold=0.3)
    return p.select("source", "doc_a", "doc_b", "overlap", "n_a", "n_b", F.round("similarity", 6).alias("similarity"))


@register("e13_bag_classes", f"""
WITH st AS (SELECT doc_id, source, list_transform(list_filter(list_transform(regexp_split_to_array(text, '[;{{}}\\n]'),
                 lambda s: trim(regexp_replace(s, {S.q('[ \t\r\n\f\x0B]+')}, ' ', 'g'))), lambda s: s <> ''),
                 lambda s: lower(s)) AS ss FROM documents),
  e AS (SELECT doc_id, source, unnest(ss) AS stmt FROM st),
  b AS (SELECT doc_id, source, stmt, count(*) AS cnt FROM e GROUP BY 1, 2, 3),
  sig AS (SELECT doc_id, source, string_agg(CAST(cnt AS VARCHAR) || stmt, chr(31) ORDER BY stmt) AS d FROM b GROUP BY 1, 2)
SELECT doc_id, source, min(doc_id) OVER (PARTITION BY source, d) AS class_id,
       count(*) OVER (PARTITION BY source, d) AS class_size FROM sig""")
def e13_bag_classes(spark, root):
    """Membership that goes with E13: documents of a source with equal statement bags, named by the lowest id."""
    d = table(spark, root, "documents").withColumn("text", F.regexp_replace("text", "\n", ";"))
    return ro.bag_classes(ro.statement_bags(d, keep=("source",)), ("source",))


_WT = S.word_tokens("text")


@register("e14_match_evidence", f"""
WITH bt AS (SELECT item_id AS doc_a, {_WT} AS t FROM benchmark),
  dt AS (SELECT doc_id AS doc_b, {_WT} AS t,
                flatten(list_transform(string_split(text, chr(10)),
                        lambda ln, i: list_transform({S.word_tokens('ln')}, lambda x: i))) AS lines FROM documents),
  ga AS (SELECT doc_a, pos, array_to_string(t[pos + 1 : pos + {R}], ' ') AS gram
         FROM (SELECT doc_a, t, unnest(range(0, greatest(len(t) - {R - 1}, 0))) AS pos FROM bt)),
  gb AS (SELECT doc_b, pos, array_to_string(t[pos + 1 : pos + {R}], ' ') AS gram
         FROM (SELECT doc_b, t, unnest(range(0, greatest(len(t) - {R - 1}, 0))) AS pos FROM dt)),
  s AS (SELECT doc_a, doc_b, ga.pos AS i, gb.pos AS j FROM ga JOIN gb ON ga.gram = gb.gram),
  sd AS (SELECT *, i - j AS d, i - row_number() OVER (PARTITION BY doc_a, doc_b, i - j ORDER BY i) AS isl FROM s),
  runs AS (SELECT doc_a, doc_b, CAST(min(i) AS INTEGER) AS start_a, CAST(min(i) - d AS INTEGER) AS start_b,
                  CAST(max(i) - min(i) + {R} AS INTEGER) AS len FROM sd GROUP BY doc_a, doc_b, d, isl)
SELECT runs.*, CAST(lines[start_b + 1] AS INTEGER) AS line_start_b,
       CAST(lines[start_b + len] AS INTEGER) AS line_end_b
FROM runs JOIN dt USING (doc_b)""")
def e14_match_evidence(spark, root):
    """Line ranges in the document for every maximal 5-word run shared with a benchmark item."""
    ga = ro.grams_from_tokens(detect.word_docs(spark, root, "benchmark", "item_id"), R)
    gb = ro.grams_from_tokens(detect.word_docs(spark, root), R)
    runs = ro.maximal_runs(ro.seeds(ga, gb), R).select(
        "doc_a", "doc_b", F.col("start_a").cast("int"), F.col("start_b").cast("int"), F.col("len").cast("int"))
    lines = table(spark, root, "documents").select("doc_id", ro.word_lines("text").alias("lines"))
    return ro.match_evidence(runs, lines)
