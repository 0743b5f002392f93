from __future__ import annotations

from .common import read
from .registry import register
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup

SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
           FROM documents),
g AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS win
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
rep AS (SELECT r, i FROM g JOIN (SELECT win FROM g GROUP BY win HAVING count(*) > 1) USING (win)),
cov AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM rep)),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
k AS (SELECT w.r, string_agg(w.word, ' ' ORDER BY w.p) AS kept FROM w ANTI JOIN cov ON w.r = cov.r AND w.p = cov.p
      GROUP BY w.r),
n AS (SELECT r, count(*) AS n FROM cov GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN n USING (r)
"""


@register("op2_substring_dedup", SUBSTRING_SQL)
def op2(spark, sf_dir):
    """Words of repeated 35-word windows, removed from every document."""
    return substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


@register("op9_suffix_dedup")
def op9(spark, sf_dir):
    """Bytes of repeated 200-byte strings, removed from every document (all places)."""
    return suffix_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), keep="none").select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
