from __future__ import annotations

from pyspark.sql import functions as F

from .common import read
from .decontaminate import contamination
from .registry import register

SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
           FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM benchmark),
bw AS (SELECT DISTINCT item, l, array_to_string(list_slice(ws, i, i + l - 1), ' ') AS win
       FROM (SELECT item, ws, least(13, len(ws)) AS l, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS i
             FROM b WHERE len(ws) > 0)),
dw AS (SELECT r, l, i, array_to_string(list_slice(ws, i, i + l - 1), ' ') AS win
       FROM (SELECT r, ws, l, unnest(range(1, len(ws) - l + 2)) AS i
             FROM d, (SELECT DISTINCT l FROM bw) AS ls WHERE len(ws) >= l)),
hit AS (SELECT r, item, i, l FROM dw JOIN bw USING (l, win)),
n AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, sha256(coalesce(it.items, '')) AS items_sha256,
       coalesce(n.n, 0) > 0 AND 20 * coalesce(n.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)
"""


@register("op10_decontaminate", SQL)
def op10(spark, sf_dir):
    """Benchmark windows found in every document."""
    found = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
