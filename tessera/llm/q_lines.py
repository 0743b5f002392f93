from __future__ import annotations

from .common import read
from .line_dedup import LONG, line_dedup
from .registry import register

SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM d),
u AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY p) AS k FROM l
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT a.r, a.doc_id, a.k, a.line AS l1, b.line AS l2 FROM u a JOIN u b ON a.r = b.r AND b.k = a.k + 1),
f AS (SELECT r, k FROM (SELECT r, k, row_number() OVER (PARTITION BY l1, l2 ORDER BY doc_id, k) AS n FROM w) WHERE n > 1),
o AS (SELECT r, k FROM (SELECT r, k, row_number() OVER (PARTITION BY line ORDER BY doc_id, k) AS n FROM u
      WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {LONG}) WHERE n > 1),
g AS (SELECT r, k FROM f UNION SELECT r, k + 1 FROM f UNION SELECT r, k FROM o),
gone AS (SELECT u.r, u.p FROM u JOIN g USING (r, k)),
kept AS (SELECT l.r, string_agg(l.line, chr(10) ORDER BY l.p) AS t FROM l ANTI JOIN gone ON l.r = gone.r AND l.p = gone.p
         GROUP BY l.r),
nu AS (SELECT r, count(*) AS n FROM u GROUP BY r), ng AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(coalesce(nu.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(ng.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN nu USING (r) LEFT JOIN ng USING (r)
"""


@register("op5_line_dedup", SQL)
def op5(spark, sf_dir):
    """Later copies of line runs, and later copies of single lines of at least ``LONG`` words."""
    return line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", "kept_sha256")
