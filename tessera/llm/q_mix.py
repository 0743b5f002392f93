from __future__ import annotations

from .common import read
from .mix import mix
from .registry import register

SQL = r"""
WITH d AS (SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k,
             CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))
                  AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s0),
-- sources in the order in which a rising level caps them; the first that its level does not cap fixes the level
s2 AS (SELECT *, 2.0 * source_size / weight AS ratio,
         (SELECT CAST(sum(source_size) AS DOUBLE) * 3 / 2 FROM s0) AS budget FROM s1),
s3 AS (SELECT a.source, a.ratio, (a.budget - coalesce((SELECT sum(2 * b.source_size) FROM s2 b WHERE b.ratio < a.ratio), 0))
         / (SELECT sum(b.weight) FROM s2 b WHERE b.ratio >= a.ratio) AS level FROM s2 a),
lv AS (SELECT level FROM s3 WHERE ratio >= level ORDER BY ratio LIMIT 1),
s4 AS (SELECT source, source_size, CASE WHEN ratio < (SELECT level FROM lv) OR (SELECT count(*) FROM lv) = 0
         THEN CAST(2 * source_size AS DOUBLE) ELSE weight * (SELECT level FROM lv) END AS target FROM s2),
p AS (SELECT d.doc_id, d.size, s4.source_size, s4.target,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        CASE WHEN s4.source_size > 0 THEN floor(floor(s4.target) / s4.source_size) ELSE 0 END AS epochs
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)) AS BIGINT) AS taken
FROM p
"""


@register("op4_source_mix", SQL)
def op4(spark, sf_dir):
    """The mix of all documents: 150% of all words, weights 3, 1, 2 by source."""
    return mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", "taken")
