from __future__ import annotations

from .common import read
from .registry import register
from .url_filter import SOFT, SOFT_WEIGHT, STRICT, STRICT_WEIGHT, THRESHOLD, judge_urls


def _hit(term: str) -> str:
    return f"regexp_matches(u, '(^|[^a-z0-9]){term}($|[^a-z0-9])')"


SQL = rf"""
WITH p AS (SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
                  CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
h AS (SELECT page_id, u, translate(regexp_extract(rest, '^([^/?#]*)', 1),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, CASE
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1')
          THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/')
          THEN 'example.org/es/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
      coalesce({' + '.join(f'CAST({_hit(t)} AS BIGINT)' for t in STRICT)}, 0) AS n_strict,
      coalesce({' + '.join(f'CAST({_hit(t)} AS BIGINT)' for t in SOFT)}, 0) AS n_soft FROM h)
SELECT page_id, host, path, rule, n_strict, n_soft, n_strict * {STRICT_WEIGHT} + n_soft * {SOFT_WEIGHT} AS weight,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN n_strict * {STRICT_WEIGHT} + n_soft * {SOFT_WEIGHT} >= {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


@register("op7_url_filter", SQL)
def op7(spark, sf_dir):
    """Every url of pages, by the prefix rules and then by the vocabulary."""
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "n_strict", "n_soft", "weight", "verdict")
