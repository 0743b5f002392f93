from __future__ import annotations

from pyspark.sql import functions as F

from .common import read, written
from .quality_rules import BIT, POLICIES, ablation, apply_policy, ledger
from .registry import register

CTES = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
             len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols
      FROM d),
g AS (SELECT r, i, list_slice(ws, i, i + 4) AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY r),
m AS (SELECT d.doc_id, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars, n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM d JOIN w USING (r) LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 10 AS f0, 100 * n_repeat_words > 20 * n_words AS f1, 10 * n_symbols > 3 * n_words AS f2,
             10 * n_dup_lines > 3 * n_lines AS f3, word_chars < 2 * n_words AS f4, word_chars > 20 * n_words AS f5
      FROM m)"""

SQL = CTES + """
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, f0 OR f1 AS base_failed,
       NOT (f0 OR f1 OR f2 OR f3) AS kept,
       CAST(CAST(f0 AS INT) + 2 * CAST(f1 AS INT) + 4 * CAST(f2 AS INT) + 8 * CAST(f3 AS INT)
            + 16 * CAST(f4 AS INT) + 32 * CAST(f5 AS INT) AS BIGINT) AS fail_bits
FROM b
"""


@register("op6_quality_rules", SQL)
def op6(spark, sf_dir):
    """Ledger over all documents, judged by policy v1 (which holds the base rules)."""
    led = apply_policy(apply_policy(ledger(read(spark, sf_dir, "documents")), "base").withColumnRenamed("kept", "ok"),
                       "v1")
    return led.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          "NOT ok AS base_failed", "kept", "fail_bits")


_FAILED = {r: f"f{k}" for k, r in enumerate(BIT)}


def _ablation_sql(policy: str) -> str:
    rules = POLICIES[policy]
    return " UNION ALL ".join(
        f"SELECT '{policy}' AS policy, '{r}' AS rule, CAST(count_if({_FAILED[r]}) AS BIGINT) AS n_failed, "
        f"CAST(count_if({' AND '.join(_FAILED[x] if x == r else f'NOT {_FAILED[x]}' for x in rules)}) AS BIGINT) "
        f"AS n_only_this_rule, CAST(count_if({' OR '.join(_FAILED[x] for x in rules)}) AS BIGINT) AS n_rejected FROM b"
        for r in rules)


@register("quality_rule_ablation", f"{CTES} {' UNION ALL '.join(_ablation_sql(p) for p in POLICIES)}")
def quality_rule_ablation(spark, sf_dir):
    """The ledger of all documents, written once; from its bits alone every policy's rejections, and per rule the
    documents that fail it and those that come back if it is dropped."""
    led = written(ledger(read(spark, sf_dir, "documents")).select("doc_id", "fail_bits"), "rule-ledger")
    out = None
    for policy in POLICIES:
        rejected = apply_policy(led, policy).agg(F.count_if(~F.col("kept")).alias("n_rejected"))
        one = ablation(led, policy).select(F.lit(policy).alias("policy"), "rule", "n_failed", "n_only_this_rule",
                                           rejected.scalar().alias("n_rejected"))
        out = one if out is None else out.unionByName(one)
    return out
