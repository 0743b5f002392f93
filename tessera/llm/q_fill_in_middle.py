from __future__ import annotations

from .common import read
from .fill_in_middle import fill_in_middle, restore
from .registry import register

SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
             regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS ls FROM documents),
g AS (SELECT doc_id, text, ls, CAST(len(ls) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1,
        CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3,
        CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a,
        CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
             OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, coalesce(array_to_string(list_slice(ls, 1, a), ''), '') AS pre,
        coalesce(array_to_string(list_slice(ls, a + 1, b), ''), '') AS mid,
        coalesce(array_to_string(list_slice(ls, b + 1, n), ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

KEPT = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]


@register("op11_fill_in_middle", SQL)
def op11(spark, sf_dir):
    """All documents cut between lines and arranged; restored from output and form."""
    cut = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return restore(cut, KEPT).select(*KEPT, "restored_sha256")
