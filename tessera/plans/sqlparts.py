"""DuckDB SQL fragments for the oracle side of the query catalogue.

These mirror the *results* of the Spark operators with an independent
formulation (window functions instead of in-array winnowing, etc.).
"""

from __future__ import annotations

# Patterns and limits are written here by hand, not taken from the engine, so
# that an oracle cannot share the engine's mistake.
WORD_SPLIT = r"[^\p{L}\p{N}]+"
CODE_TOKEN = ("\"(?:[^\"\\\\\n]|\\\\.)*\"|'(?:[^'\\\\\n]|\\\\.)*'|[0-9]+(?:\\.[0-9]+)?|[\\p{L}_$][\\p{L}\\p{N}_$]*"
              "|==|!=|<=|>=|&&|\\|\\||\\+\\+|--|\\+=|-=|\\*=|/=|->|::|<<|>>|[^ \\t\\r\\n\\f\\x0B\\p{L}0-9_$]")


def q(s: str) -> str:
    """Quote a string literal for DuckDB (standard SQL: only '' escaping)."""
    return "'" + s.replace("'", "''") + "'"


def word_tokens(col: str) -> str:
    return f"list_filter(string_split_regex(lower({col}), {q(WORD_SPLIT)}), lambda x: x <> '')"


def code_tokens(col: str) -> str:
    return f"regexp_extract_all({col}, {q(CODE_TOKEN)}, 0)"


def fingerprint_ctes(prefix: str, src: str, id_expr: str, tokens_expr: str, k: int, w: int,
                     extra: str = "") -> str:
    """CTEs ``{prefix}_fp(doc_id, pos, h, n_fp{, extra})`` and
    ``{prefix}_dh(h, doc_id, n_pos, n_fp{, extra})``; h = 15 hex digits of md5."""
    ex = f", {extra}" if extra else ""
    sel_win = f"""
  {prefix}_win AS (
    SELECT doc_id{ex}, pos, nk,
           min(struct_pack(h := h, np := -pos)) OVER (PARTITION BY doc_id ORDER BY pos
               ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS m
    FROM {prefix}_kg),
  {prefix}_sel AS (
    SELECT DISTINCT doc_id{ex}, -m.np AS pos, m.h AS h FROM {prefix}_win
    WHERE pos <= greatest(nk - {w}, 0)),"""
    if w == 1:
        sel_win = f"""
  {prefix}_sel AS (SELECT doc_id{ex}, pos, h FROM {prefix}_kg),"""
    return f"""
  {prefix}_tok AS (SELECT {id_expr} AS doc_id{ex}, {tokens_expr} AS t FROM {src}),
  {prefix}_pos AS (SELECT doc_id{ex}, t, len(t) - {k - 1} AS nk,
                   unnest(range(0, greatest(len(t) - {k - 1}, 0))) AS pos FROM {prefix}_tok),
  {prefix}_kg AS (SELECT doc_id{ex}, pos, nk,
                  substr(md5(array_to_string(t[pos + 1 : pos + {k}], chr(31))), 1, 15) AS h
                  FROM {prefix}_pos),{sel_win}
  {prefix}_fp AS (SELECT doc_id{ex}, pos, h, count(*) OVER (PARTITION BY doc_id) AS n_fp FROM {prefix}_sel),
  {prefix}_dh AS (SELECT h, doc_id{ex}, count(*) AS n_pos, max(n_fp) AS n_fp FROM {prefix}_fp
                  GROUP BY h, doc_id{ex})"""


def df_filter(prefix: str, max_df: int | None, min_df: int = 1, freq_prefix: str | None = None) -> str:
    """CTE ``{prefix}_keep``: doc hashes whose document frequency is in range."""
    fp = freq_prefix or prefix
    conds = [f"df >= {min_df}"]
    if max_df is not None:
        conds.append(f"df <= {max_df}")
    return f"""
  {prefix}_freq AS (SELECT h, count(*) AS df FROM {fp}_dh GROUP BY h),
  {prefix}_keep AS (SELECT * FROM {prefix}_dh WHERE h IN (SELECT h FROM {prefix}_freq WHERE {' AND '.join(conds)}))"""


def r6(expr: str) -> str:
    return f"round({expr}, 6)"


def ratio(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / ({den}) ELSE 0.0 END)"


def metrics_sql(tp: str = "tp", fp: str = "fp", tn: str = "tn", fn: str = "fn", nd: int = 6,
                null_if_empty: bool = False) -> str:
    """precision, recall, f1, accuracy, mcc with the operators' formulas."""
    tp, fp, tn, fn = (f"CAST({x} AS DOUBLE)" for x in (tp, fp, tn, fn))
    p = f"(CASE WHEN {tp} + {fp} <> 0 THEN {tp} / ({tp} + {fp}) ELSE 0.0 END)"
    r = f"(CASE WHEN {tp} + {fn} <> 0 THEN {tp} / ({tp} + {fn}) ELSE 0.0 END)"
    f1 = f"(CASE WHEN {p} + {r} <> 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"
    acc = f"(CASE WHEN {tp} + {fp} + {tn} + {fn} <> 0 THEN ({tp} + {tn}) / ({tp} + {fp} + {tn} + {fn}) ELSE 0.0 END)"
    den = f"sqrt(({tp} + {fp}) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn}))"
    mcc = f"(CASE WHEN {den} <> 0 THEN ({tp} * {tn} - {fp} * {fn}) / {den} ELSE 0.0 END)"
    out = []
    for name, e in (("precision", p), ("recall", r), ("f1", f1), ("accuracy", acc), ("mcc", mcc)):
        v = f"round({e}, {nd})"
        if null_if_empty:
            v = f"CASE WHEN {tp} + {fp} + {tn} + {fn} > 0 THEN {v} END"
        out.append(f"{v} AS {name}")
    return ", ".join(out)


def counts_sql(pred: str, truth: str = "is_plagiarized") -> str:
    # count_if is HUGEINT in DuckDB; Spark counts are BIGINT
    return (f"CAST(count_if(({pred}) AND {truth}) AS BIGINT) AS tp, "
            f"CAST(count_if(({pred}) AND NOT {truth}) AS BIGINT) AS fp, "
            f"CAST(count_if(NOT ({pred}) AND NOT {truth}) AS BIGINT) AS tn, "
            f"CAST(count_if(NOT ({pred}) AND {truth}) AS BIGINT) AS fn")
