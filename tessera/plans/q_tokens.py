"""Catalogue entries for normalisation and tokenisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.tokens import token_positions
from ..sources.tables import table
from . import sqlparts as S
from .registry import register

SEP = "\x1f"
KW_SQL = "[" + ", ".join(S.q(k) for k in tx.JAVA_KEYWORDS) + "]"
IDENT_START = r"^[\p{L}_$]"


def _doc_md5(spark, root, name, id_col, col_fn, text_col="text"):
    d = table(spark, root, name)
    v = col_fn(F.col(text_col))
    return d.select(F.col(id_col), F.size(v).cast("long").alias("n_tokens"),
                    F.md5(F.array_join(v, SEP)).alias("digest"))


def _sql_md5(name, id_col, expr):
    return f"""SELECT {id_col}, CAST(len(v) AS BIGINT) AS n_tokens, md5(array_to_string(v, chr(31))) AS digest
FROM (SELECT {id_col}, {expr} AS v FROM {name})"""


# B1 ----------------------------------------------------------------------
def _strip_sql(col):
    return (f"trim(regexp_replace(regexp_replace({col}, {S.q(tx.NOISE_RE)}, '\\1', 'g'), "
            f"{S.q(tx.WHITESPACE_RE)}, ' ', 'g'))")


@register("b1_strip_noise", f"""
SELECT 'documents' AS src, doc_id AS id, CAST(length(s) AS BIGINT) AS n_chars, md5(s) AS digest
FROM (SELECT doc_id, {_strip_sql('text')} AS s FROM documents)
UNION ALL
SELECT 'pages', page_id, CAST(length(s) AS BIGINT), md5(s)
FROM (SELECT page_id, {_strip_sql('html')} AS s FROM pages)""")
def b1_strip_noise(spark, root):
    """Comments (block, line, HTML) removed with string literals protected; whitespace collapsed."""
    d = table(spark, root, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"),
                                               tx.strip_noise("text").alias("s"))
    p = table(spark, root, "pages").select(F.lit("pages").alias("src"), F.col("page_id").alias("id"),
                                           tx.strip_noise("html").alias("s"))
    u = d.unionByName(p)
    return u.select("src", "id", F.length("s").cast("long").alias("n_chars"), F.md5("s").alias("digest"))


# B2 ----------------------------------------------------------------------
@register("b2_tokenize", _sql_md5("documents", "doc_id", S.code_tokens("text")))
def b2_tokenize(spark, root):
    return _doc_md5(spark, root, "documents", "doc_id", tx.tokenize)


# B3-B5 -------------------------------------------------------------------
def _norm_sql(mode):
    lit = "(starts_with(t, '\"') OR starts_with(t, '''') OR regexp_matches(t, '^[0-9]'))"
    if mode == "generic":
        body = (f"CASE WHEN {lit} THEN 'LIT' WHEN list_contains({KW_SQL}, t) THEN t "
                f"WHEN regexp_matches(t, '{IDENT_START}') THEN 'ID' ELSE t END")
    elif mode == "typed":
        body = ("CASE WHEN starts_with(t, '\"') THEN 'STR' WHEN starts_with(t, '''') THEN 'CHR' "
                "WHEN regexp_matches(t, '^[0-9]+\\.[0-9]') THEN 'FLT' WHEN regexp_matches(t, '^[0-9]') THEN 'INT' "
                f"WHEN list_contains({KW_SQL}, t) THEN t WHEN regexp_matches(t, '{IDENT_START}') THEN 'IDF' "
                "ELSE t END")
    else:
        body = f"CASE WHEN {lit} THEN 'LIT' ELSE t END"
    return f"list_transform({S.code_tokens('text')}, lambda t: {body})"


for _id, _mode in (("b3_normalize_generic", "generic"), ("b4_normalize_typed", "typed"),
                   ("b5_normalize_keep_ids", "keep_ids")):
    def _make(mode):
        def fn(spark, root):
            return _doc_md5(spark, root, "documents", "doc_id", lambda c: tx.normalize_tokens(tx.tokenize(c), mode))
        fn.__doc__ = f"Lexer tokens normalised in '{mode}' mode."
        return fn
    register(_id, _sql_md5("documents", "doc_id", _norm_sql(_mode)))(_make(_mode))


# B6 ----------------------------------------------------------------------
@register("b6_token_positions", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS lt,
                  unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
     t AS (SELECT doc_id, line, CAST(len(regexp_extract_all(lt, {S.q(tx.TOKEN_RE)}, 0)) AS BIGINT) AS n_tokens FROM l),
     c AS (SELECT doc_id, line, n_tokens,
                  CAST(sum(n_tokens) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) - n_tokens
                       AS INTEGER) AS first_pos FROM t)
SELECT doc_id, CAST(line AS INTEGER) AS line, first_pos, n_tokens FROM c WHERE n_tokens > 0""")
def b6_token_positions(spark, root):
    """(doc_id, pos, line, token) per token, summarised per line for the check."""
    tp = token_positions(table(spark, root, "documents"))
    return tp.groupBy("doc_id", "line").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_tokens"))


# B7 ----------------------------------------------------------------------
@register("b7_statements", _sql_md5(
    "documents", "doc_id",
    f"list_filter(list_transform(regexp_split_to_array(text, '[;{{}}]'), lambda s: "
    f"trim(regexp_replace(s, {S.q(tx.WHITESPACE_RE)}, ' ', 'g'))), lambda s: s <> '')"))
def b7_statements(spark, root):
    return _doc_md5(spark, root, "documents", "doc_id", tx.statements)


# B8 ----------------------------------------------------------------------
@register("b8_extract_channels", f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, {S.q(tx.BLOCK_COMMENT_RE + '|' + tx.LINE_COMMENT_RE)}, 0)) AS BIGINT) AS n_comments,
       CAST(len(regexp_extract_all(text, {S.q(tx.STRING_RE)}, 0)) AS BIGINT) AS n_strings,
       CAST(len(ids) AS BIGINT) AS n_identifiers, md5(array_to_string(ids, chr(31))) AS ids_digest
FROM (SELECT doc_id, text, list_filter({S.code_tokens('text')},
        lambda t: regexp_matches(t, '{IDENT_START}') AND NOT list_contains({KW_SQL}, t)) AS ids FROM documents)""")
def b8_extract_channels(spark, root):
    d = table(spark, root, "documents")
    ids = tx.identifiers(tx.tokenize("text"))
    return d.select("doc_id", F.size(tx.comments("text")).cast("long").alias("n_comments"),
                    F.size(tx.string_literals("text")).cast("long").alias("n_strings"),
                    F.size(ids).cast("long").alias("n_identifiers"),
                    F.md5(F.array_join(ids, SEP)).alias("ids_digest"))
