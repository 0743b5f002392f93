"""Text normalisation and lexing as Column expressions.

Everything here is a builtin Spark expression (regex, split, transform,
filter), so it runs inside the JVM next to the scan: no Python worker, no
shuffle. The regexes avoid locale-dependent classes (``\\w``, ``\\s``) so the
same pattern gives the same tokens in Java regex and RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

# Word tokens for prose: lower-case, split on anything that is not a letter or
# a digit of any script.
WORD_SPLIT = r"[^\p{L}\p{N}]+"

# Java reserved words (language specification); the keyword list that
# normalisation keeps verbatim.
JAVA_KEYWORDS = [
    "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char",
    "class", "const", "continue", "default", "do", "double", "else", "enum",
    "extends", "final", "finally", "float", "for", "goto", "if", "implements",
    "import", "instanceof", "int", "interface", "long", "native", "new",
    "package", "private", "protected", "public", "return", "short", "static",
    "strictfp", "super", "switch", "synchronized", "this", "throw", "throws",
    "transient", "try", "void", "volatile", "while", "true", "false", "null",
]

# Lexer pieces, tried in this order (leftmost-first alternation).
STRING_RE = r'"(?:[^"\\\n]|\\.)*"'
CHAR_RE = r"'(?:[^'\\\n]|\\.)*'"
NUMBER_RE = r"[0-9]+(?:\.[0-9]+)?"
IDENT_RE = r"[\p{L}_$][\p{L}\p{N}_$]*"
OPERATOR_RE = r"==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|->|::|<<|>>"
PUNCT_RE = r"[^ \t\r\n\f\x0B\p{L}0-9_$]"
TOKEN_RE = "|".join([STRING_RE, CHAR_RE, NUMBER_RE, IDENT_RE, OPERATOR_RE, PUNCT_RE])

BLOCK_COMMENT_RE = r"/\*[\s\S]*?\*/"
LINE_COMMENT_RE = r"//[^\n]*"
HTML_COMMENT_RE = r"<!--[\s\S]*?-->"
# Comments are removed, but string and character literals are matched first and
# kept, so a "//" inside a string (or after '"') survives.
ONE_CHAR_RE = r"'(?:[^'\\\n]|\\u[0-9a-fA-F]{4}|\\[^\n])'"
NOISE_RE = "(" + STRING_RE + "|" + ONE_CHAR_RE + ")|" + BLOCK_COMMENT_RE + "|" + LINE_COMMENT_RE + "|" + HTML_COMMENT_RE
WHITESPACE_RE = r"[ \t\r\n\f\x0B]+"
STATEMENT_SPLIT_RE = r"[;{}]"
CALL_RE = r"[A-Za-z_$][A-Za-z0-9_$]*[ \t]*\("
DECISION_TOKENS = ["if", "for", "while", "case", "catch", "&&", "||", "?"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word_tokens(text) -> Column:
    """Lower-cased word tokens of prose; empty pieces dropped."""
    return F.filter(F.split(F.lower(_c(text)), WORD_SPLIT), lambda t: t != "")


def strip_noise(text) -> Column:
    """B1: drop block / line / HTML comments (string literals protected),
    collapse whitespace runs to one blank, trim."""
    no_comments = F.regexp_replace(_c(text), NOISE_RE, "$1")
    return F.trim(F.regexp_replace(no_comments, WHITESPACE_RE, " "))


def tokenize(text) -> Column:
    """B2: lexical tokens (string, char, number, identifier, operator, punct)."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN_RE), 0)


def _is_ident(t: Column) -> Column:
    return t.rlike(r"^[\p{L}_$]")


def normalize_tokens(tokens, mode: str = "generic") -> Column:
    """B3-B5. generic: identifiers -> ID, literals -> LIT; typed: identifiers
    -> IDF, strings -> STR, chars -> CHR, integers -> INT, decimals -> FLT;
    keep_ids: identifiers verbatim, literals -> LIT. Keywords always stay."""
    kw = F.array(*[F.lit(k) for k in JAVA_KEYWORDS])

    def f(t: Column) -> Column:
        is_kw = F.array_contains(kw, t)
        if mode == "generic":
            return (F.when(t.startswith('"') | t.startswith("'") | t.rlike("^[0-9]"), F.lit("LIT"))
                    .when(is_kw, t).when(_is_ident(t), F.lit("ID")).otherwise(t))
        if mode == "typed":
            return (F.when(t.startswith('"'), F.lit("STR")).when(t.startswith("'"), F.lit("CHR"))
                    .when(t.rlike(r"^[0-9]+\.[0-9]"), F.lit("FLT")).when(t.rlike("^[0-9]"), F.lit("INT"))
                    .when(is_kw, t).when(_is_ident(t), F.lit("IDF")).otherwise(t))
        if mode == "keep_ids":
            return F.when(t.startswith('"') | t.startswith("'") | t.rlike("^[0-9]"), F.lit("LIT")).otherwise(t)
        raise ValueError(f"unknown normalisation mode {mode!r}")

    return F.transform(_c(tokens), f)


def statements(text) -> Column:
    """Instruction units = pieces between ; { } , trimmed, non-empty."""
    parts = F.transform(F.split(_c(text), STATEMENT_SPLIT_RE), lambda s: F.trim(F.regexp_replace(s, WHITESPACE_RE, " ")))
    return F.filter(parts, lambda s: s != "")


def comments(text) -> Column:
    """B8 channel: comment bodies."""
    return F.regexp_extract_all(_c(text), F.lit(BLOCK_COMMENT_RE + "|" + LINE_COMMENT_RE), 0)


def string_literals(text) -> Column:
    """B8 channel: string literals."""
    return F.regexp_extract_all(_c(text), F.lit(STRING_RE), 0)


def identifiers(tokens) -> Column:
    """B8 channel: identifier tokens that are not keywords."""
    kw = F.array(*[F.lit(k) for k in JAVA_KEYWORDS])
    return F.filter(_c(tokens), lambda t: _is_ident(t) & ~F.array_contains(kw, t))


def called_names(text) -> Column:
    """Names directly followed by '(' (method calls / declarations)."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(CALL_RE), 0),
                       lambda s: F.regexp_replace(s, r"[ \t]*\($", ""))
