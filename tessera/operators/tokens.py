"""Token tables with positions (B6) and block segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import let
from ..functions.text import tokenize


def token_positions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, line, token) -- 0-based token position, 1-based line.

    Lines are tokenised inside the row (nested ``transform``) and flattened,
    so position and line come from one generator: no window, no shuffle.
    """
    per_line = F.transform(F.split(F.col(text_col), "\n"),
                           lambda ln, i: F.transform(tokenize(ln),
                                                     lambda t: F.struct((i + 1).alias("line"), t.alias("token"))))
    flat = df.select(F.col(id_col).alias("doc_id"), F.flatten(per_line).alias("_toks"))
    out = flat.select("doc_id", F.posexplode_outer("_toks").alias("pos", "_t")).filter(F.col("pos").isNotNull())
    return out.select("doc_id", "pos", F.col("_t.line").alias("line"), F.col("_t.token").alias("token"))


def token_neighbours(df: DataFrame, keep, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """B6 with neighbours: (doc_id, pos, token, prev, next) of the tokens that ``keep`` picks.

    ``keep(token, prev, next, names)`` is a condition; ``names`` holds the
    distinct tokens of the text that stand before '='. Neighbours and choice are
    made inside the row, so only chosen tokens become rows, without a shuffle.
    Null and empty texts have none.
    """
    words = F.flatten(F.transform(F.split(F.col(text_col), "\n"), lambda ln: tokenize(ln)))
    rows = let(words, lambda ws: F.transform(ws, lambda t, i: F.struct(
        i.alias("pos"), t.alias("token"), F.get(ws, i - 1).alias("prev"), F.get(ws, i + 1).alias("next"))))
    kept = let(rows, lambda rs: let(
        F.array_distinct(F.transform(F.filter(rs, lambda r: r["next"] == "="), lambda r: r["token"])),
        lambda names: F.filter(rs, lambda r: keep(r["token"], r["prev"], r["next"], names))))
    return df.select(F.col(id_col).alias("doc_id"), F.inline_outer(kept)).filter(F.col("pos").isNotNull())


def segment_blocks(tokens: DataFrame, min_tokens: int = 1) -> DataFrame:
    """Brace-delimited blocks with start / end line and depth.

    Depth after each token = running sum of +1 for '{' and -1 for '}' in
    token order per document. A block opened at depth d ends at the first
    later '}' that brings the depth back to d - 1, found by one window per
    (document, depth). Stray closing braces shift the depth but pair with
    nothing; a block that is never closed is no block.
    Output: (doc_id, block_id, depth, start_pos, end_pos, start_line, end_line, n_tokens).
    """
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    delta = F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1).otherwise(0)
    t = tokens.withColumn("depth_after", F.sum(delta).over(w))
    # an open at depth d and the closes back from d, in order: the next close after the open is its own
    braces = t.filter(F.col("token").isin("{", "}")).withColumn(
        "depth", F.when(F.col("token") == "{", F.col("depth_after")).otherwise(F.col("depth_after") + 1))
    later = Window.partitionBy("doc_id", "depth").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    close = F.first(F.when(F.col("token") == "}", F.struct("pos", "line")), ignorenulls=True).over(later)
    blocks = (braces.withColumn("_end", close).filter((F.col("token") == "{") & F.col("_end").isNotNull())
              .select("doc_id", "depth", F.col("pos").alias("start_pos"), F.col("line").alias("start_line"),
                      F.col("_end.pos").alias("end_pos"), F.col("_end.line").alias("end_line")))
    blocks = blocks.withColumn("n_tokens", F.col("end_pos") - F.col("start_pos") + 1)
    blocks = blocks.filter(F.col("n_tokens") >= min_tokens)
    return blocks.select("doc_id", F.concat_ws(":", "doc_id", "start_pos").alias("block_id"), "depth", "start_pos",
                         "end_pos", "start_line", "end_line", "n_tokens")
