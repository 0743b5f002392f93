"""Labelled variants of texts as a data job.

Every variant is a deterministic, seeded rewrite written with builtin
string / array functions, so a whole corpus of variants is one projection.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from .evaluate import auc

SENTENCE_SPLIT = r"(?<=[.!?])\s+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _mark(seed: int, *cols: Column) -> Column:
    """md5 (hex) of seed and values: any engine can make the same choice."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def _pick(seed: int, *cols: Column, every: int = 3) -> Column:
    return F.conv(F.substring(_mark(seed, *cols), 1, 7), 16, 10).cast("int") % every == 0


def variant_verbatim(text, seed: int = 1) -> Column:
    """Comment and whitespace edits (a line comment after some sentences,
    doubled blanks elsewhere); the words themselves are untouched."""
    sents = F.split(_c(text), SENTENCE_SPLIT)
    edited = F.transform(sents, lambda s, i: F.when(_pick(seed, s, i), F.concat(s, F.lit(" // note\n")))
                         .otherwise(F.regexp_replace(s, " ", "  ")))
    return F.array_join(edited, " ")


def variant_rename(text, seed: int = 2, every: int = 4) -> Column:
    """Consistent renaming: about 1/every of the vocabulary is replaced,
    the same word always by the same new word."""
    toks = word_tokens(_c(text))
    return F.array_join(F.transform(toks, lambda t: F.when(
        _pick(seed, t, every=every), F.concat(F.lit("v"), F.substring(F.md5(F.concat(F.lit(str(seed)), t)), 1, 6)))
        .otherwise(t)), " ")


def variant_insert(text, seed: int = 3) -> Column:
    """Dead-code insertion: a filler sentence derived from the sentence
    hash is inserted after about a third of the sentences."""
    sents = F.split(_c(text), SENTENCE_SPLIT)
    filler = lambda s: F.concat(F.lit("x"), F.substring(F.md5(s), 1, 5), F.lit(" y"), F.substring(F.md5(s), 6, 5), F.lit("."))
    return F.array_join(F.flatten(F.transform(sents, lambda s, i: F.when(
        _pick(seed, s, i), F.array(s, filler(s))).otherwise(F.array(s)))), " ")


def variant_reorder(text, seed: int = 4) -> Column:
    """Reordering of independent blocks: sentences sorted by a seeded hash."""
    sents = F.split(_c(text), SENTENCE_SPLIT)
    keyed = F.transform(sents, lambda s: F.struct(_mark(seed, s).alias("k"), s.alias("s")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["s"]), " ")


FOR_RE = r"for\s*\(\s*([^;()]*);\s*([^;()]*);\s*([^;()]*)\)\s*\{"


def rewrite_loops(text: str | None) -> str | None:
    """`for (init; cond; step) { body }` as `init; while (cond) { body step; }`:
    the step goes before the brace that closes the loop (nested loops too).
    A header whose brace is never closed stays as it is."""
    if text is None:
        return None
    out, at = [], 0
    for m in re.finditer(FOR_RE, text):
        if m.start() < at:
            continue
        depth, end = 1, m.end()
        while depth and end < len(text):
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        if depth:
            continue
        init, cond, step = (x.strip() for x in m.groups())
        body = rewrite_loops(text[m.end():end - 1])
        out.append(f"{text[at:m.start()]}{init}; while ({cond}) {{{body}{step}; }}")
        at = end
    return "".join(out) + text[at:]


def variant_rewrite_loops(text) -> Column:
    """P5: for loops as while loops (see ``rewrite_loops``), in Arrow batches."""
    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        return texts.map(rewrite_loops)

    return rewrite(_c(text))


VARIANTS = {"verbatim": variant_verbatim, "rename": variant_rename, "insert": variant_insert,
            "reorder": variant_reorder}


def all_variants(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, variant, text) for every source row and every variant (one projection + explode)."""
    arr = F.array(*[F.struct(F.lit(k).alias("variant"), fn(text_col).alias("text")) for k, fn in VARIANTS.items()])
    return df.select(id_col, F.inline(arr))


def robustness(scores: DataFrame, keys: list[str], score: str = "similarity") -> DataFrame:
    """Median score and count per (method, variant)."""
    return scores.groupBy(*keys).agg(F.percentile(score, 0.5).alias("median"), F.count(F.lit(1)).alias("n"))


def matched_negatives(items: DataFrame, id_col: str, size_col: str, same_col: str) -> DataFrame:
    """(id, other_id): for each item another one of its size class (sizes with as
    many binary digits), the next by id and after the last the first. Items alone in
    their class, and those whose neighbour has the same ``same_col``, have none."""
    x = items.select(F.col(id_col).alias("id"), F.col(same_col).alias("_same"), F.length(F.bin(F.col(size_col))).alias("_class"))
    w = Window.partitionBy("_class").orderBy("id")
    who = F.struct("id", "_same")
    first = F.first(who).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = x.withColumn("_o", F.coalesce(F.lead(who).over(w), first))
    return x.filter((F.col("id") != F.col("_o.id")) & ~F.col("_same").eqNullSafe(F.col("_o._same"))).select(
        "id", F.col("_o.id").alias("other_id"))


def separation(scores: DataFrame, keys: list[str], score: str = "similarity", positive: str = "positive") -> DataFrame:
    """How far positives stand above negatives, per key: counts, both medians, their
    gap and the AUC (null without one of the two classes)."""
    y = F.col(positive)
    med = scores.groupBy(*keys).agg(
        F.count_if(y).alias("n_positive"), F.count_if(~y).alias("n_negative"),
        F.percentile(F.when(y, F.col(score)), 0.5).alias("median_positive"),
        F.percentile(F.when(~y, F.col(score)), 0.5).alias("median_negative"))
    med = med.withColumn("gap", F.col("median_positive") - F.col("median_negative"))
    return med.join(auc(scores, keys, score, positive), keys)
