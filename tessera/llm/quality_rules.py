"""Operator 6, quality rules: a rule bitmask ledger (DataFrame functions only).

``ledger`` measures every whole text once and stores, next to the
measurements, one failure bit per rule. Policies are versioned bit masks that
are applied to the stored bits, so a new policy reads a narrow table and
never the texts again. ``ablation`` shows what each rule contributes, from a
bitwise aggregation of the ledger (one group per distinct failure mask).

All measurements are made inside the row with array functions: no explode,
no shuffle, and time n log n in a text's length (a long text is not compared
with itself). Words are ``[^\\x20\\x09-\\x0D]+``; a null text has no words.

Defined results: null or empty texts have no words and fail ``few_words``;
repeated rows are measured alike; an empty table gives an empty ledger. The
ledger has the id column and its own columns only, so extra or clashing input
columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import let

from .common import GAP_RE

WINDOW = 5

# Rule -> bit. The order is part of the stored format: add at the end only.
RULES = ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words")
BIT = {name: 1 << i for i, name in enumerate(RULES)}

# Policy version -> rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": RULES,
}


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def _repeat_words(words: Column) -> Column:
    """Words covered by a WINDOW-word window that occurs twice or more in the text.

    Window hashes (64 bits) that are all distinct end the work for most
    texts. Otherwise the sorted (hash, start) array puts equal windows next to
    each other; their starts, sorted again, give the covered words.
    """
    starts = F.when(F.size(words) > WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)) \
        .otherwise(F.array().cast("array<int>"))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: let(
            F.sort_array(F.transform(
                F.filter(s, lambda p, j: (p["h"] == F.get(s, j - 1)["h"]) | (p["h"] == F.get(s, j + 1)["h"])),
                lambda p: p["i"])),
            lambda at: F.aggregate(
                F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)))),
                F.lit(0).cast("long"), lambda acc, x: acc + x)))

    hashes = let(words, lambda w: F.transform(
        starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
               .otherwise(covered(h)))


def measure(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col), text.alias("t")).select(
        F.col(id_col),
        F.filter(F.split("t", GAP_RE, -1), lambda x: x != "").alias("w"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            lambda ls: F.struct(F.size(ls).cast("long").alias("n"),
                                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"))).alias("ls"))
    return base.select(
        F.col(id_col),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols", F.col("ls.n").alias("n_lines"), F.col("ls.dup").alias("n_dup_lines"),
        _repeat_words(F.col("w")).alias("n_repeat_words"))


def failure_bits(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) -> Column:
    """One bit for each failed rule; integer comparisons only."""
    fails = {
        "few_words": n_words < 10,
        "repeated_windows": 100 * n_repeat_words > 20 * n_words,
        "symbols": 10 * n_symbols > 3 * n_words,     # three symbols for ten words
        "duplicate_lines": 10 * n_dup_lines > 3 * n_lines,
        "short_words": word_chars < 2 * n_words,     # mean below 2 characters
        "long_words": word_chars > 20 * n_words,     # mean above 20 characters
    }
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(fails[r], F.lit(BIT[r]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Measurements of every text and its failure bits (all rules, evaluated once)."""
    m = measure(docs, text_col, id_col)
    cols = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    return m.withColumn("fail_bits", failure_bits(*[F.col(c) for c in cols]))


def apply_policy(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds ``policy`` and ``kept``: no rule of the policy failed."""
    return (led.withColumn("policy", F.lit(policy))
            .withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0))


def ablation(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: texts that fail it, and texts that only it
    rejects (they return if the rule is dropped). The ledger is first
    aggregated to its distinct masks (at most 2^rules rows); an empty one gives no rows."""
    masks = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("m")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit"))
                                for r in POLICIES[policy]])).alias("r")
    return (masks.select("m", "n", rules).groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(F.col("m").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
                 F.sum(F.when(F.col("m") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this_rule"),
                 F.bit_or("m").alias("masks_seen")))
