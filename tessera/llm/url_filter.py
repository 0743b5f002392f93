"""Operator 7, URL filters: weighted URL vocabulary with Aho-Corasick.

Prefix rules (host suffix + path prefix, the longest one that fits wins) come
first. Where no rule fits, the weights of the vocabulary decide: an
Aho-Corasick automaton scans the URLs of a batch together, hits are placed in
their rows and checked in arrays. A hit counts only with boundaries: the
characters next to it are not ASCII letters or digits. The weights of the
*distinct* terms of a URL are added up, and it is blocked where they reach the
threshold: one strict term does, soft terms only several together.

The vocabulary (at most ``MAX_TERMS`` terms, also from a table) and the rules
travel with the task, so nothing is joined or shuffled: the operator is one
projection over the rows.

Defined results: a null URL, or one without ``://``, has an empty host and
path, fits no rule and is judged by its terms alone (null: none, allowed).
Repeated rows are judged alike; an empty table gives an empty table. Input
columns named like an output column are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# (rule, verdict); fixed by the query contract.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block"))

# Vocabulary with weights: a strict term reaches THRESHOLD alone, soft terms only together.
THRESHOLD, STRICT_WEIGHT, SOFT_WEIGHT = 100, 100, 50
STRICT = ("adult", "casino", "escort", "hentai", "malware", "nude", "phishing", "porn", "poker", "viagra",
          "warez", "xxx")
SOFT = ("ads", "bet", "bets", "bonus", "cheap", "coupon", "crack", "dating", "deals", "farm", "free", "gamble",
        "jackpot", "keygen", "loan", "lottery", "pills", "promo", "seo", "sexy", "spam", "torrent", "track", "win")
VOCABULARY = {**dict.fromkeys(STRICT, STRICT_WEIGHT), **dict.fromkeys(SOFT, SOFT_WEIGHT)}

MAX_TERMS = 100_000  # a vocabulary travels with every task
SCAN_CHARS = 1 << 22  # URLs are scanned together up to about this many characters


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all other characters unchanged."""
    return F.translate(c, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return (lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host (or a parent domain)
    and path prefix; nulls where none fits. Equal lengths: by rule text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tested first in the end
        domain, prefix = text.split("/", 1)
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def checked_vocabulary(terms, max_terms: int = MAX_TERMS) -> dict[str, int]:
    """{lower-cased term: weight} of (term, weight) pairs; of a repeated term the highest weight.

    Null and empty terms and null weights are left out. A term may not hold a
    line break (URLs are scanned together, one a line) and a weight is whole.
    """
    out: dict[str, int] = {}
    for term, weight in terms:
        if not term or weight is None:
            continue
        term = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in term)
        if "\n" in term or int(weight) != weight:
            raise ValueError(f"not a term with a whole weight: {term!r}, {weight!r}")
        out[term] = max(int(weight), out.get(term, int(weight)))
        if len(out) > max_terms:
            raise ValueError(f"more than {max_terms} terms")
    return out


def read_vocabulary(table: DataFrame, max_terms: int = MAX_TERMS) -> dict[str, int]:
    """The vocabulary of a table (term, weight). Its size is checked before it is read: beyond
    ``max_terms`` rows of distinct terms it is refused, not cut."""
    term = lower_ascii(F.col("term").cast("string"))
    rows = table.filter(F.col("term").isNotNull() & F.col("weight").isNotNull()).groupBy(term.alias("term")).agg(
        F.max("weight").alias("weight"))
    if rows.count() > max_terms:
        raise ValueError(f"more than {max_terms} terms")
    return checked_vocabulary(((r.term, r.weight) for r in rows.collect()), max_terms)


def term_hits(urls: list[str], auto, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every distinct term that stands between boundaries in a URL, in one scan of all URLs."""
    text = "\n".join(urls)
    found = list(auto.iter(text)) if len(auto) else []
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end, term = (np.array(x, np.int64) for x in zip(*found))
    code = np.frombuffer(f"\n{text}\n".encode("utf-32-le", "surrogatepass"), np.uint32)  # one character to the right
    own = ((code >= 48) & (code <= 57)) | ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))
    begin = end - lengths[term] + 1
    free = ~own[begin] & ~own[end + 2]
    first = np.cumsum([0] + [len(u) + 1 for u in urls[:-1]])
    row = np.searchsorted(first, begin[free], side="right") - 1
    pair = np.unique(row * len(lengths) + term[free])
    return pair // len(lengths), pair % len(lengths)


def _counter(vocabulary: dict[str, int], threshold: int):
    @F.pandas_udf("n_strict long, n_soft long, weight long")
    def count(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for k, t in enumerate(vocabulary):
            auto.add_word(t, k)
        if len(auto):
            auto.make_automaton()
        lengths = np.array([len(t) for t in vocabulary], np.int64)
        weights = np.array(list(vocabulary.values()), np.int64)

        def one(urls: list[str]) -> np.ndarray:
            row, term = term_hits(urls, auto, lengths)
            out = np.zeros((len(urls), 3), np.int64)
            np.add.at(out, (row, np.where(weights[term] >= threshold, 0, 1)), 1)
            np.add.at(out[:, 2], row, weights[term])
            return out

        for batch in series:
            urls = [u or "" for u in batch]
            done, part, size = [], [], 0
            for u in urls:
                if part and size + len(u) > SCAN_CHARS:
                    done.append(one(part))
                    part, size = [], 0
                part.append(u)
                size += len(u)
            if part:
                done.append(one(part))
            yield pd.DataFrame(np.concatenate(done) if done else np.zeros((0, 3), np.int64),
                               columns=["n_strict", "n_soft", "weight"])
    return count


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, vocabulary: dict[str, int] | None = None,
               threshold: int = THRESHOLD) -> DataFrame:
    """``pages`` plus host, path, rule, n_strict, n_soft (distinct terms), weight, verdict.

    ``vocabulary`` is {term: weight} (``read_vocabulary`` takes it from a table).
    Where no rule fits, a URL is blocked if the weights of its distinct terms
    reach ``threshold``; a term that reaches it alone is strict, any other soft.
    """
    vocabulary = checked_vocabulary((VOCABULARY if vocabulary is None else vocabulary).items())
    url = F.col(url_col).cast("string")
    host, path = url_parts(url)
    made = ["host", "path", "rule", "n_strict", "n_soft", "weight", "verdict"]
    rule, says = longest_rule(F.col("__host"), F.col("__path"), rules)
    df = (pages.withColumn("__host", host).withColumn("__path", path)
          .withColumn("__rule", F.struct(rule.alias("rule"), says.alias("says")))
          .withColumn("__terms", _counter(vocabulary, threshold)(lower_ascii(url))))
    bad = F.col("__terms.weight") >= threshold
    verdict = F.coalesce(F.col("__rule.says"), F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return df.select(*[c for c in pages.columns if c not in made],
                     F.col("__host").alias("host"), F.col("__path").alias("path"),
                     F.col("__rule.rule").alias("rule"), F.col("__terms.n_strict").alias("n_strict"),
                     F.col("__terms.n_soft").alias("n_soft"), F.col("__terms.weight").alias("weight"),
                     verdict.alias("verdict"))
