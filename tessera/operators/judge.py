"""Pairwise judging with a context budget and a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROMPT_OVERHEAD = 120  # tokens reserved for the template

# Our own fixed prompt template (placeholders {original} / {submission}).
PROMPT_TEMPLATE = ("Compare the two texts below and decide whether the second one was copied "
                   "from the first.\n\n[ORIGINAL]\n{original}\n\n[SUBMISSION]\n{submission}\n\n"
                   "Reply YES if it was copied, otherwise NO.")


def fit_budget(df: DataFrame, max_context: int, a: str = "tokens_a", b: str = "tokens_b",
               overhead: int = PROMPT_OVERHEAD) -> DataFrame:
    """When both sides exceed max_context - overhead, each side longer
    than half of it is cut to that half; otherwise both stay whole."""
    avail = max_context - overhead
    half = avail // 2
    na, nb = F.size(a), F.size(b)
    over = (na + nb) > avail
    cut = lambda c, n: F.when(over & (n > half), F.slice(c, 1, half)).otherwise(F.col(c))
    return df.withColumn(a, cut(a, na)).withColumn(b, cut(b, nb))


def build_prompt(original: Column, submission: Column) -> Column:
    """The template with both texts."""
    pre, rest = PROMPT_TEMPLATE.split("{original}")
    mid, post = rest.split("{submission}")
    return F.concat(F.lit(pre), original, F.lit(mid), submission, F.lit(post))


def default_logits(a, b) -> tuple[Column, Column]:
    """Deterministic stand-in scorer: yes = 8 * Jaccard(distinct tokens) - 4, no = 0."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - inter
    jac = F.when(union > 0, inter / union).otherwise(F.lit(0.0))
    return (8.0 * jac - 4.0), F.lit(0.0)


def judge(df: DataFrame, a: str = "tokens_a", b: str = "tokens_b",
          scorer_factory: Callable[[], Callable[[pd.DataFrame], tuple]] | None = None,
          keys: tuple[str, ...] = ()) -> DataFrame:
    """(yes_logit, no_logit) per pair. Default: the builtin stand-in
    scorer. A pluggable scorer (e.g. a local model) is built once per task
    and applied to Arrow batches of pairs (``mapInPandas``)."""
    if scorer_factory is None:
        y, n = default_logits(a, b)
        return df.select(*keys, a, b, y.alias("yes_logit"), n.alias("no_logit"))

    def run(batches):
        scorer = scorer_factory()
        for pdf in batches:
            yes, no = scorer(pdf)
            out = pdf.copy()
            out["yes_logit"] = np.asarray(yes, dtype="float64")
            out["no_logit"] = np.asarray(no, dtype="float64")
            yield out

    base = df.select(*keys, a, b)
    schema = base.schema.add("yes_logit", "double").add("no_logit", "double")
    return base.mapInPandas(run, schema=schema)


def two_way_softmax(yes: Column, no: Column) -> Column:
    """I4: P(YES) = softmax([yes, no])[0] = 1 / (1 + exp(no - yes))."""
    return 1.0 / (1.0 + F.exp(no - yes))
