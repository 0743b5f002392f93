"""Operator 3, quality classifier: a factorisation machine.

Features of a text: its hashed lower-cased words (log counts, unit length),
structure statistics (case, symbols, repetition, lines, ...) and metadata
(sizes), the last two as quantile bins learned from the sample. The model has
a bias, one weight and RANK factors for each feature. Pairwise interactions
are scored in linear time by the sum-of-squares identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Fitting reads the features of at most ``ROWS_PER_LABEL`` labelled rows of each
label (made on the executors; texts stay there) and runs Adagrad epochs with a
held-back part of the sample for stopping. Scoring is one projection over all
rows, without a shuffle; the model is about a megabyte, whatever the corpus.

Defined results: null and empty texts have no words and are scored by their
statistics; texts of any length are scored whole; repeated rows score alike;
without labels of both kinds every score is 1. Input columns pass through
unread but for the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .common import guarded
from .labelled import sample

ROWS_PER_LABEL = 4000
BUCKETS = 1 << 13
RANK = 6
BINS = 12
BIN_VALUE = 0.4
EPOCHS, RATE, L2 = 12, 0.08, 2e-5
CUT = 0.7

# byte classes whose share of a text is a statistic
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "symbol": b"#*$%&|<>", "mark": b"!?", "stop": b".", "comma": b",", "space": b" \t\n\x0b\x0c\r", "at": b"@/:_=",
}
STATS = (*_CLASSES, "high", "log_bytes", "log_words", "log_lines", "word_bytes", "longest_word", "distinct",
         "same_next", "top_word", "repeat_5", "same_line", "line_words", "ends_stop")


@dataclass
class FMModel:
    edges: np.ndarray           # (statistics, BINS - 1) bin borders
    bias: float
    weight: np.ndarray          # (features,)
    factors: np.ndarray         # (features, RANK)


def _shares(total: np.ndarray, first: np.ndarray) -> np.ndarray:
    cum = np.concatenate([[0], np.cumsum(total)])
    return (cum[first[1:]] - cum[first[:-1]]).astype(float)


def describe(buf: np.ndarray, offs: np.ndarray):
    """(statistics per text, word bucket entries as (text, bucket, value))."""
    k = len(offs) - 1
    low = vec.ASCII_LOWER[buf]
    starts, ends, first = vec.words(low, offs, vec.SPACES)
    n, size = np.diff(first).astype(float), np.diff(offs).astype(float)
    many, some = np.maximum(n, 1), np.maximum(size, 1)
    cols = []
    for chars in _CLASSES.values():
        table = np.zeros(256, bool)
        table[list(chars)] = True
        cols.append(_shares(table[buf], offs) / some)
    cols.append(_shares(buf >= 128, offs) / some)
    lines = _shares(buf == 10, offs) + (size > 0)
    cols += [np.log1p(size), np.log1p(n), np.log1p(lines)]
    length = (ends - starts).astype(float)
    doc = np.repeat(np.arange(k), np.diff(first))
    longest = np.zeros(k)
    np.maximum.at(longest, doc, length)
    cols += [_shares(length, first) / many, np.log1p(longest)]
    h = vec.Rolling(vec.BYTE_CODE[low]).runs(starts, ends)
    # distinct words of each text
    order = np.lexsort((h, doc))
    head = np.ones(len(h), bool)
    head[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = np.flatnonzero(head)
    owner, count = doc[order][at], np.diff(np.append(at, len(h)))
    cols.append(np.bincount(owner, minlength=k) / many)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    cols.append(_shares(same, first) / many)
    top = np.zeros(k)
    np.maximum.at(top, owner, count)
    cols.append(top / many)
    cols.append(_repeated(h, doc, k, 5) / many)
    breaks = np.flatnonzero(buf == 10)
    line_at = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    line_first = np.arange(k + 1) + np.searchsorted(breaks, offs)
    line_end = np.empty(len(line_at), np.int64)
    line_end[:-1] = line_at[1:] - 1
    line_end[line_first[1:] - 1] = offs[1:]
    lh = vec.Rolling(vec.BYTE_CODE[buf]).runs(line_at, line_end)
    full = line_end > line_at
    cols.append(_repeated(lh[full], np.repeat(np.arange(k), np.diff(line_first))[full], k, 1) / np.maximum(lines, 1))
    cols.append(np.log1p(n / np.maximum(lines, 1)))
    ends_stop = np.zeros(k)
    full = size > 0
    ends_stop[full] = np.isin(buf[offs[1:][full] - 1], list(b".!?"))
    cols.append(ends_stop)
    bucket = (h[order][at] >> np.uint64(40)).astype(np.int64) % BUCKETS
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(owner, value * value, k))
    return np.column_stack(cols), (owner, bucket, value / norm[owner])


def _repeated(h: np.ndarray, doc: np.ndarray, k: int, width: int) -> np.ndarray:
    """Per text: runs of ``width`` units that repeat an earlier run."""
    if len(h) < width:
        return np.zeros(k)
    g = vec.Rolling(h).grams(width) if width > 1 else h
    ok = doc[width - 1:] == doc[:len(doc) - width + 1]
    g, d = g[ok], doc[:len(doc) - width + 1][ok]
    order = np.lexsort((g, d))
    again = np.zeros(len(g), bool)
    again[1:] = (g[order][1:] == g[order][:-1]) & (d[order][1:] == d[order][:-1])
    return np.bincount(d[order], again, k)


def entries(stats: np.ndarray, words, edges: np.ndarray):
    """All features as (text, feature, value), sorted by text."""
    owner, bucket, value = words
    k, s = stats.shape
    bins = np.stack([np.searchsorted(edges[j], stats[:, j], "right") for j in range(s)], axis=1)
    texts = np.concatenate([owner, np.repeat(np.arange(k), s)])
    feature = np.concatenate([bucket, (BUCKETS + np.arange(s) * BINS + bins).ravel()])
    values = np.concatenate([value, np.full(k * s, BIN_VALUE, value.dtype)])
    order = np.argsort(texts, kind="stable")
    return texts[order], feature[order], values[order]


def raw_scores(model: FMModel, texts, feature, value, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(score before the sigmoid, factor sums) of k texts; every text has an entry."""
    at = np.searchsorted(texts, np.arange(k))
    vx = model.factors[feature] * value[:, None]
    sums = np.add.reduceat(vx, at)
    squares = np.add.reduceat((vx * vx).sum(axis=1), at)
    linear = np.add.reduceat(model.weight[feature] * value, at)
    return model.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts, feature, value, y: np.ndarray, edges: np.ndarray, share: float | None = None) -> FMModel:
    """Adagrad on logistic loss; every fifth row is held back to choose the epoch.

    ``share`` is the share of label 1 among all labelled rows: the rows of a
    sample with another share are weighted back to it.
    """
    k, size = len(y), BUCKETS + len(STATS) * BINS
    rng = np.random.default_rng(3)
    rate = np.clip(y.mean() if share is None else share, 1e-3, 1 - 1e-3)
    weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    m = FMModel(edges, float(np.log(rate / (1 - rate))), np.zeros(size), rng.normal(0, 0.02, (size, RANK)))
    gw, gv, gb = np.full(size, 1e-3), np.full((size, RANK), 1e-3), 1e-3
    start = np.searchsorted(texts, np.arange(k + 1))
    held = np.arange(k) % 5 == 4

    def part(rows):
        n = start[rows + 1] - start[rows]
        pick = vec.ranges(start[rows], n)
        return np.repeat(np.arange(len(rows)), n), feature[pick], value[pick]

    best, best_loss = None, np.inf
    check = np.flatnonzero(held) if held.sum() else np.arange(k)
    for _ in range(EPOCHS):
        rows = rng.permutation(np.flatnonzero(~held) if (~held).sum() else np.arange(k))
        for lo in range(0, len(rows), 128):
            r = rows[lo:lo + 128]
            t, f, x = part(r)
            z, sums = raw_scores(m, t, f, x, len(r))
            g = weight[r] * (_sigmoid(z) - y[r]) / len(r)
            used, inv = np.unique(f, return_inverse=True)
            gx = g[t] * x
            dw = np.bincount(inv, gx, len(used)) + L2 * m.weight[used]
            dv = np.zeros((len(used), RANK))
            np.add.at(dv, inv, gx[:, None] * (sums[t] - m.factors[f] * x[:, None]))
            dv += L2 * m.factors[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += g.sum() ** 2
            m.weight[used] -= RATE * dw / np.sqrt(gw[used])
            m.factors[used] -= RATE * dv / np.sqrt(gv[used])
            m.bias -= RATE * g.sum() / np.sqrt(gb)
        p = np.clip(_sigmoid(raw_scores(m, *part(check), len(check))[0]), 1e-6, 1 - 1e-6)
        loss = -(weight[check] * (y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p))).mean()
        if loss < best_loss:
            best, best_loss = FMModel(edges, m.bias, m.weight.copy(), m.factors.copy()), loss
    best.weight, best.factors = best.weight.astype(np.float32), best.factors.astype(np.float32)
    # CUT is put in the middle of the widest gap that divides the held-back rows with the least error
    z = raw_scores(best, *part(check), len(check))[0]
    order = np.argsort(z)
    z, good = z[order], y[check][order] == 1
    wrong = np.concatenate([[0], np.cumsum(np.where(good, weight[check][order], 0))]) \
        + np.concatenate([np.cumsum(np.where(good, 0, weight[check][order])[::-1])[::-1], [0]])
    low, high = np.concatenate([[z[0]], z]), np.concatenate([z, [z[-1]]])
    least = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    k = least[np.argmax((high - low)[least])]
    best.bias += float(np.log(CUT / (1 - CUT)) - (low[k] + high[k]) / 2)
    return best


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, buf, offs in vec.text_arrays(b.column(1)):
            stats, (owner, bucket, value) = describe(buf, offs)
            cut = np.searchsorted(owner, np.arange(len(offs))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, len(offs) - 1), pa.array(list(stats), pa.list_(pa.float64())),
                 pa.ListArray.from_arrays(pa.array(cut), pa.array(bucket.astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(cut), pa.array(value.astype(np.float32)))],
                names=["y", "stats", "buckets", "values"])


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", id_col: str = "doc_id",
                text_col: str = "text", rows_per_label: int = ROWS_PER_LABEL) -> FMModel | None:
    """Fit on a bounded sample of the labelled rows of ``learn`` (a filter)."""
    own = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__t"))
    rows = sample(own, labels, label, learn, rows_per_label, id_col).select("__y", "__t") \
        .mapInArrow(_described, "y int, stats array<double>, buckets array<int>, values array<float>").toArrow() \
        .combine_chunks()
    y = rows.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    mix = np.random.default_rng(5).permutation(len(y))
    rows, y = rows.take(pa.array(mix)).combine_chunks(), y[mix]
    flat = (lambda c: rows.column(c).combine_chunks())
    stats = flat("stats").flatten().to_numpy().reshape(len(y), len(STATS))
    lists = flat("buckets")
    owner = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy())
    words = owner, lists.flatten().to_numpy(), flat("values").flatten().to_numpy()
    del rows
    # borders from both labels alike, so that the rarer one gets bins of its own
    spread = [np.concatenate([np.quantile(stats[y == v, j], np.linspace(0, 1, (BINS + 3) // 2)) for v in (0, 1)])
              for j in range(len(STATS))]
    edges = np.stack([np.quantile(s, np.linspace(0, 1, BINS + 1)[1:-1]) for s in spread])
    share = labels.filter(learn).filter(F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return train(*entries(stats, words, edges), y, edges, share)


def _score(shared, text_at: int, n_cols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            score = [np.zeros(0)]
            for _, buf, offs in vec.text_arrays(b.column(text_at)):
                k = len(offs) - 1
                if model is None:
                    score.append(np.ones(k))
                    continue
                stats, words = describe(buf, offs)
                score.append(_sigmoid(raw_scores(model, *entries(stats, words, model.edges), k)[0]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n_cols)),
                                              pa.array(np.concatenate(score).astype(np.float64))],
                                             names=[*b.schema.names, "score"])
    return run


def score_quality(docs: DataFrame, model: FMModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` plus score (0 to 1) and predicted (score >= CUT)."""
    own, names = guarded(docs.select(*[c for c in docs.columns if c not in {"score", "predicted"} - {text_col}]))
    at = names.index(text_col)
    own = own.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = own.mapInArrow(_score(shared, at, len(names)), T.StructType(
        [*[T.StructField(f.name, f.dataType) for f in own.schema.fields], T.StructField("score", T.DoubleType())]))
    return out.toDF(*names, "score").withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))
