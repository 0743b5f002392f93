"""Operator 1, toxicity: compression-distance classification.

Two zstandard dictionaries are trained on a bounded sample of labelled texts:
an ordinary one on pieces of ordinary texts, and a toxic one on the passages
of toxic texts whose byte ``GRAM``-grams are far more frequent there, each
distinct passage counted by the logarithm of its frequency, so that the common
stems of one language leave room for those of others. A text is cut
into overlapping windows; each is compressed once with the ordinary dictionary
and once with the ordinary and the toxic one behind it. The difference of both
lengths is what the toxic dictionary saves: ordinary content costs the same in
both, toxic content is shorter in the second. Window thresholds (1 to LEVELS
saved bytes) give counts for each text, and a logistic calibration, fitted on
training texts that the dictionaries have not seen, turns them into a score.

Each window starts with a fixed marker that both dictionaries hold, so that a
window always has a sequence section and a saved byte is a saved byte.

Fitting reads at most ``ROWS_PER_LABEL`` whole texts of each label. Scoring is
one projection over all rows (no shuffle); the model is a few ten kilobytes.

Defined results: null and empty texts have no windows and get the score of a
text without any saving; texts of any length are scored whole; repeated rows
score alike; without labels of both kinds every score is 0. Only the id and
text columns are read. Letters A-Z count as lower case.
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
from .labelled import logistic, sample

ROWS_PER_LABEL = {0: 8000, 1: 4000}
WINDOW, STEP = 56, 40
LEVELS = 9
ORDINARY_BYTES, TOXIC_BYTES = 60_000, 3_000
PIECE, PIECES = 64, 250_000
GRAM = 7  # short grams of a rare language's toxic stems are common in its other words
MIN_TEXTS, MIN_SHARE, LIFT = 5, 1 / 150, 25
COPIED = 32  # bytes in a row that only copies share
POSITIVE_WEIGHT = 2.0
CUT = 0.7
MARKER = bytes(range(200, 216))


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None


def _dictionary(samples: list[bytes], size: int, k: int) -> bytes:
    """Content of a trained dictionary; few samples are taken as they are."""
    import zstandard

    if sum(map(len, samples)) > 20 * size:
        return zstandard.train_dictionary(size + 400, samples, k=k, d=6).as_bytes()[-size:]
    return b"".join(samples)[-size:]


class Savings:
    """Saved bytes of windows under the two dictionaries of a model."""

    def __init__(self, model: ToxicityModel):
        import zstandard as z

        params = z.ZstdCompressionParameters(
            window_log=17, chain_log=16, hash_log=16, search_log=5, min_match=4, target_length=16,
            strategy=z.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compressors = []
        for content in (MARKER + model.ordinary, MARKER + model.ordinary + model.toxic):
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.compressors.append(z.ZstdCompressor(compression_params=params, dict_data=d))

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text of each window, saved bytes)."""
        import zstandard as z

        n = np.diff(offs)
        count = np.where(n > 0, -(-np.maximum(n - WINDOW, 0) // STEP) + 1, 0)
        doc = np.repeat(np.arange(len(n)), count)
        if not len(doc):
            return doc, np.zeros(0, np.int64)
        start = offs[doc] + vec.ranges(np.zeros(len(n), np.int64), count) * STEP
        size = np.minimum(WINDOW, offs[doc + 1] - start)
        m = len(MARKER)
        at = np.cumsum(size + m) - size - m
        data = np.empty(int((size + m).sum()), np.uint8)
        data[(at[:, None] + np.arange(m)).ravel()] = np.tile(np.frombuffer(MARKER, np.uint8), len(at))
        data[vec.ranges(at + m, size)] = vec.ASCII_LOWER[buf[vec.ranges(start, size)]]
        segments = z.BufferWithSegments(data.tobytes(), np.column_stack([at, size + m]).astype(np.uint64).tobytes())
        plain, both = (np.fromiter(map(len, c.multi_compress_to_buffer(segments, threads=0)), np.int64, len(at))
                       for c in self.compressors)
        return doc, plain - both


def features(savings: Savings, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per text: counts of windows that save at least 1 .. LEVELS bytes (log and
    rate), log of the number of windows, and the largest saving."""
    doc, saved = savings(buf, offs)
    k = len(offs) - 1
    windows = np.bincount(doc, minlength=k)
    counts = np.stack([np.bincount(doc, saved >= level, k) for level in range(1, LEVELS + 1)], axis=1)
    most = np.zeros(k)
    np.maximum.at(most, doc, np.minimum(saved, LEVELS + 3))
    many = np.maximum(windows, 1)
    return np.column_stack([np.log1p(counts), 10 * counts / many[:, None], np.log(many), most])


def _passages(texts: list[bytes], hot: np.ndarray) -> dict[bytes, int]:
    """Maximal runs of bytes covered by hot grams, and how often each occurs."""
    out: dict[bytes, int] = {}
    for t in texts:
        g = _grams(t)
        if not len(g):
            continue
        cover = vec.covered(np.flatnonzero(np.isin(g, hot)), GRAM, len(t)).astype(np.int8)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], cover, [0]])))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            out[t[s:e]] = out.get(t[s:e], 0) + 1
    return out


def _grams(t: bytes) -> np.ndarray:
    """The grams of a text as integers of GRAM <= 8 bytes."""
    b = np.frombuffer(t, np.uint8).astype(np.uint64)
    n = len(b) - GRAM + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(GRAM if n > 0 else 0):
        out = (out << np.uint64(8)) | b[k:k + n]
    return out


def _distinct(texts: list[bytes]) -> list[bytes]:
    """Texts without near copies of earlier ones: what copies share is no sign of
    a kind of text. Sampled hashes of COPIED bytes tell them."""
    kept, seen = [], set()
    for t in dict.fromkeys(texts):
        codes = vec.BYTE_CODE[np.frombuffer(t, np.uint8)]
        h = vec.Rolling(codes).grams(COPIED) if len(codes) >= COPIED else np.zeros(0, np.uint64)
        some = set(h[h % np.uint64(64) == 0].tolist())
        if len(some & seen) <= len(some) / 4:
            kept.append(t)
            seen |= some
    return kept


def _hot_grams(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """Grams that are LIFT times as frequent in toxic texts as in ordinary ones."""
    parts = [np.unique(_grams(t)) for t in toxic]
    grams, n = np.unique(np.concatenate(parts), return_counts=True)
    del parts
    often = n >= max(MIN_TEXTS, MIN_SHARE * len(toxic))
    grams, n = grams[often], n[often]
    other = np.zeros(len(grams), np.int64)
    for t in ordinary if len(grams) else ():
        g = np.unique(_grams(t))
        at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
        other[at[grams[at] == g]] += 1
    return grams[n / len(toxic) > LIFT * (other + 1) / len(ordinary)]


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", id_col: str = "doc_id",
                 text_col: str = "text", rows_per_label=None) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows of ``learn`` (a filter)."""
    bound = {**ROWS_PER_LABEL, **(rows_per_label or {})}
    own = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    rows = sample(own, labels, label, learn, bound, id_col) \
        .select("__y", F.encode("__t", "utf-8").alias("t")).toArrow()
    lower = bytes(vec.ASCII_LOWER)
    for y, t in zip(rows.column("__y").to_pylist(), rows.column("t")):
        texts[y].append(t.as_py().translate(lower))
    del rows
    # two of three texts train the dictionaries, the third calibrates
    train = {y: _distinct([t for k, t in enumerate(texts[y]) if k % 3]) for y in texts}
    check = {y: texts[y][::3] for y in texts}
    if not all(train.values()) or not all(check.values()):
        return ToxicityModel(b"", b"", None)
    rng = np.random.default_rng(1)
    found = _passages(train[1], _hot_grams(train[1], train[0]))
    passages = [p for p, n in sorted(found.items()) for _ in range(1 + int(np.log2(n)))]
    rng.shuffle(passages)
    joined = b"\x01".join(passages)
    toxic = _dictionary([joined[k:k + 256] for k in range(0, len(joined), 256)], TOXIC_BYTES, 16)
    pieces = [t[k:k + PIECE] for t in train[0] for k in range(0, len(t), PIECE)]
    rng.shuffle(pieces)
    model = ToxicityModel(_dictionary(pieces[:PIECES], ORDINARY_BYTES, 64), toxic, None)
    savings = Savings(model)
    x, y = [], []
    for v, ts in check.items():
        for _, buf, offs in vec.text_arrays(pa.array(ts, pa.binary())):
            x.append(features(savings, buf, offs))
            y.append(np.full(len(offs) - 1, v))
    x, y = np.concatenate(x), np.concatenate(y)
    model.weights = logistic(x, y, np.where(y == 1, POSITIVE_WEIGHT, 1.0))
    return model


def _score(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        savings = Savings(model) if model.weights is not None else None
        for b in batches:
            score, most = [np.zeros(0)], [np.zeros(0)]
            for _, buf, offs in vec.text_arrays(b.column(text_at)):
                if savings is None:
                    score.append(np.zeros(len(offs) - 1))
                    most.append(np.zeros(len(offs) - 1))
                    continue
                x = features(savings, buf, offs)
                z = model.weights[0] + x @ model.weights[1:]
                score.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                most.append(x[:, -1])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.concatenate(score)), pa.array(np.concatenate(most).astype(np.int64))],
                names=["id", "score", "most_saved"])
    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score, most_saved (bytes saved in the best window), predicted."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = own.mapInArrow(_score(shared, 1), T.StructType(
        [T.StructField("id", own.schema["id"].dataType), T.StructField("score", T.DoubleType()),
         T.StructField("most_saved", T.LongType())]))
    return out.select(F.col("id").alias("doc_id"), "score", "most_saved",
                      F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
