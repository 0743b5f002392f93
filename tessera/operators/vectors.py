"""Vector-based similarity: windows, encoders, pooling, cosine (H1-H6)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import let, safe_range
from .meeting import BLOCK_BYTES, CELLS, OUT_ROWS, Found, meet, sides


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def n_windows(n: Column, max_tokens: int, stride: int) -> Column:
    """1 if n <= inner else ceil((n - inner) / stride) + 1, inner = max_tokens - 2."""
    inner = max_tokens - 2
    if stride > inner:
        raise ValueError("stride must not exceed max_tokens - 2")
    return F.when(n <= inner, F.lit(1)).otherwise(F.ceil((n - inner) / F.lit(stride)).cast("int") + 1)


def chunk(df: DataFrame, max_tokens: int = 512, stride: int = 256, tokens_col: str = "tokens",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """H1: sliding windows of max_tokens - 2 tokens every ``stride`` tokens,
    stopping once the end is covered: (keep..., window, start, tokens)."""
    inner = max_tokens - 2

    def windows(t: Column) -> Column:  # the tokens are made once, not for every window
        return F.transform(safe_range(n_windows(F.size(t), max_tokens, stride) - 1, 0), lambda k: F.struct(
            k.alias("window"), (k * stride).alias("start"), F.slice(t, k * stride + 1, inner).alias("tokens")))

    # outer, then a filter: no size check on the windows is pushed into the scan
    return df.select(*keep, F.inline_outer(let(F.col(tokens_col), windows))).filter(F.col("window").isNotNull())


def hashing_embedding(tokens, dim: int = 64) -> Column:
    """H2 default encoder: token counts hashed into ``dim`` buckets
    (pmod(xxhash64(token), dim)), L2-normalised; builtin, deterministic."""
    # the buckets of the tokens and each bucket once more, sorted: the length of a
    # bucket's run, less one, is its count. One pass, whatever the dimension.
    buckets = F.transform(_c(tokens), lambda x: F.pmod(F.xxhash64(x), F.lit(dim)).cast("int"))
    runs = F.sort_array(F.concat(buckets, F.sequence(F.lit(0), F.lit(dim - 1))))

    def counts(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda p, k: (
            F.coalesce(F.get(at, k + 1), F.size(s)) - p - 1).cast("double")))

    return let(let(runs, counts), normalize)


def normalize(v) -> Column:
    def over(x: Column) -> Column:  # the norm is taken once, not for every element
        return let(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e)),
                   lambda norm: F.when(norm > 0, F.transform(x, lambda e: e / norm)).otherwise(x))

    return let(_c(v), over)


def embed(df: DataFrame, tokens_col: str = "tokens", dim: int = 64,
          encoder_factory: Callable[[], Callable[[list], np.ndarray]] | None = None,
          key_cols: tuple[str, ...] = ("doc_id", "window")) -> DataFrame:
    """H2: one vector per row. Default: the builtin hashing encoder. A
    pluggable encoder is built once per Python worker task by
    ``encoder_factory`` and applied to Arrow batches (``mapInPandas``)."""
    if encoder_factory is None:
        return df.select(*key_cols, hashing_embedding(tokens_col, dim).alias("embedding"))

    def run(batches):
        enc = encoder_factory()
        for pdf in batches:
            vecs = enc(list(pdf[tokens_col]))
            out = pdf[list(key_cols)].copy()
            out["embedding"] = [np.asarray(v, dtype="float64").tolist() for v in vecs]
            yield out

    schema = df.select(*key_cols).schema.add("embedding", "array<double>")
    return df.select(*key_cols, tokens_col).mapInPandas(run, schema=schema)


def pool(df: DataFrame, key: str, order_col: str, mode: str = "mean", vec_col: str = "embedding") -> DataFrame:
    """H3: one vector per key. mean: element-wise average over the rows
    (posexplode + avg per dimension, then re-assembled in dimension order --
    the regrouped list is bounded by the dimension, not by the rows);
    cls: the vector of the first row by ``order_col``."""
    if mode == "cls":
        return df.groupBy(key).agg(F.min_by(vec_col, order_col).alias(vec_col))
    if mode != "mean":
        raise ValueError(f"unknown pooling {mode!r}")
    e = df.select(key, F.posexplode(vec_col).alias("i", "v"))
    m = e.groupBy(key, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    g = m.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("_p"))
    return g.select(key, F.transform("_p", lambda x: x["v"]).alias(vec_col))


def cosine(a, b) -> Column:
    """H4: cosine clipped at 0; a zero vector gives 0."""
    a = F.transform(_c(a), lambda x: x.cast("double"))
    b = F.transform(_c(b), lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((na > 0) & (nb > 0), F.greatest(F.lit(0.0), dot / (na * nb))).otherwise(F.lit(0.0))


def max_over_files(scores: DataFrame, sub_key: str, score: str = "similarity") -> DataFrame:
    """H5: best score over a submission's files, floor 0 (partial aggregation)."""
    return scores.groupBy(sub_key).agg(F.greatest(F.coalesce(F.max(score), F.lit(0.0)), F.lit(0.0)).alias(score))


def similar_vectors(df: DataFrame, tau: float, id_col: str = "vec_id", vec_col: str = "embedding",
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """H6: all pairs with cosine >= tau (clones = near points), id_a < id_b.

    Exact, for tau > 0: at a low tau the buckets of an LSH hold most pairs anyway, so
    the vectors are dealt into bounded blocks and each task multiplies two of them as
    matrices (see ``meeting``); what comes near tau is counted anew with the sums of
    ``cosine``. Null vectors and ids match nothing, nor do vectors of two lengths.
    Rows of one id are one vector: its best cosine counts.
    """
    v = df.select(F.col(id_col).alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("arr")).filter(
        F.col("id").isNotNull() & F.col("arr").isNotNull())
    kind = v.schema["id"].dataType.simpleString()
    met = meet(v, "id", F.size("arr") * 8 + 16, block_bytes)
    j = met.groupBy("lo", "hi").applyInArrow(_near(tau), f"id_a {kind}, id_b {kind}, cosine double")
    if v.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return j
    return j.groupBy("id_a", "id_b").agg(F.max("cosine").alias("cosine"))


def _sum(m: np.ndarray) -> np.ndarray:
    """Sums of the rows from left to right, as Spark's ``aggregate`` takes them."""
    return np.cumsum(m, axis=1)[:, -1]


def _near(tau: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        left, right, same = sides(table)
        found = Found(table["id"], ["id_a", "id_b", "cosine"])
        flat = table["arr"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        size = pc.list_value_length(table["arr"]).to_numpy().astype(np.int64)
        start = np.cumsum(size) - size
        for d in np.unique(size[size > 0]):
            a, b = left[size[left] == d], right[size[right] == d]
            if not len(a) or not len(b):
                continue
            x, y = (_normal(flat[start[r][:, None] + np.arange(d)]) for r in (a, b))
            nx, ny = np.sqrt(_sum(x * x)), np.sqrt(_sum(y * y))
            step = max(1, CELLS // len(b))
            for lo in range(0, len(a), step):
                j0 = lo if same else 0
                with np.errstate(invalid="ignore"):
                    hit = np.flatnonzero((x[lo:lo + step] @ y[j0:].T >= tau - 1e-9).reshape(-1))
                i, j = lo + hit // (len(b) - j0), j0 + hit % (len(b) - j0)
                keep = found.rank[a[i]] != found.rank[b[j]]
                if same:
                    keep &= j > i
                i, j = i[keep], j[keep]
                for k in range(0, len(i), CELLS // 64):
                    p, q = i[k:k + CELLS // 64], j[k:k + CELLS // 64]
                    cos = np.maximum(_sum(x[p] * y[q]) / (nx[p] * ny[q]), 0.0)
                    ok = cos >= tau
                    if ok.any():
                        found.add(a[p[ok]], b[q[ok]], (cos[ok],))
                    if found.n >= OUT_ROWS:
                        yield found.batch()
        if found.n:
            yield found.batch()
    return run


def _normal(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt(_sum(m * m))[:, None]
    return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)  # a zero vector is near nothing


QUERY_BYTES = 8 << 20  # size of a block of query vectors


def search_vectors(df: DataFrame, queries: DataFrame, tau: float, id_col: str = "vec_id", vec_col: str = "embedding",
                   block_bytes: int = QUERY_BYTES) -> DataFrame:
    """H6 as an exact search: (query_id, id, cosine) for every row of ``df`` and every
    query with cosine >= tau, a row and the query of its own id left out.

    The queries are a stated set. They are dealt into blocks of about
    ``block_bytes`` by a hash of the id; a block (its size bounded, whatever the
    number of queries) is broadcast as one matrix, and the rows pass it in Arrow
    batches, a slice of rows at a time, without a shuffle. Only pairs above tau
    leave a task. Null vectors and ids match nothing, a zero vector has cosine 0, as
    has one of another length than the query.
    """
    spark = df.sparkSession
    q = queries.select(F.col(id_col).alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull())
    total = q.agg(F.coalesce(F.sum(F.size("v").cast("long") * 8 + 16), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // block_bytes))
    part = F.pmod(F.xxhash64("id"), F.lit(n))
    rows = df.select(F.col(id_col).alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull())
    schema = f"query_id {rows.schema['id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, cosine double"
    out = None
    for k in range(n):  # each collect is bounded by block_bytes
        block = q.filter(part == k).collect()
        by_len = {}
        for r in block:
            by_len.setdefault(len(r.v), []).append(r)
        mats = {d: (np.array([r.id for r in rs]), _unit(np.array([r.v for r in rs], dtype="float64").reshape(len(rs), d)))
                for d, rs in by_len.items()}
        found = rows.mapInArrow(_search(spark.sparkContext.broadcast(mats), tau), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    m = np.nan_to_num(m)  # a null element counts as 0
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _search(block, tau: float, cells: int = 4_000_000):
    def run(batches):
        mats = block.value
        for b in batches:
            ids, vecs = b.column(0), b.column(1)
            flat = vecs.flatten().to_numpy(zero_copy_only=False).astype("float64")
            size = vecs.value_lengths().to_numpy(zero_copy_only=False)
            start = np.concatenate([[0], np.cumsum(size)])[:-1]
            for d, (q_ids, m) in mats.items():
                at = np.flatnonzero(size == d)
                step = max(1, cells // max(len(q_ids), 1))  # rows whose scores are held at a time
                for lo in range(0, len(at), step):
                    own = at[lo:lo + step]
                    x = _unit(flat[start[own][:, None] + np.arange(d)[None, :]].reshape(len(own), d))
                    cos = np.maximum(x @ m.T, 0.0)
                    i, j = np.nonzero(cos >= tau)
                    row_ids = ids.take(pa.array(own[i]))
                    keep = row_ids.to_numpy(zero_copy_only=False) != q_ids[j]
                    i, j = i[keep], j[keep]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q_ids[j]).cast(b.schema.field(0).type), ids.take(pa.array(own[i])), pa.array(cos[i, j])],
                        names=["query_id", "id", "cosine"])
    return run
