"""Operator 8, MinHash near-dedup: universal hash minima, banding, signature
verification, connected components.

1. Each text's set of 5-word shingles (64-bit hashes) is made once. Texts with
   equal sets are one node: copies are aggregated before anything is joined.
2. BANDS bands of ROWS minima, each under its own universal hash a*x+b, give
   bucket keys. At similarity 0.85 a pair misses all of them with probability
   (1 - 0.85^5)^25 = 4e-7.
3. Nodes that share a bucket are linked to the bucket's lowest node; the
   components of this graph (large-star/small-star) are the units of
   verification, and every pair that shares a bucket lies in one unit. A unit
   of more than ``UNIT`` nodes or ``WEIGHT`` shingles is verified bucket by
   bucket, and a bucket of more than that in pairs of blocks, so a task holds
   at most two blocks whatever the size of a group or of its texts.
4. In a task, signatures (one byte for each minimum) rule pairs out that are
   five standard deviations below the threshold; the others are compared on
   their full shingle sets. Pairs that are already connected in the task are
   skipped, and only links that connect leave it: at most one for each node.
5. Components of the links, again by large-star/small-star. Nodes that share an
   id are linked too.

So no pairs are emitted for a group, and all links between different sets
that the bands find are respected, by exact comparison of full sets.

Defined results: texts without words, null or empty, have no shingles and are
components of their own; rows that repeat an id are one document: all of them
get the component that any of their texts reaches, each with the n_shingles of
its own text; a null id counts as the highest and its rows stay apart; an empty table gives an empty result. Input columns of
any names don't matter: only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .common import drop_written, written
from .components import components

SHINGLE = 5
BANDS, ROWS = 25, 5
THRESHOLD = (85, 100)
UNIT = 4096  # nodes of a unit or block that one task verifies
WEIGHT = 1 << 22  # shingles of its sets

_rng = np.random.default_rng(85)
_A = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    low = vec.ASCII_LOWER[buf]
    starts, ends, first = vec.words(low, offs, vec.SPACES)
    roll = vec.Rolling(vec.Rolling(vec.BYTE_CODE[low]).runs(starts, ends))
    grams = roll.grams(size) if len(starts) >= size else np.zeros(0, np.uint64)
    out = []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
        if e - s >= size:
            out.append(np.unique(grams[s:e - size + 1]))
        elif e > s:
            out.append(roll.runs(np.array([s]), np.array([e])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signatures(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, buf, offs in vec.text_arrays(b.column(2)):
                sets = shingle_sets(buf, offs, size)
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                minima = np.zeros((len(full), BANDS * ROWS), np.uint64)
                if len(full):
                    x = np.concatenate(sets)
                    at = (np.cumsum(n) - n)[full]
                    tmp = np.empty_like(x)
                    for k in range(BANDS * ROWS):
                        np.multiply(x, _A[k], out=tmp)
                        np.add(tmp, _B[k], out=tmp)
                        minima[:, k] = np.minimum.reduceat(tmp, at)
                mixed = vec.mix64(minima)
                keys = (mixed.reshape(len(full), BANDS, ROWS) * _A[:ROWS]).sum(axis=2) + _B[:BANDS]
                keys = vec.mix64(keys)
                sig = (mixed & np.uint64(255)).astype(np.uint8)
                row = np.full(len(n), -1)
                row[full] = np.arange(len(full))
                rows = pa.array(np.arange(lo, lo + len(n)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(n.astype(np.int64)),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                               for s in sets], pa.binary()),
                     pa.array([keys[r].view(np.int64) if r >= 0 else None for r in row], pa.list_(pa.int64())),
                     pa.array([sig[r].tobytes() if r >= 0 else None for r in row], pa.binary())],
                    names=["__id", "__th", "n", "node", "bands", "sig"])
    return scan


def _sets(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, buf, offs in vec.text_arrays(b.column(1)):
                rows = pa.array(np.arange(lo, lo + len(offs) - 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(2).take(rows),
                     pa.array([s.tobytes() for s in shingle_sets(buf, offs, size)], pa.binary())],
                    names=["node", "sig", "shingles"])
    return scan


def connect(sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold=THRESHOLD):
    """Links (i, j) that connect nodes: a spanning forest of all pairs of
    ``left`` x ``right`` at the threshold, by exact similarity."""
    num, den = threshold
    n = np.array([len(s) for s in sets])
    at = np.cumsum(n) - n
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(ids.max()) + 1, bool)
    share, k = num / den, sig.shape[1]
    least = k * share - 5 * np.sqrt(k * share * (1 - share))
    group = np.arange(len(sets))
    apart = not np.isin(left, right).any()
    links = []
    for i in left.tolist():
        js = right if apart else right[right > i]
        js = js[(group[js] != group[i]) & (den * n[js] >= num * n[i]) & (den * n[i] >= num * n[js])]
        js = js[(sig[js] == sig[i]).sum(axis=1) >= least] if len(js) else js
        if not len(js):
            continue
        mark[ids[at[i]:at[i] + n[i]]] = True
        part = vec.ranges(at[js], n[js])
        both = np.add.reduceat(mark[ids[part]].astype(np.int64), np.cumsum(n[js]) - n[js])
        mark[ids[at[i]:at[i] + n[i]]] = False
        for j in js[den * both >= num * (n[i] + n[js] - both)].tolist():
            if group[j] != group[i]:
                links.append((i, j))
                group[group == group[j]] = group[i]
    return links


def _verify(threshold):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(t: pa.Table):
            nodes, left_side = t.column("node").to_pylist(), t.column("side").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
            sig = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in t.column("sig")])
            every = np.arange(len(sets))
            if left_side[0] < 0:  # a unit by itself: all pairs
                links = connect(sig, sets, every, every, threshold)
            else:
                links = connect(sig, sets, every[left_side == 0], every[left_side == 1], threshold)
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in links], pa.binary()),
                                               pa.array([nodes[j] for _, j in links], pa.binary())], names=["a", "b"])

        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            u, p, q = (t.column(c).to_numpy() for c in ("unit", "i", "j"))
            cut = np.flatnonzero((u[1:] != u[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
            edges = [0, *cut.tolist()]
            for s, e in zip(edges[:-1], edges[1:]):
                if e - s > 1:
                    yield flush(t.slice(s, e - s))
            rest = t.slice(edges[-1])
        if rest is not None and len(rest) > 1:
            yield flush(rest)
    return scan


def _in_buckets(nodes: DataFrame, member: DataFrame) -> DataFrame:
    """Places of nodes of large units: their buckets, or the block pairs of a
    bucket too large for one task (side 0 against side 1; -1: by itself)."""
    parts = F.ceil(F.greatest(F.col("size") / UNIT, F.col("weight") / WEIGHT)).cast("int")
    spread = nodes.join(member, "node").select("node", "key", parts.alias("k")) \
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    one = spread.filter("k = 1").select("node", F.col("key").alias("unit"),
                                        *[F.lit(-1).alias(c) for c in ("i", "j", "side")])
    many = spread.filter("k > 1").select("node", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    return one.unionByName(many.select(
        "node", F.col("key").alias("unit"), F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"),
        F.when(F.col("mine") == F.col("o"), -1).when(F.col("mine") < F.col("o"), 0).otherwise(1).alias("side")))


def near_duplicates(docs: DataFrame, threshold=THRESHOLD, shingle: int = SHINGLE, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (lowest id reachable), kept."""
    base = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")) \
        .select("__id", F.xxhash64("__text").alias("__th"), "__text")
    id_type = base.schema["__id"].dataType
    signed = written(base.mapInArrow(_signatures(shingle), T.StructType(
        [T.StructField("__id", id_type), T.StructField("__th", T.LongType()), T.StructField("n", T.LongType()),
         T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
         T.StructField("sig", T.BinaryType())])), "signatures")
    nodes = written(signed.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("__id").alias("low"), F.min(F.struct("__id", "__th")).alias("rep"), F.any_value("bands").alias("bands"),
        F.any_value("sig").alias("sig"), F.max("n").alias("n")), "nodes")
    ids = written(signed.select("__id", "n", "node"), "ids")
    drop_written(signed)
    bands = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = written(bands.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("weight"),
                                              F.min("node").alias("hub")).filter("size > 1"), "buckets")
    member = written(bands.drop("n").join(shared, "key"), "members")
    units = written(components(member.select(F.col("node").alias("a"), F.col("hub").alias("b")))
                    .withColumnRenamed("component", "unit"), "units")
    large = written(units.join(nodes.select("node", "n"), "node").groupBy("unit")
                    .agg(F.count("*").alias("m"), F.sum("n").alias("weight"))
                    .filter((F.col("m") > UNIT) | (F.col("weight") > WEIGHT)).select("unit"), "large-units")
    # nodes of large units meet in their buckets, all others in their unit
    whole = [F.lit(-1).alias(c) for c in ("i", "j", "side")]
    places = units.select("node", F.xxhash64("unit").alias("unit"), *whole)
    if not large.isEmpty():
        places = units.join(large, "unit", "left_anti").select("node", F.xxhash64("unit").alias("unit"), *whole) \
            .unionByName(_in_buckets(units.join(large, "unit", "left_semi").select("node"), member))
    wanted = nodes.join(units, "node", "left_semi").select(F.col("rep.__id").alias("__i"), F.col("rep.__th").alias("__t"),
                                                           "node", "sig")
    # the texts of nodes in units, once each; written, so that the shuffle of all texts is over before the next
    found = written(base.join(wanted, base["__id"].eqNullSafe(F.col("__i")) & (base["__th"] == F.col("__t")))
                    .select("node", "__text", "sig").dropDuplicates(["node"]), "unit-texts")
    sets = found.mapInArrow(_sets(shingle), T.StructType(
        [T.StructField("node", T.BinaryType()), T.StructField("sig", T.BinaryType()),
         T.StructField("shingles", T.BinaryType())]))
    tasks = sets.join(places, "node").repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j", "side", "node")
    links = written(tasks.select("unit", "i", "j", "side", "node", "sig", "shingles").mapInArrow(
        _verify(threshold), "a binary, b binary"), "links")
    drop_written(found)
    # an id with several rows: its nodes are linked, and all its rows get one component
    several = written(ids.filter("__id IS NOT NULL").groupBy("__id").agg(F.count("*").alias("k"), F.min("node").alias("hub"))
                      .filter("k > 1").select(F.col("__id").alias("__several"), "hub"), "several-ids")
    repeated = not several.isEmpty()
    if repeated:
        links = links.unionByName(ids.join(several, F.col("__id") == F.col("__several")).filter("node <> hub")
                                  .select(F.col("node").alias("a"), F.col("hub").alias("b")))
    joined = components(links)
    group = written(nodes.select("node", "low").join(joined, "node", "left")
                    .select("node", "low", F.coalesce("component", "node").alias("component")), "grouped")
    lows = written(group.groupBy("component").agg(F.min("low").alias("component_id")), "lowest")
    classes = written(group.join(lows, "component").select("node", "component_id"), "classes")
    drop_written(group)
    out = ids.join(classes, "node", "left").withColumn(
        "own", F.when(F.col("node").isNull(), F.col("__id")).otherwise(F.col("component_id")))
    if repeated:
        of_id = several.filter("hub IS NOT NULL").join(classes, F.col("hub") == F.col("node")) \
            .select("__several", F.col("component_id").alias("of_id"))
        out = out.join(of_id, F.col("__id") == F.col("__several"), "left").withColumn("own", F.coalesce("of_id", "own"))
    return out.select(F.col("__id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("own").alias("component_id"),
                      F.col("__id").eqNullSafe(F.col("own")).alias("kept"))
