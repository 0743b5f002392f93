"""Repeated windows across all texts: the shared machinery of operators 2 and 9.

A window is ``length`` consecutive units (words or bytes) of one text. Every
window is decided exactly against all other windows, without shuffling them:

1. *Anchors.* Inside a window the q-gram with the smallest hash is its anchor
   value. Equal windows have equal anchor values, so only windows with a
   repeated anchor value can be repeated. Consecutive windows with the same
   anchor value form a segment; one narrow row per segment (about two for
   each window length of text) leaves the scan. ``inner`` marks a segment in
   which the value has several places (periodic text): its windows can equal
   each other.
2. *Survivors.* Anchor values are counted with map-side combine; segments
   whose value occurs once, at one place, are done.
3. *Whole copies.* Among survivors, segments with the same content hash are
   aggregated before anything else: all windows of such a segment are
   repeated. This is what exact copies cost, however many there are.
4. *Frontier.* One representative of each distinct segment, where a value has
   several, is cut from its text and sent to the shard of its value, where the
   caller's resolver (doubling levels, or a suffix array) compares windows.
   A value with more than ``SHARD`` distinct segments is salted over several
   shards. Each shard then also reports its distinct windows, ``CORE``
   neighbours in one row under the hash of the text that they share; rows
   whose core is found once are done, and the windows of the others are
   compared across shards by 128-bit fingerprints. So no hot passage, source
   or group of copies meets in one task.

Texts are identified by (id, hash of the text): rows that repeat both are the
same text in several places, and all of their windows count as repeated.
Intermediate tables are written to the shared checkpoint folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .common import drop_written, written

HIGH = ~np.uint64((1 << 31) - 1)
SHARD = 1024            # distinct segments of one anchor value in a shard
BLOCK_BYTES = 1 << 17   # bytes of segment bodies that a resolver gets at once (whole groups)
CORE = 8                # windows with a common core in a salted group

WINDOWS = pa.list_(pa.struct([("o", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("weight", pa.int32())]))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __th, __text): the only columns the machinery reads."""
    return docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")) \
        .select("__id", F.xxhash64("__text").alias("__th"), "__text")


def _units(unit: str, buf: np.ndarray, offs: np.ndarray):
    """(codes, first unit of each text)."""
    if unit == "bytes":
        return vec.BYTE_CODE[buf], offs
    starts, ends, first = vec.words(buf, offs, vec.SPACES)
    return vec.Rolling(vec.BYTE_CODE[buf]).runs(starts, ends), first


def _anchors(unit: str, length: int, q: int) -> Callable:
    w = length - q + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ths = b.column(0), b.column(1)
            for lo, buf, offs in vec.text_arrays(b.column(2)):
                codes, first = _units(unit, buf, offs)
                counts = np.maximum(np.diff(first) - length + 1, 0)
                if not counts.sum():
                    continue
                roll = vec.Rolling(codes)
                grams = roll.grams(q)
                # order by the upper 33 bits, then the leftmost place
                low = vec.sliding_min((grams & HIGH) | np.arange(len(grams), dtype=np.uint64), w)
                win = vec.ranges(first[:-1], counts)
                doc = np.repeat(np.arange(len(counts)), counts)
                place = (low[win] & ~HIGH).astype(np.int64)
                val = grams[place]
                head = np.ones(len(win), bool)
                head[1:] = (val[1:] != val[:-1]) | (doc[1:] != doc[:-1])
                run_at = np.flatnonzero(head)
                run_n = np.diff(np.append(run_at, len(win)))
                pieces = -(-run_n // w)  # a run longer than w (periodic text) is cut
                step = vec.ranges(np.zeros(len(pieces), np.int64), pieces) * w
                at = np.repeat(run_at, pieces) + step
                n = np.minimum(w, np.repeat(run_n, pieces) - step)
                s = win[at]
                rows = pa.array(lo + doc[at])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), ths.take(rows), pa.array((s - first[doc[at]]).astype(np.int32)),
                     pa.array(n.astype(np.int32)), pa.array(val[at].view(np.int64)),
                     pa.array(roll.runs(s, s + n - 1 + length).view(np.int64)),
                     pa.array(place[at] != place[at + n - 1])],
                    names=["__id", "__th", "s0", "n", "ah", "sh", "inner"])
    return run


def _bodies(unit: str, length: int) -> Callable:
    """Cut the listed segments out of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ths = b.column(0), b.column(1)
            segs = b.column(3)
            at, st = segs.offsets.to_numpy(), segs.values
            s0, n = (st.field(k).to_numpy() for k in ("s0", "n"))
            for lo, buf, offs in vec.text_arrays(b.column(2)):
                codes, first = _units(unit, buf, offs)
                data = buf if unit == "bytes" else codes.view(np.uint8)
                width = 1 if unit == "bytes" else 8
                hi = lo + len(offs) - 1
                pick = np.arange(at[lo], at[hi])
                if not len(pick):
                    continue
                doc = np.repeat(np.arange(hi - lo), np.diff(at[lo:hi + 1]))
                start = (first[doc] + s0[pick]) * width
                size = (n[pick] + length - 1) * width
                body = pa.Array.from_buffers(
                    pa.binary(), len(pick),
                    [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
                     pa.py_buffer(data[vec.ranges(start, size)])])
                part = st.take(pa.array(pick))
                rows = pa.array(lo + doc)
                yield pa.RecordBatch.from_arrays(
                    [part.field("ah"), part.field("salt"), part.field("c"), ids.take(rows), ths.take(rows),
                     part.field("s0"), part.field("n"), body],
                    names=["ah", "salt", "c", "__id", "__th", "s0", "n", "body"])
    return run


class Block:
    """Segments of whole groups, ready for a resolver.

    ``data`` holds all bodies; window starts of segment k are
    ``ranges(begin[k], n[k])``; ``group`` numbers the (value, salt) groups;
    ``many`` marks segments that stand for several equal ones.
    """

    def __init__(self, unit: str, t: pa.Table):
        body = t.column("body").combine_chunks()
        offs = np.frombuffer(body.buffers()[1], np.int32)[body.offset:body.offset + len(body) + 1].astype(np.int64)
        raw = np.frombuffer(body.buffers()[2], np.uint8)[offs[0]:offs[-1]]
        width = 1 if unit == "bytes" else 8
        self.data = raw if unit == "bytes" else raw.view(np.uint64)
        self.begin = (offs[:-1] - offs[0]) // width
        self.n = t.column("n").to_numpy().astype(np.int64)
        self.ah = t.column("ah").to_numpy().view(np.uint64)
        self.many = t.column("c").to_numpy() > 1
        self.salted = t.column("salt").to_numpy() >= 0
        head = np.zeros(len(t), np.int64)
        head[_group_starts(t)] = 1
        self.group = np.cumsum(head)
        self.starts = vec.ranges(self.begin, self.n)
        self.seg = np.repeat(np.arange(len(self.n)), self.n)

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Anchor of each window: the first place in it that has the group's value."""
        size = np.diff(np.append(self.begin, len(self.data)))
        found = np.flatnonzero(grams == np.repeat(self.ah, size)[:len(grams)])
        return found[np.searchsorted(found, self.starts)]


def _resolve(unit: str, length: int, q: int, resolver: Callable, first_only: bool) -> Callable:
    """Run the resolver over blocks of whole groups.

    The resolver returns a class number for each window of the block (equal
    windows of one group have equal classes; windows in block order, which is
    the order of ids and positions).
    """
    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        blk = Block(unit, t)
        cls = resolver(blk, length)
        if blk.salted.any():  # the shards of a value stay apart, so that a class leads with its first place
            cls = cls + (cls.max() + 1) * blk.group[blk.seg]
        order = np.argsort(cls, kind="stable")
        c = cls[order]
        head = np.ones(len(c), bool)
        head[1:] = c[1:] != c[:-1]
        group = np.cumsum(head) - 1
        weight = np.bincount(group, weights=1 + blk.many[blk.seg[order]])
        lead = np.zeros(len(c), bool)
        lead[order] = head
        total = np.empty(len(c), np.int64)
        total[order] = weight[group]
        hit = ~lead if first_only else (total > 1) & ~blk.many[blk.seg]
        rows, start, count = _runs(blk, hit)
        ids, ths, s0 = (t.column(k) for k in ("__id", "__th", "s0"))
        pos = s0.to_numpy().astype(np.int64)

        def batch(seg, start, count, core, windows):
            r = pa.array(seg)
            return pa.RecordBatch.from_arrays(
                [ids.take(r).combine_chunks(), ths.take(r).combine_chunks(),
                 pa.array((pos[seg] + start).astype(np.int32)), pa.array(count.astype(np.int32)), core, windows],
                names=["__id", "__th", "s0", "n", "core", "windows"])

        yield batch(rows, start, count, pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), WINDOWS))
        cross = np.flatnonzero(lead & blk.salted[blk.seg])
        if len(cross):  # the distinct windows of a salted group, CORE neighbours in a row
            codes = vec.BYTE_CODE[blk.data] if unit == "bytes" else blk.data
            one, two = vec.Rolling(codes, 0), vec.Rolling(codes, 1)
            s, seg, place = blk.starts[cross], blk.seg[cross], blk.places(one.grams(q))[cross]
            part = (place - s) // CORE
            new = np.ones(len(s), bool)
            new[1:] = (seg[1:] != seg[:-1]) | (place[1:] != place[:-1]) | (part[1:] != part[:-1])
            k = np.flatnonzero(new)
            core = one.runs((place - part * CORE)[k], (place - part * CORE - CORE + 1)[k] + length)
            windows = pa.ListArray.from_arrays(
                pa.array(np.append(k, len(s)).astype(np.int32)),
                pa.StructArray.from_arrays(
                    [pa.array((s - blk.begin[seg]).astype(np.int32)), pa.array(one.runs(s, s + length).view(np.int64)),
                     pa.array(two.runs(s, s + length).view(np.int64)),
                     pa.array(np.minimum(total[cross], 2).astype(np.int32))], names=["o", "h1", "h2", "weight"]))
            yield batch(seg[k], np.zeros(len(k), np.int64), np.zeros(len(k)), pa.array(core.view(np.int64)), windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if rest is not None:
                t = pa.concat_tables([rest, t])
            cuts = _group_starts(t)
            filled = np.cumsum(pc.binary_length(t.column("body")).to_numpy().astype(np.int64))
            done = 0
            for k in range(1, len(cuts)):  # the last group may go on in the next batch
                if filled[cuts[k] - 1] - (filled[done - 1] if done else 0) >= BLOCK_BYTES:
                    yield from emit(t.slice(done, cuts[k] - done))
                    done = cuts[k]
            rest = t.slice(done).combine_chunks()
        if rest is not None and len(rest):
            yield from emit(rest)
    return run


def _group_starts(t: pa.Table) -> np.ndarray:
    ah, salt = t.column("ah").to_numpy(), t.column("salt").to_numpy()
    new = np.ones(len(ah), bool)
    new[1:] = (ah[1:] != ah[:-1]) | (salt[1:] != salt[:-1])
    return np.flatnonzero(new)


def _runs(blk: Block, hit: np.ndarray):
    """Consecutive flagged windows of a segment as (segment, first offset, count)."""
    at = np.flatnonzero(hit)
    seg, off = blk.seg[at], blk.starts[at] - blk.begin[blk.seg[at]]
    new = np.ones(len(at), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (off[1:] != off[:-1] + 1)
    k = np.flatnonzero(new)
    return seg[k], off[k], np.diff(np.append(k, len(at)))


def repeated_windows(docs: DataFrame, unit: str, length: int, q: int, resolver: Callable, keep: str = "none",
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (__id, __th, s0, n): windows starting at units s0 .. s0+n-1 of that
    text also start somewhere else (keep="none"), or earlier in the order of
    (id, text hash, position) (keep="first")."""
    base = keyed(docs, id_col, text_col)
    id_type = base.schema["__id"].dataType
    key = [T.StructField("__id", id_type), T.StructField("__th", T.LongType())]
    i, lg = T.IntegerType(), T.LongType()
    span = [T.StructField("s0", i), T.StructField("n", i)]
    ref = F.struct("__id", "__th", "s0")

    anchors = written(base.mapInArrow(_anchors(unit, length, q), T.StructType(
        [*key, *span, T.StructField("ah", lg), T.StructField("sh", lg), T.StructField("inner", T.BooleanType())])), "anchors")
    values = written(anchors.groupBy("ah").agg(F.count("*").alias("tot"), F.min("sh").alias("lo"),
                                               F.max("sh").alias("hi"), F.max("inner").alias("inner"))
                     .filter("tot >= 2 OR inner").selectExpr("ah", "lo <> hi OR inner AS mixed"), "values")
    surviving = written(anchors.drop("inner").join(values, "ah"), "surviving")
    drop_written(anchors)

    mixed = surviving.filter("mixed")
    distinct = written(mixed.groupBy("ah", "sh").agg(F.count("*").alias("c"), F.min(F.struct("__id", "__th", "s0", "n"))
                                                     .alias("rep")), "segments")
    hot = distinct.groupBy("ah").agg(F.count("*").alias("nd")).filter(F.col("nd") > SHARD)
    salt = F.when(F.col("nd").isNull(), F.lit(-1).cast("long")).otherwise(
        F.pmod(F.xxhash64("sh"), F.ceil(F.col("nd") / SHARD)))
    frontier = distinct.join(hot, "ah", "left").select(
        "rep.__id", "rep.__th", F.struct("ah", salt.cast("int").alias("salt"), F.least(F.col("c"), F.lit(2)).cast("int")
                                         .alias("c"), "rep.s0", "rep.n").alias("seg"))
    lists = frontier.groupBy("__id", "__th").agg(F.collect_set("seg").alias("segs")) \
        .select(F.col("__id").alias("__i"), F.col("__th").alias("__t"), "segs")
    cut = base.join(lists, base["__id"].eqNullSafe(F.col("__i")) & (base["__th"] == F.col("__t"))) \
        .select("__id", "__th", "__text", "segs")
    bodies = cut.mapInArrow(_bodies(unit, length), T.StructType(
        [T.StructField("ah", lg), T.StructField("salt", i), T.StructField("c", i), *key, *span,
         T.StructField("body", T.BinaryType())]))
    shards = bodies.repartition("ah", "salt").sortWithinPartitions("ah", "salt", "__id", "__th", "s0")
    first_only = keep == "first"
    found = written(shards.mapInArrow(_resolve(unit, length, q, resolver, first_only), T.StructType(
        [*key, *span, T.StructField("core", lg), T.StructField("windows", T.ArrayType(T.StructType(
            [T.StructField("o", i), T.StructField("h1", lg), T.StructField("h2", lg), T.StructField("weight", i)])))])),
        "resolved")

    local = found.filter("core IS NULL").select("__id", "__th", "s0", "n")
    shared = found.filter("core IS NOT NULL")
    cores = written(shared.groupBy("core").agg(F.count("*").alias("k")).filter("k > 1").select("core"), "cores")
    fingerprints = shared.join(cores, "core", "left_semi").select("__id", "__th", "s0", F.explode("windows").alias("w")) \
        .select("__id", "__th", (F.col("s0") + F.col("w.o")).alias("s0"), F.lit(1).alias("n"), "w.h1", "w.h2", "w.weight")
    classes = written(fingerprints.groupBy("h1", "h2").agg(F.sum("weight").alias("all"), F.min(ref).alias("first"))
                      .filter(F.col("all") > 1), "classes")
    across = fingerprints.join(classes, ["h1", "h2"])
    across = across.filter(ref != F.col("first")) if first_only else across.filter("weight = 1")
    whole = surviving.filter("NOT mixed")
    if first_only:
        leads = written(whole.groupBy("ah").agg(F.min(ref).alias("first")), "leads")
        whole = whole.join(leads, "ah").filter(ref != F.col("first"))
        copies = mixed.join(distinct.filter("c > 1").select("ah", "sh", F.struct("rep.__id", "rep.__th", "rep.s0")
                                                            .alias("first")), ["ah", "sh"]).filter(ref != F.col("first"))
    else:
        copies = mixed.join(distinct.filter("c > 1").select("ah", "sh"), ["ah", "sh"], "left_semi")
    cols = ["__id", "__th", "s0", "n"]
    return local.unionByName(across.select(cols)).unionByName(whole.select(cols)).unionByName(copies.select(cols))


def _apply(unit: str, length: int, with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            at, st = lists.offsets.to_numpy(), lists.values
            s0, n = (st.field(k).to_numpy().astype(np.int64) for k in ("s0", "n"))
            total, gone, spans, digest, text = [], [], [], [], []
            for lo, buf, offs in vec.text_arrays(b.column(1)):
                if unit == "words":
                    ws, we, first = vec.words(buf, offs, vec.SPACES)
                else:
                    first = offs
                hi = lo + len(offs) - 1
                size = int(first[-1])
                edge = np.zeros(size + 1, np.int32)
                pick = np.arange(at[lo], at[hi])
                doc = np.repeat(np.arange(hi - lo), np.diff(at[lo:hi + 1]))
                np.add.at(edge, first[doc] + s0[pick], 1)
                np.add.at(edge, first[doc] + s0[pick] + n[pick] - 1 + length, -1)
                out = np.cumsum(edge)[:size] > 0
                cum = np.concatenate([[0], np.cumsum(out)])
                opens = out.copy()
                opens[1:] &= ~out[:-1]
                cuts = first[(first > 0) & (first < size)]
                opens[cuts] = out[cuts]
                runs = np.concatenate([[0], np.cumsum(opens)])
                total.append(np.diff(first))
                gone.append(cum[first[1:]] - cum[first[:-1]])
                spans.append(runs[first[1:]] - runs[first[:-1]])
                if unit == "words":
                    # kept words, each followed by one space
                    ks, ke = ws[~out], we[~out]
                    joined = np.full(int((ke - ks).sum()) + len(ks), 0x20, np.uint8)
                    ends = np.cumsum(ke - ks + 1)
                    mask = np.ones(len(joined), bool)
                    mask[ends - 1] = False
                    joined[mask] = buf[vec.ranges(ks, ke - ks)]
                    kept = np.concatenate([[0], np.cumsum(~out)])[first]
                    edges = np.concatenate([[0], ends])[kept]
                    stop = np.maximum(edges[1:] - 1, edges[:-1])
                else:
                    joined = buf[~out]
                    edges = np.concatenate([[0], np.cumsum(~out)])[first]
                    stop = edges[1:]
                for s, e in zip(edges[:-1].tolist(), stop.tolist()):
                    piece = joined[s:e].tobytes()
                    digest.append(hashlib.sha256(piece).hexdigest())
                    if with_text:
                        text.append(piece)
            cat = (lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
            cols = [b.column(0), pa.array(cat(total)), pa.array(cat(gone)), pa.array(cat(spans)),
                    pa.array(digest, pa.string())]
            names = ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols.append(pa.array(text, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def remove_windows(docs: DataFrame, windows: DataFrame, unit: str, length: int, with_text: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_units, n_removed, n_spans (maximal removed
    runs), kept_sha256 and, on request, ``kept`` (binary: a cut between bytes
    need not respect characters)."""
    base = keyed(docs, id_col, text_col)
    lists = windows.groupBy("__id", "__th").agg(F.collect_set(F.struct("s0", "n")).alias("spans")) \
        .select(F.col("__id").alias("__i"), F.col("__th").alias("__t"), "spans")
    joined = base.join(lists, base["__id"].eqNullSafe(F.col("__i")) & (base["__th"] == F.col("__t")), "left")
    lg = T.LongType()
    fields = [T.StructField("doc_id", base.schema["__id"].dataType), T.StructField("n_units", lg),
              T.StructField("n_removed", lg), T.StructField("n_spans", lg), T.StructField("kept_sha256", T.StringType())]
    if with_text:
        fields.append(T.StructField("kept", T.BinaryType()))
    none = F.array().cast("array<struct<s0:int,n:int>>")
    return joined.select("__id", "__text", F.coalesce("spans", none).alias("spans")).mapInArrow(_apply(unit, length, with_text), T.StructType(fields))
