"""Operator 5, line dedup: winnowing over line hashes.

Units are the lines of a text that hold a word; blank lines are never units
and always stay. In every window of ``run`` consecutive units the line with
the smallest hash is selected, so a repeated run of at least ``run`` lines is
guaranteed to hold a selected fingerprint at the same place. Fingerprints that
occur once are dropped; the positions of the others are joined to the first
position of each of their windows, and matched windows that go on line by line
against the same earlier text extend each other both ways into maximal runs.
A line is deleted if it lies in a run that also starts earlier, in the order
of (id, text hash, line); the first place stays.

A line of at least ``long`` words needs no repeated neighbour: it is deleted by
itself wherever an equal line is at an earlier place. ``None`` leaves single
lines alone. Short stock lines that repeat between differing lines stay.

A frequent line makes no pairs: windows are aggregated to their first place
(with map-side combine) and joined back on the window hash, a join whose large
side can be split. Only narrow rows are shuffled; texts move once, at the end.

Defined results: null and empty texts have no lines and stay as they are (null
becomes empty); rows that repeat both id and text are the same place and are
judged alike; a text whose lines all repeat becomes empty but its row stays;
an empty table gives an empty result. All input columns pass; those named like
an added column are replaced.
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
from .common import drop_written, guarded, written

RUN = 2  # lines of the shortest run that is deleted
LONG = 50  # words of the shortest line that is deleted by itself
ALONE = 1 << 30  # added to the position of a line that is judged by itself; a text has fewer lines


def lines_of(buf: np.ndarray, offs: np.ndarray):
    """(starts, ends without the break, has a word, first line of each text)."""
    breaks = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    # a break that ends a text starts the empty last line of that text, before the next text's first line
    first = np.arange(len(offs)) + np.searchsorted(breaks, offs)
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = offs[1:]
    word = np.concatenate([[0], np.cumsum(~vec.SPACES[buf])])
    return starts, ends, word[ends] > word[starts], first


def _long_lines(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, long: int):
    """Indices of the lines of at least ``long`` words, and a 128-bit digest of each as two numbers."""
    space = vec.SPACES[buf]
    begins = ~space
    begins[1:] &= space[:-1]
    begins[starts] = ~space[starts]  # the first line of a text may follow a word of the text before
    count = np.concatenate([[0], np.cumsum(begins)])
    at = np.flatnonzero(count[ends] - count[starts] >= long)
    digest = [hashlib.blake2b(buf[starts[x]:ends[x]], digest_size=16).digest() for x in at.tolist()]
    return at, np.frombuffer(b"".join(digest), np.int64)


def _fingerprints(run: int, long: int | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, buf, offs in vec.text_arrays(b.column(2)):
                starts, ends, has, first = lines_of(buf, offs)
                if not len(buf) or not has.any():
                    continue
                starts, ends = starts[has], ends[has]
                first = np.concatenate([[0], np.cumsum(has)])[first]
                if long is not None:
                    at, digest = _long_lines(buf, starts, ends, long)
                    doc = np.searchsorted(first, at, side="right") - 1
                    rows = pa.array(lo + doc)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(rows), b.column(1).take(rows),
                         pa.array((at - first[doc] + ALONE).astype(np.int32)), pa.nulls(len(at), pa.int64()),
                         pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(at) + 1, 2, dtype=np.int32)),
                                                  pa.array(digest))],
                        names=["__id", "__th", "s0", "fp", "ctx"])
                h = vec.Rolling(vec.BYTE_CODE[buf]).runs(starts, ends)
                counts = np.maximum(np.diff(first) - run + 1, 0)
                if not counts.sum():
                    continue
                win = vec.ranges(first[:-1], counts)
                doc = np.repeat(np.arange(len(counts)), counts)
                span = h[win[:, None] + np.arange(run)]
                at = win + np.argmin(span, axis=1)
                head = np.ones(len(at), bool)
                head[1:] = at[1:] != at[:-1]
                k = np.flatnonzero(head)
                n = np.diff(np.append(k, len(at)))
                size = n + run - 1
                ctx = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
                    pa.array(h[vec.ranges(win[k], size)].view(np.int64)))
                rows = pa.array(lo + doc[k])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows),
                     pa.array((win[k] - first[doc[k]]).astype(np.int32)), pa.array(h[at[k]].view(np.int64)), ctx],
                    names=["__id", "__th", "s0", "fp", "ctx"])
    return scan


def _delete(text_at: int, n_cols: int, run: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(n_cols)
            at, starts_of = lists.offsets.to_numpy(), lists.values.to_numpy()
            text, n_lines, n_gone, digest = [], [], [], []
            for lo, buf, offs in vec.text_arrays(b.column(text_at)):
                starts, ends, has, first = lines_of(buf, offs)
                unit = np.concatenate([[0], np.cumsum(has)])[first]
                k = len(offs) - 1
                pick = np.arange(at[lo], at[lo + k])
                owner = np.repeat(np.arange(k), np.diff(at[lo:lo + k + 1]))
                alone = starts_of[pick] >= ALONE
                line = unit[owner] + starts_of[pick] - alone * ALONE
                lost = vec.covered(line[~alone], run, int(unit[-1]))
                lost[line[alone]] = True
                gone = np.zeros(len(starts), bool)
                gone[has] = lost
                total = np.concatenate([[0], np.cumsum(gone)])[first]
                n_lines.append(np.diff(unit))
                n_gone.append(np.diff(total))
                for d in range(k):
                    if total[d + 1] == total[d]:
                        text.append(buf[offs[d]:offs[d + 1]].tobytes())
                    else:
                        ls = np.flatnonzero(~gone[first[d]:first[d + 1]]) + first[d]
                        text.append(b"\n".join(buf[starts[x]:ends[x]].tobytes() for x in ls.tolist()))
                    digest.append(hashlib.sha256(text[-1]).hexdigest())
            cat = (lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
            cols = [b.column(i) for i in range(n_cols)]
            cols[text_at] = pa.array(text, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(cat(n_lines)), pa.array(cat(n_gone)), pa.array(digest, pa.string())],
                names=[*b.schema.names[:n_cols], "n_lines", "n_removed", "kept_sha256"])
    return scan


def line_dedup(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text",
               long: int | None = LONG) -> DataFrame:
    """``docs`` with shortened texts, plus n_lines (with a word), n_removed, kept_sha256."""
    made = {"n_lines", "n_removed", "kept_sha256"} - {id_col, text_col}
    own, names = guarded(docs.select(*[c for c in docs.columns if c not in made]))
    text_at = names.index(text_col)
    text = f"c{text_at}"
    own = own.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))
    keyed = own.select(F.col(f"c{names.index(id_col)}").alias("__id"), F.xxhash64(text).alias("__th"),
                       F.col(text).alias("__text"))
    key = [T.StructField("__id", keyed.schema["__id"].dataType), T.StructField("__th", T.LongType())]
    prints = written(keyed.mapInArrow(_fingerprints(run, long), T.StructType(
        [*key, T.StructField("s0", T.IntegerType()), T.StructField("fp", T.LongType()),
         T.StructField("ctx", T.ArrayType(T.LongType()))])), "fingerprints")
    # written down, as the first places below: joins on plain tables can be split where a key is hot
    several = written(prints.filter("fp IS NOT NULL").groupBy("fp")
                      .agg(F.count("*").alias("n"), F.max(F.size("ctx")).alias("m"))
                      .filter((F.col("n") > 1) | (F.col("m") > run)).select("fp"), "several")
    # windows around each surviving fingerprint, to both sides
    around = prints.join(several, "fp", "left_semi").select(
        "__id", "__th", "s0", "ctx", F.explode(F.sequence(F.lit(0), F.size("ctx") - run)).alias("o"))
    window = F.slice("ctx", F.col("o") + 1, F.lit(run))
    around = around.select("__id", "__th", (F.col("s0") + F.col("o")).alias("s"), F.xxhash64(window).alias("w1"),
                           F.xxhash64(F.lit(run), F.reverse(window)).alias("w2"))
    if long is not None:
        around = around.unionByName(prints.filter("fp IS NULL").select(
            "__id", "__th", F.col("s0").alias("s"), F.col("ctx")[0].alias("w1"), F.col("ctx")[1].alias("w2")))
    places = written(around, "line-windows")
    drop_written(prints)
    ref = F.struct("__id", "__th", "s")
    firsts = written(places.groupBy("w1", "w2").agg(F.min(ref).alias("first"), F.count("*").alias("n"))
                     .filter("n > 1").select("w1", "w2", "first"), "firsts")
    later = places.join(firsts, ["w1", "w2"]).filter(ref != F.col("first"))
    lists = later.groupBy("__id", "__th").agg(F.collect_set("s").alias("__later")) \
        .select(F.col("__id").alias("__i"), F.col("__th").alias("__t"), "__later")
    joined = own.join(lists, own[f"c{names.index(id_col)}"].eqNullSafe(F.col("__i"))
                      & (F.xxhash64(own[text]) == F.col("__t")), "left") \
        .select(*own.columns, F.coalesce("__later", F.array().cast("array<int>")).alias("__later"))
    lg = T.LongType()
    out = joined.mapInArrow(_delete(text_at, len(names), run), T.StructType(
        [*[T.StructField(f.name, f.dataType) for f in own.schema.fields], T.StructField("n_lines", lg),
         T.StructField("n_removed", lg), T.StructField("kept_sha256", T.StringType())]))
    return out.toDF(*names, "n_lines", "n_removed", "kept_sha256")
