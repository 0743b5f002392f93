"""Q2 on documents: first holders over several batches, replay, forgetting, odd rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from tessera.operators import exact
from tessera.sources.tables import table
from tessera.streaming import incremental

SCHEMA = incremental.DOC_SCHEMA


def put(spark, batches):
    """One file a batch, in the order of their names and times."""
    import time

    folder = tempfile.mkdtemp(prefix="tessera-stream-", dir="/tmp")
    for k, rows in enumerate(batches):
        df = rows if not isinstance(rows, list) else spark.createDataFrame(
            [(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
        df.toPandas().to_parquet(f"{folder}/docs-{k:02d}.parquet")
        time.sleep(0.05)
    return folder


def repeats(spark, out):
    return sorted(tuple(r) for r in incremental.stream_repeats(spark, out).select("doc_id", "first_id").collect())


def test_batches_equal_the_whole(spark, sf_check):
    docs = table(spark, sf_check, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    n = docs.count()
    folder = put(spark, [docs.filter(f"doc_id >= {k * n // 4} AND doc_id < {(k + 1) * n // 4}") for k in range(4)])
    out = incremental.stream_documents(spark, folder, "docs-*.parquet", max_files=1)
    members = exact.duplicate_members(docs, exact.digest_verbatim(F.col("text")))
    want = sorted((r.id, r.group_id) for r in members.filter("id <> group_id").collect())
    assert len(want) > 20
    assert repeats(spark, out) == want  # ids rise with the batches, so the first holder is the lowest id
    assert incremental.stream_repeats(spark, out).select("batch_id").distinct().count() == 4
    # the same batches once more, into the same folder: a replay changes nothing
    incremental.stream_documents(spark, folder, "docs-*.parquet", out=out, max_files=1)
    assert repeats(spark, out) == want


def test_order_of_arrival_and_forgetting(spark):
    batches = [[(9, "a b"), (7, "a  b"), (8, "c")], [(3, "a b /* x */"), (4, "d")], [(5, "c"), (1, "d"), (2, "a b")]]
    folder = put(spark, batches)
    out = incremental.stream_documents(spark, folder, "docs-*.parquet", max_files=1)
    assert repeats(spark, out) == [(1, 4), (2, 7), (3, 7), (5, 8), (9, 7)]
    short = incremental.stream_documents(spark, folder, "docs-*.parquet", max_files=1, keep_batches=1)
    assert repeats(spark, short) == [(1, 4), (3, 7), (9, 7)]  # 7 and 8 are forgotten in the third batch


def test_odd_rows(spark):
    folder = put(spark, [[(1, None), (2, None), (3, ""), (4, " "), (5, "x"), (5, "x"), (6, "x"), (6, "x")], [(7, None), (8, "y")]])
    out = incremental.stream_documents(spark, folder, "docs-*.parquet", max_files=1)
    assert repeats(spark, out) == [(4, 3), (6, 5)]


def test_table_of_part_files_and_no_file(spark, sf_small):
    folder = tempfile.mkdtemp(prefix="tessera-stream-", dir="/tmp")
    docs = table(spark, sf_small, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    docs.repartition(5).write.parquet(f"{folder}/documents.parquet")
    whole = repeats(spark, incremental.stream_documents(spark, sf_small, "documents.parquet"))
    assert repeats(spark, incremental.stream_documents(spark, folder, "documents.parquet")) == whole
    assert repeats(spark, incremental.stream_documents(spark, folder, "none.parquet")) == []
