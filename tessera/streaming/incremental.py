"""Incremental detection with Structured Streaming (Q1, Q2).

Q1 checks newly arriving documents against a static fingerprint index of
the originals (stream-static equi-join on hash). Fingerprints are selected
inside each document's arrays -- winnowing needs no row window, so it is
legal on a stream. Each micro-batch's pair coverage is written by
``foreachBatch`` into a folder named by the batch id, overwritten on retry,
so a replayed batch never duplicates rows (idempotent sink).

Q2 drops repeated events within an event-time watermark (``stream_dedup``)
and reports documents whose text an earlier one holds (``stream_documents``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..operators import exact
from ..operators import fingerprint as fpo
from ..sources.sinks import scratch_path

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _files(folder: str, file_glob: str) -> str:
    """The files of that name, or all files in folders of that name: a table is a
    file or a folder of part files. (In braces a plain name is a pattern too.)"""
    return f"{folder.rstrip('/')}/{{{file_glob}}}"


def stream_check(spark: SparkSession, folder: str, file_glob: str, index: DataFrame, k: int = 5, w: int = 4,
                 hash_fn: str = "md5", out: str | None = None, checkpoint: str | None = None,
                 max_files: int = 1) -> str:
    """Q1: score every new document against the originals' index.

    ``index`` = doc_hashes of the originals (hash, doc_id, n_pos, n_fp).
    Writes (item_id, doc_id, shared, covered_orig, total_orig, covered_sub,
    total_sub, batch_id) under ``out``; returns the output folder. Runs with
    the availableNow trigger (all data present now, then stop).
    """
    out = out or scratch_path(spark, "stream-check")
    checkpoint = checkpoint or scratch_path(spark, "stream-check-ckpt")
    src = spark.readStream.schema(DOC_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(_files(folder, file_glob))
    docs = src.select("doc_id", word_tokens("text").alias("tokens"))
    fp = fpo.fingerprints(docs, k=k, w=w, hash_fn=hash_fn)
    sub = fp.select("doc_id", "n_fp", F.inline_outer("fp")).filter(F.col("pos").isNotNull())
    idx = index.select("hash", F.col("doc_id").alias("item_id"), F.col("n_pos").alias("n_a"), F.col("n_fp").alias("t_a"))
    joined = sub.join(idx, "hash")  # stream-static equi-join

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        per_doc_hash = batch.groupBy("item_id", "doc_id", "hash").agg(
            F.count(F.lit(1)).alias("n_b"), F.max("n_a").alias("n_a"), F.max("t_a").alias("t_a"),
            F.max("n_fp").alias("t_b"))
        pairs = per_doc_hash.groupBy("item_id", "doc_id").agg(
            F.count(F.lit(1)).alias("shared"), F.sum("n_a").alias("covered_orig"), F.max("t_a").alias("total_orig"),
            F.sum("n_b").alias("covered_sub"), F.max("t_b").alias("total_sub"))
        # the folder name carries batch_id (partition discovery on read)
        pairs.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (joined.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def stream_dedup(spark: SparkSession, folder: str, file_glob: str, key_cols: list[str], ts_col: str = "ts",
                 watermark: str = "1 hour", out: str | None = None, checkpoint: str | None = None) -> str:
    """Q2: drop events whose normalised key was already seen within the
    watermark (state is bounded by the watermark). Returns the output folder."""
    out = out or scratch_path(spark, "stream-dedup")
    checkpoint = checkpoint or scratch_path(spark, "stream-dedup-ckpt")
    src = spark.readStream.schema(EVENT_SCHEMA).parquet(_files(folder, file_glob))
    norm = F.sha2(F.concat_ws("\x1f", *[F.lower(F.trim(F.col(c).cast("string"))) for c in key_cols]), 256)
    d = src.withColumn("dedup_key", norm).withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark(["dedup_key"])
    q = (d.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def stream_documents(spark: SparkSession, folder: str, file_glob: str, out: str | None = None,
                     checkpoint: str | None = None, max_files: int | None = None, keep_batches: int | None = None) -> str:
    """Q2 on documents: the first holder of every text (D2 digest: modulo comments and white space).

    Each micro-batch writes two folders named by its id: ``out/holders`` gets the
    digests not seen before with their first holder (the lowest doc_id of the
    batch), ``out/repeats`` one row (doc_id, first_id) for each other document. A
    batch reads only holders of *earlier* batches and overwrites its own folders,
    so a replayed batch writes the same rows again. With ``keep_batches`` a
    holder is forgotten that many batches later, which bounds the state.

    A digest that a third of all documents share is one partial row a task in the
    aggregation; the join back to the documents moves (doc_id, digest) alone, which
    AQE may split. Null texts are in no group; rows that repeat a doc_id count as
    one document. Returns ``out``; read the result with ``stream_repeats``.
    """
    out = out or scratch_path(spark, "stream-documents")
    checkpoint = checkpoint or scratch_path(spark, "stream-documents-ckpt")
    # a stream without a file has no batch, but a result
    spark.createDataFrame([], "doc_id long, first_id long").write.mode("overwrite").parquet(f"{out}/repeats/batch_id=-1")
    src = spark.readStream.schema(DOC_SCHEMA)
    if max_files is not None:
        src = src.option("maxFilesPerTrigger", max_files)
    docs = src.parquet(_files(folder, file_glob)).filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", exact.digest_verbatim(F.col("text")).alias("digest"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        digests = f"{out}/digests/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(digests)  # texts are read and hashed once a batch
        batch = session.read.parquet(digests)
        mine = batch.groupBy("digest").agg(F.min("doc_id").alias("own_id"))
        oldest = 0 if keep_batches is None else max(0, batch_id - keep_batches)
        earlier = [f"{out}/holders/batch_id={k}" for k in range(oldest, batch_id)]
        if earlier:
            known = session.read.schema("digest string, first_id long").parquet(*earlier)
            known = known.groupBy("digest").agg(F.min("first_id").alias("first_id"))
            first = mine.join(known, "digest", "left")
        else:
            first = mine.withColumn("first_id", F.lit(None).cast("long"))
        found = f"{out}/found/batch_id={batch_id}"
        first.write.mode("overwrite").parquet(found)
        first = session.read.parquet(found)
        first.filter("first_id IS NULL").select("digest", F.col("own_id").alias("first_id")).write.mode("overwrite").parquet(
            f"{out}/holders/batch_id={batch_id}")
        held = first.select("digest", F.coalesce("first_id", "own_id").alias("first_id"))
        batch.join(held, "digest").filter("doc_id <> first_id").select("doc_id", "first_id").distinct().write.mode(
            "overwrite").parquet(f"{out}/repeats/batch_id={batch_id}")

    q = docs.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def stream_repeats(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, first_id, batch_id) of ``stream_documents``."""
    return spark.read.schema("doc_id long, first_id long, batch_id int").parquet(f"{out}/repeats")
