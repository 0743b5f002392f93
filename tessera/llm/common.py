"""Shared helpers: tables, written intermediate tables, distributed running sums."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

# Word separators of every contract here: space and \t \n \v \f \r.
WORD_RE = r"[^\x20\x09-\x0D]+"
GAP_RE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder of ``spark.checkpoint.dir``
    and read it back: lineage is cut, and the files outlive lost executors.

    The shuffle files of the write are dropped once it has ended (the written
    table replaces them), so a job's disk is its largest step, not their sum.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing will read again."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def running_sum(df: DataFrame, group: str, order: list, value: str, out: str, name: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group`` in the order of ``order``.

    No group is gathered in one task: rows are range-partitioned by (group,
    order), so a group with a third of all rows is cut into contiguous
    chunks. Chunk totals (one row per partition and group) give the offsets,
    and the running sum inside a chunk starts from its offset.
    ``order`` should break ties, else tied rows share one chunk.
    """
    chunked = written(df.repartitionByRange(F.col(group).asc_nulls_last(), *order)
                      .withColumn("__chunk", F.spark_partition_id()), name)
    totals = chunked.groupBy(group, "__chunk").agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(group).alias("__g"), F.col("__chunk").alias("__c"),
                            F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(group, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    part = chunked.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (part.join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__chunk") == F.col("__c")))
            .withColumn(out, F.col("__offset") + F.col("__inside"))
            .drop("__chunk", "__c", "__g", "__offset", "__inside"))


def guarded(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns renamed to c0, c1, ...: any input names may then meet
    helper columns. ``df.toDF(*names)`` gives the names back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns
