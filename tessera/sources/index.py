"""Stored fingerprint index (E4, L3): written once, appended by batch, probed in place.

The index is a Parquet table bucketed and sorted by the fingerprint, in a
folder of its own. A batch is a partition: writing it again replaces it, so a
replayed append changes nothing, and a batch can be taken back. A probe joins
on the fingerprint: new documents are dealt over the index's buckets (or
broadcast, if AQE measures them as small), the index side is read bucket by
bucket without a shuffle, whatever its size.

The folder must be shared by driver and executors. The session's catalog knows
the table under a name derived from the folder only while the session lives;
``open_index`` registers it again from the files.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class FingerprintIndex:
    """Rows (hash, doc_id, n_pos, n_fp) of every batch; ``doc_id`` is a string key."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = "fingerprints_" + hashlib.md5(self.path.encode()).hexdigest()[:16]

    def _register(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")  # external: the files stay
        self.spark.sql(f"""
            CREATE TABLE {self.name} (hash BIGINT, doc_id STRING, n_pos BIGINT, n_fp BIGINT, batch STRING)
            USING parquet PARTITIONED BY (batch) CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS
            LOCATION '{self.path}/data'""")

    def append(self, dh: DataFrame, batch: str) -> None:
        """Write the fingerprints of a batch of documents; the same batch written again replaces itself."""
        # dealt by bucket first: one file a bucket, sorted, instead of one a task and bucket
        rows = dh.select("hash", F.col("doc_id").cast("string").alias("doc_id"), F.col("n_pos").cast("long").alias("n_pos"),
                         F.col("n_fp").cast("long").alias("n_fp")).repartition(self.buckets, "hash")
        view = f"{self.name}_batch"
        rows.createOrReplaceTempView(view)
        try:
            self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = '{_literal(batch)}') "
                           f"SELECT hash, doc_id, n_pos, n_fp FROM {view}")
        finally:
            self.spark.catalog.dropTempView(view)

    def take_back(self, batch: str) -> None:
        """Remove a batch: its partition and its files."""
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (batch = '{_literal(batch)}')")
        jvm = self.spark._jvm
        part = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data", f"batch={jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(batch)}")
        part.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(part, True)

    def batches(self) -> list[str]:
        """Names of the stored batches, from the catalog's partitions."""
        return sorted(r.partition[len("batch="):] for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect())

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def document_frequency(self) -> DataFrame:
        """(hash, df) over all batches: counted in the buckets, without a shuffle."""
        return self.rows().groupBy("hash").agg(F.count(F.lit(1)).alias("df"))

    def probe(self, new: DataFrame) -> DataFrame:
        """Coverage of every (new document, stored document) pair with a common
        fingerprint: (doc_id, repo_key, shared, covered_new, covered_repo,
        total_new, total_repo). ``new`` = (hash, doc_id, n_pos, n_fp)."""
        mine = new.select("hash", "doc_id", "n_pos", "n_fp")
        stored = self.rows().select("hash", F.col("doc_id").alias("repo_key"), F.col("n_pos").alias("r_pos"),
                                    F.col("n_fp").alias("r_fp"))
        return (mine.join(stored, "hash").groupBy("doc_id", "repo_key")
                .agg(F.count(F.lit(1)).alias("shared"), F.sum("n_pos").alias("covered_new"),
                     F.sum("r_pos").alias("covered_repo"), F.max("n_fp").alias("total_new"),
                     F.max("r_fp").alias("total_repo")))


def _literal(batch: str) -> str:
    if not batch or not all(c.isalnum() or c in "-_." for c in batch):
        raise ValueError(f"batch name {batch!r}: letters, digits, '-', '_' and '.' only")
    return batch


def create_index(spark: SparkSession, path: str, buckets: int = BUCKETS) -> FingerprintIndex:
    """A new, empty index in the folder ``path``."""
    index = FingerprintIndex(spark, path, buckets)
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("errorifexists").json(f"{index.path}/meta")
    index._register()
    return index


def open_index(spark: SparkSession, path: str) -> FingerprintIndex:
    """The index that another session has written to ``path``."""
    buckets = spark.read.schema("buckets int").json(f"{path.rstrip('/')}/meta").first().buckets
    index = FingerprintIndex(spark, path, buckets)
    index._register()
    spark.sql(f"MSCK REPAIR TABLE {index.name}")
    return index
