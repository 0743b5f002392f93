"""Sinks: predictions, run-log snapshots and the score cache.

Writes go to new folders (a snapshot per write); an input is never
overwritten while it is being read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PREDICTION_COLS = ["case", "level", "submission_id", "similarity", "is_plagiarized", "predicted_plag"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (cluster-visible)."""
    from ..session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


# Where making a file means starting processes (``file:`` without Hadoop's native library: a chmod each for the
# file and its checksum file, twice), the plain file system starts one and writes no checksum file. Tasks move
# their files themselves; the driver would move them one by one. Other file systems ignore the first two.
_FILE_A_RECORD = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true",
                  "mapreduce.fileoutputcommitter.algorithm.version": "2"}


# For text files with a row a pair: compressed, and as no reader can split those, of bounded length.
MANY_ROWS = {"compression": "gzip", "maxRecordsPerFile": 1_000_000}


def write_texts(df: DataFrame, path: str) -> None:
    """One file a row of the one string column, in the new folder ``path``; a line break ends each text."""
    df.write.options(**_FILE_A_RECORD).option("maxRecordsPerFile", 1).text(path)


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ("tool", "run_name")) -> str:
    """The six prediction columns (similarity rounded to 4 digits),
    partitioned by tool and run so one run is one folder."""
    cols = [c for c in partition_by if c in df.columns]
    out = df.select(*cols, *[F.round("similarity", 4).alias("similarity") if c == "similarity" else F.col(c)
                             for c in PREDICTION_COLS])
    w = out.write.mode("errorifexists")
    if cols:
        w = w.partitionBy(*cols)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def upsert_runs(log: DataFrame, new: DataFrame, version_col: str = "version") -> DataFrame:
    """The new row replaces the row with the same (tool, run_name), else
    it is appended. Both inputs carry ``version`` (new rows higher); the
    result keeps the latest version per key. Write it as a new snapshot."""
    u = log.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy("tool", "run_name").orderBy(F.desc(version_col))
    return u.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def missing_work(requested: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Requested score keys without a cached result (left-anti join):
    only these are scored; metric / threshold changes reuse the cache."""
    return requested.join(cached.select(*keys).distinct(), keys, "left_anti")


def score_cache(requested: DataFrame, cached: DataFrame | None, keys: list[str], compute, force: bool = False) -> DataFrame:
    """Cached scores for the requested keys, computing only the missing
    ones (``compute`` maps a key table to scores with the same key columns)."""
    if cached is None or force:
        return compute(requested)
    todo = missing_work(requested, cached, keys)
    fresh = compute(todo)
    have = cached.join(requested.select(*keys).distinct(), keys, "left_semi")
    return have.unionByName(fresh, allowMissingColumns=True)
