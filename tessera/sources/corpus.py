"""Corpus scans (A1-A4).

A corpus tree ``root/case-NN/{original, plagiarized/L?/NN, non-plagiarized/NN}/*.java``
is read by Spark's text source with whole-file records; case, role, level and
submission id come from the file path with regexes, so the ground truth is
derived on the executors next to the scan.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairs import path_key
from ..session import cut_lineage

# Path patterns of the corpus layout.
CASE_RE = r"/(case-[0-9]+)/"
LEVEL_RE = r"/plagiarized/(L[1-6])/"
PLAG_ID_RE = r"/plagiarized/L[1-6]/([^/]+)/"
NONPLAG_ID_RE = r"/non-plagiarized/([^/]+)/"
SUBMISSION_SCHEMA = ("case string, level string, submission_id string, role string, is_plagiarized boolean, "
                     "file_name string, text string")


def read_submissions(spark: SparkSession, root: str, glob: str = "*.java") -> DataFrame:
    """A1: one row per file: (case, level, submission_id, role, is_plagiarized,
    file_name, text, key). Dot-directories are skipped (Hadoop ignores
    hidden paths); files outside the layout get role NULL and are dropped.

    The driver lists one folder of ``root`` (a case) at a time, whose texts are
    written as one table, and forgets its files; a task reads many of them."""
    before = spark.conf.get(MAX_TASKS, None)
    spark.conf.set(MAX_TASKS, str(max(200, 4 * spark.sparkContext.defaultParallelism)))
    try:
        folders, files = _entries(spark, root)
        parts = [cut_lineage(_submissions(spark, x, glob)) for x in [*folders, files] if x]
    finally:
        spark.conf.unset(MAX_TASKS) if before is None else spark.conf.set(MAX_TASKS, before)
    return reduce(DataFrame.unionByName, parts) if parts else _submissions(spark, root, glob)


MAX_TASKS = "spark.sql.files.maxPartitionNum"  # of a read; a small file counts as 4 MB else


def _entries(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """The folders and the files in ``root`` that Spark does not take for hidden, as paths that are no patterns."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s for base in fs.globStatus(path) or [] for s in fs.listStatus(base.getPath())]
    seen = [s for s in found if not re.match(r"\.|_(?!.*=)", s.getPath().getName())]
    paths = {True: [], False: []}
    for s in seen:
        paths[s.isDirectory()].append(re.sub(r"([\\{}\[\]*?])", r"\\\1", s.getPath().toString()))
    return sorted(paths[True]), sorted(paths[False])


def _submissions(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    # wholetext must be the keyword: text()'s own default would override an option()
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    p = F.col("_metadata.file_path")
    df = df.select(p.alias("path"), F.col("value").alias("text"))
    role = (F.when(F.col("path").contains("/original/"), F.lit("original"))
            .when(F.col("path").contains("/non-plagiarized/"), F.lit("non-plagiarized"))
            .when(F.col("path").contains("/plagiarized/"), F.lit("plagiarized")))
    lvl = F.regexp_extract("path", LEVEL_RE, 1)
    out = df.select(
        F.regexp_extract("path", CASE_RE, 1).alias("case"),
        F.when(role == "plagiarized", lvl).when(role == "non-plagiarized", F.lit("non-plag")).alias("level"),
        F.when(role == "plagiarized", F.regexp_extract("path", PLAG_ID_RE, 1))
        .when(role == "non-plagiarized", F.regexp_extract("path", NONPLAG_ID_RE, 1)).alias("submission_id"),
        role.alias("role"), (role == "plagiarized").alias("is_plagiarized"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "text", path_key("path").alias("key"))
    return out.filter(F.col("role").isNotNull())


def filter_cases(df: DataFrame, cases: list[str] | None, case_col: str = "case") -> DataFrame:
    """A2: keep the selected cases (all when None); an empty selection is an error."""
    if cases is None:
        return df
    if not cases:
        raise ValueError("empty case selection")
    return df.filter(F.col(case_col).isin(sorted(cases)))


def split_anchors(df: DataFrame, role_col: str = "role", case_col: str = "case",
                  original: str = "original") -> tuple[DataFrame, DataFrame]:
    """A3: (originals, submissions); submissions of a case without an
    original are skipped (left-semi join on case)."""
    origs = df.filter(F.col(role_col) == original)
    subs = df.filter(F.col(role_col) != original)
    subs = subs.join(origs.select(case_col).distinct(), case_col, "left_semi")
    return origs, subs


def merge_files(df: DataFrame, key: str, name_col: str, text_col: str = "text", mode: str = "join") -> DataFrame:
    """A4: one text per submission from its files, ordered by file name.

    mode 'join': texts joined by a newline; 'headers': each file preceded by
    a ``// --- FILE: name ---`` line. (A submission is one unit of work: its
    files are merged inside one row, as the detectors read them.)
    """
    files = F.sort_array(F.collect_list(F.struct(F.col(name_col).alias("n"), F.col(text_col).alias("t"))))
    g = df.groupBy(key).agg(files.alias("_f"))
    if mode == "join":
        merged = F.array_join(F.transform("_f", lambda x: x["t"]), "\n")
    elif mode == "headers":
        merged = F.array_join(F.transform("_f", lambda x: F.concat(
            F.lit("// --- FILE: "), x["n"].cast("string"), F.lit(" ---\n"), x["t"])), "\n")
    else:
        raise ValueError(f"unknown merge mode {mode!r}")
    return g.select(key, F.size("_f").alias("n_files"), merged.alias(text_col))
