"""Readers for prediction tables, run logs and detector reports (A5-A10).

All readers take explicit schemas: ids such as "03" must stay strings, and
booleans arrive as text (True/False, sometimes 1/yes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTIONS_SCHEMA = ("case string, level string, submission_id string, similarity double, "
                      "is_plagiarized string, predicted_plag string")


def text_bool(c, accept_numeric: bool = False) -> Column:
    """'true' in any case -> True; with accept_numeric also '1' / 'yes'."""
    v = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    ok = v == "true"
    if accept_numeric:
        ok = ok | v.isin("1", "yes")
    return F.coalesce(ok, F.lit(False))


def read_predictions(spark: SparkSession, path: str, run_names: bool = False) -> DataFrame:
    """A5: the six-column predictions CSV with text booleans parsed; with
    ``run_names`` the run's name is the first of seven columns."""
    run = ["run_name"] if run_names else []
    df = spark.read.csv(path, header=True, schema=", ".join([*[f"{c} string" for c in run], PREDICTIONS_SCHEMA]))
    return df.select(*run, "case", "level", "submission_id", "similarity",
                     text_bool("is_plagiarized").alias("is_plagiarized"),
                     text_bool("predicted_plag").alias("predicted_plag"))


def read_runs(spark: SparkSession, paths: dict[str, tuple[str, str]], tools: list[str] | None = None,
              run_names: list[str] | None = None) -> DataFrame:
    """One runs CSV per tool (tool -> (path, DDL schema)); missing files
    are skipped; columns are aligned by name (missing ones NULL)."""
    from py4j.protocol import Py4JJavaError

    out = None
    for tool, (path, schema) in sorted(paths.items()):
        if tools and tool not in tools:
            continue
        try:
            df = spark.read.csv(path, header=True, schema=schema)
            df.schema  # noqa: B018 -- resolves the path now: a missing file is skipped
        except (Py4JJavaError, Exception) as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
                continue
            raise
        df = df.withColumn("tool", F.lit(tool))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError("no runs file found")
    if run_names:
        out = out.filter(F.col("run_name").isin(run_names))
    return out


def read_pair_report(spark: SparkSession, files_path: str, pairs_path: str) -> DataFrame:
    """Flat pair report: per-file k-gram totals + covered counts per pair.

    Both CSVs are read as strings and cast with ``try_cast``; rows whose
    numbers do not parse are skipped. Output: left, right, left_covered,
    right_covered, left_total, right_total, similarity.
    """
    files = spark.read.csv(files_path, header=True, schema="path string, amountOfKgrams string")
    files = files.select("path", F.expr("try_cast(amountOfKgrams AS BIGINT)").alias("total")).filter("total IS NOT NULL")
    pairs = spark.read.csv(pairs_path, header=True, schema=(
        "leftFilePath string, rightFilePath string, leftCovered string, rightCovered string, similarity string"))
    pairs = pairs.select(F.col("leftFilePath").alias("left"), F.col("rightFilePath").alias("right"),
                         F.expr("try_cast(leftCovered AS BIGINT)").alias("left_covered"),
                         F.expr("try_cast(rightCovered AS BIGINT)").alias("right_covered"),
                         F.expr("try_cast(similarity AS DOUBLE)").alias("similarity"))
    pairs = pairs.filter("left_covered IS NOT NULL AND right_covered IS NOT NULL AND similarity IS NOT NULL")
    lt = files.select(F.col("path").alias("left"), F.col("total").alias("left_total"))
    rt = files.select(F.col("path").alias("right"), F.col("total").alias("right_total"))
    return pairs.join(lt, "left").join(rt, "right").select(
        "left", "right", "left_covered", "right_covered", "left_total", "right_total", "similarity")


COMPARISON_SCHEMA = ("id1 string, id2 string, first_submission string, second_submission string, "
                     "similarities map<string,double>, similarity double, percent double")


def read_comparison_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nested comparison records -> (first, second, avg, max), both orderings.

    AVG falls back over key variants, then the mean of all similarities, then
    the legacy ``similarity`` / ``percent`` field (> 1 means percent);
    MAX falls back to the largest value of the map. ``multi_line`` for files
    holding one pretty-printed object each (JSON lines otherwise).
    """
    df = spark.read.schema(COMPARISON_SCHEMA).option("multiLine", multi_line).json(path)
    sims = F.col("similarities")
    vals = F.map_values(sims)
    mean = F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) / F.size(vals))
    legacy = F.coalesce(F.col("similarity"), F.col("percent"))
    legacy = F.when(legacy > 1, legacy / 100.0).otherwise(legacy)
    avg = F.coalesce(sims["AVG"], sims["avg"], sims["AVERAGE"], sims["average"], mean, legacy)
    mx = F.coalesce(sims["MAX"], sims["max"], F.array_max(vals), legacy)
    first = F.coalesce(F.col("first_submission"), F.col("id1"))
    second = F.coalesce(F.col("second_submission"), F.col("id2"))
    one = df.select(first.alias("first"), second.alias("second"), avg.alias("avg"), mx.alias("max"))
    return one.unionByName(one.select(F.col("second").alias("first"), F.col("first").alias("second"), "avg", "max"))


# Line formats of the text reports.
CONSISTS_RE = r"^(.+?)\s+consists\s+for\s+([0-9.]+)\s*%\s+of\s+(.+?)\s+material"
RECORD_RULE_RE = r"(?m)^(?:={8,}|-{8,}).*$"  # a line that starts with eight or more = or -
SIM_A_RE = r"Similarity A:\s*([0-9.]+)"
SIM_B_RE = r"Similarity B:\s*([0-9.]+)"
FILE_A_RE = r"File A:\s*(\S+)"
FILE_B_RE = r"File B:\s*(\S+)"


def read_consists_report(spark: SparkSession, path: str) -> DataFrame:
    """A9 (line format): "X consists for N % of Y material" -> (x, y, fraction)."""
    t = spark.read.text(path)
    m = t.filter(F.col("value").rlike(CONSISTS_RE))
    return m.select(F.regexp_extract("value", CONSISTS_RE, 1).alias("x"),
                    F.regexp_extract("value", CONSISTS_RE, 3).alias("y"),
                    (F.regexp_extract("value", CONSISTS_RE, 2).try_cast("double") / 100.0).alias("fraction"))


def read_record_report(spark: SparkSession, path: str) -> DataFrame:
    """A9 (record format): records between rules (lines of eight or more = or -)
    with File A/B and Similarity A/B lines -> (file_a, file_b, sim_a, sim_b).
    A report file is one run's output and is read whole."""
    t = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", RECORD_RULE_RE)).alias("value"))
    r = t.select(F.regexp_extract("value", FILE_A_RE, 1).alias("file_a"),
                 F.regexp_extract("value", FILE_B_RE, 1).alias("file_b"),
                 F.regexp_extract("value", SIM_A_RE, 1).alias("a"), F.regexp_extract("value", SIM_B_RE, 1).alias("b"))
    r = r.filter((F.col("a") != "") & (F.col("b") != ""))
    scale = lambda c: F.when(F.col(c).try_cast("double") > 1, F.col(c).try_cast("double") / 100).otherwise(
        F.col(c).try_cast("double"))
    return r.select("file_a", "file_b", scale("a").alias("sim_a"), scale("b").alias("sim_b"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """A10: '@#@'-separated method blocks; header of 10 comma fields, then the
    metric vector, then the called names. Short rows (< 10 header fields) dropped."""
    t = spark.read.text(path)
    parts = F.split("value", "@#@")
    head = F.split(parts[0], ",")
    b = t.select(head.alias("h"), parts.alias("p")).filter(F.size("h") >= 10)
    return b.select(
        F.get("h", 0).alias("folder"), F.get("h", 1).alias("file"), F.get("h", 2).try_cast("int").alias("start"),
        F.get("h", 3).try_cast("int").alias("end"), F.get("h", 4).alias("method"), F.get("h", 5).try_cast("int").alias("tokens"),
        F.get("h", 6).try_cast("int").alias("unique_tokens"), F.get("h", 7).alias("hash"),
        F.get("h", 8).alias("proj_id"), F.get("h", 9).alias("func_id"),
        F.transform(F.filter(F.split(F.coalesce(F.get("p", 1), F.lit("")), ","), lambda x: x != ""),
                    lambda x: x.try_cast("double")).alias("metrics"),
        F.filter(F.split(F.coalesce(F.get("p", 2), F.lit("")), ","), lambda x: x != "").alias("calls"))


def read_clone_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A10: clone pairs 'folder1,file1,start1,end1,folder2,file2,start2,end2'; short rows dropped."""
    t = spark.read.text(path)
    f = t.select(F.split("value", ",").alias("f")).filter(F.size("f") >= 8)
    return f.select(F.get("f", 0).alias("folder1"), F.get("f", 1).alias("file1"), F.get("f", 2).try_cast("int").alias("start1"),
                    F.get("f", 3).try_cast("int").alias("end1"), F.get("f", 4).alias("folder2"), F.get("f", 5).alias("file2"),
                    F.get("f", 6).try_cast("int").alias("start2"), F.get("f", 7).try_cast("int").alias("end2"))
