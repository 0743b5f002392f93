"""Training-corpus pipeline: five stages over ``documents``.

Quality classifier, line dedup, MinHash near-dedup, benchmark decontamination
and the source mix, each by its operator in ``tessera.llm``. Every stage is a
function of (spark, docs, sf_dir), works on all rows that its predecessor
kept, and is written as Parquet and read again before the next one starts, so
a lost executor costs a part of one stage. All stages but the last return the
columns of ``documents``; the last returns the mix as a manifest (doc_id,
source, size, source_size, target, taken).

Nulls, empty texts, repeated rows and empty tables have the results that the
operators define. Line dedup drops a document that it leaves without a word
(its lines are all in others); texts that had none before pass. The near-copy
stage keeps one of several rows with equal id and text. Columns beyond those of
``documents`` are left out. SQL cannot express the trained classifier, so there
is no ``ORACLE_SQL``; the tests compare every stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read, written
from tessera.llm.decontaminate import decontaminate
from tessera.llm.labelled import fold
from tessera.llm.line_dedup import line_dedup
from tessera.llm.minhash import near_duplicates
from tessera.llm.mix import mix
from tessera.llm.quality_fm import fit_quality, score_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR = (80, 100)  # similarity from which two texts are near copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps (score of at least its cut)."""
    model = fit_quality(docs, read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return score_quality(docs, model).filter("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs and of single long lines, n_chars
    following the new text; documents of which no word is left go."""
    kept = line_dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))
    return kept.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the lowest id) of each group of near copies (similarity of
    5-word shingles 0.8 or more)."""
    found = near_duplicates(docs.select("doc_id", "text"), NEAR)
    kept = written(found.filter("kept").groupBy(F.col("doc_id").alias("__k")).agg(F.count("*").alias("__n")), "kept-ids")
    own = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__k")))
    # rows of an id that repeats (few, if any): one of those with the same text
    once = own.filter("__n = 1").select(*COLUMNS)
    return once.unionByName(own.filter("__n > 1").select(*COLUMNS).dropDuplicates(["doc_id", "text"]))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage worth a twentieth of their words."""
    return decontaminate(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes from each document."""
    return mix(docs.select("doc_id", "source", "text"))


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("minhash_near_dedup", near_copies),
          ("decontamination", clean), ("source_mix", mixed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
