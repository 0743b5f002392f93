from __future__ import annotations

from pyspark.sql import functions as F

from .common import read
from .labelled import fold
from .quality_fm import fit_quality, score_quality
from .registry import register
from .toxicity import fit_toxicity, score_toxicity


@register("op1_toxicity")
def op1(spark, sf_dir):
    """Toxicity of all documents; labels only from rows with crc32 mod 3 other than 1."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return score_toxicity(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                                              "predicted", "most_saved")


@register("op3_quality_fm")
def op3(spark, sf_dir):
    """Quality of all documents; labels only from rows with crc32 mod 4 other than 2."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return score_quality(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                                             "predicted")
