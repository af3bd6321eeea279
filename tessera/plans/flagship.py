"""The flagship plan: pattern scan, gate chain, dedup, severity histogram, as one lazy chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import dedup, gates
from . import views as V


def findings_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hit as a finding whose references are its own place."""
    place = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"), F.lit(":"), (F.col("pos") + 1).cast("string"))
    return V.hits(spark, sf_dir).select(
        F.concat_ws("-", F.col("doc_id").cast("string"), "category", F.col("pat_ord").cast("string"), F.col("pos").cast("string")).alias("id"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"),
        F.col("category").alias("cwe"),
        (F.col("pos") + 1).alias("line_start"),
        F.col("token").alias("title"),
        "confidence",
        place.alias("source_ref"),
        place.alias("sink_ref"),
    )


def severity_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = gates.gated(findings_of_hits(spark, sf_dir)).where("dropped_reason IS NULL").drop("dropped_reason")
    unique = dedup.deduped(kept, ["id"])
    return unique.groupBy(scoring.severity(F.col("confidence") * 10).alias("severity")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_duplicates").alias("n_folded"))
