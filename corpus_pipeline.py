"""From raw documents to a mix: quality rules, line dedup, near duplicates, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; what it returns is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.

Defined cases are those of the operators; columns beyond the documents' own are
put aside as one struct while a stage runs, so that no name can clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, line_dedup, mixing, quality, support

OWN = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _aside(docs: DataFrame) -> DataFrame:
    others = [c for c in docs.columns if c not in OWN]
    return docs.select(*OWN, F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("_others")) if others else docs.select(*OWN)


def _restored(df: DataFrame, like: DataFrame) -> DataFrame:
    others = [c for c in like.columns if c not in OWN]
    return df.select(*[F.col(f"_others.c{others.index(c)}").alias(c) if c in others else F.col(c) for c in like.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave the fertility bands go."""
    return _restored(quality.keep_good(_aside(docs)), docs)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents stay in one; n_chars follows the text."""
    done = line_dedup.dedup_lines(_aside(docs))
    chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return _restored(done.withColumn("n_chars", chars), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of smallest doc_id."""
    found = support.staged(jaccard_join.similarity_components(docs), "components")
    return _restored(jaccard_join.one_of_each(_aside(docs), found), docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = decontaminate.decontaminate(docs, items).where("contaminated").select(F.col("row_key").alias("_bad")).distinct()
    inner = _aside(docs)
    return _restored(inner.withColumn("_row", support.row_key()).join(bad, F.col("_row") == F.col("_bad"), "left_anti"), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and the words taken."""
    return mixing.mix_sources(docs).where("taken > 0")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", shared_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("source_mixing", source_mix),
]

#: Token counts of public vocabularies have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = support.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
