"""Sinks: one folder per unit, text files, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def write_json(df: DataFrame, path: str) -> None:
    """Atomic by Spark's commit protocol."""
    df.write.mode("overwrite").json(path)


def write_units(df: DataFrame, unit: str, path: str) -> None:
    """Each unit's rows as JSON in a folder of its own; units are clustered before the write.

    A folder has the unit's name; where that cannot name a folder, a hash of it
    is added, so that units such as a/b, a:b and a_b keep apart.
    """
    name = X.file_name(F.col(unit))
    safe = F.when(name == F.col(unit), name).otherwise(F.concat_ws("-", name, X.short_sha(F.col(unit), 8)))
    df.withColumn("unit_dir", safe).repartition("unit_dir").write.mode("overwrite").partitionBy("unit_dir").json(path)


def write_texts(df: DataFrame, text: str, path: str) -> None:
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").parquet(path)


def snapshot(files: DataFrame) -> DataFrame:
    """(path, modified, bytes): what decides whether a cache is fresh."""
    return files.select("path", "modified", "bytes")


def fresh_or(spark, cache: str, current: DataFrame, build) -> DataFrame:
    """The cached table if its snapshot equals the current one, else built, written with its snapshot and read back."""
    from ..operators.state import same_snapshot

    try:
        if same_snapshot(spark.read.parquet(f"{cache}/snapshot"), current):
            return spark.read.parquet(f"{cache}/table")
    except Exception as x:  # noqa: BLE001  there is no cache yet
        if "PATH_NOT_FOUND" not in str(x):
            raise
    build().write.mode("overwrite").parquet(f"{cache}/table")
    current.write.mode("overwrite").parquet(f"{cache}/snapshot")
    return spark.read.parquet(f"{cache}/table")
