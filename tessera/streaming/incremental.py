"""Incremental scans over a growing folder.

The checkpoint plays the part of a resume offset: a run takes what is new
(availableNow), may be stopped at any time, and goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.scan import pattern_hits


def scan_new_files(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 100, key: str = "doc_id") -> None:
    """Pattern hits of the files that no earlier run has seen, appended to out."""
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    query = pattern_hits(stream, key).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
