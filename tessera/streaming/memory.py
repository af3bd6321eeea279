"""Keyed memory that a stream of answers is merged into, epoch by epoch.

The memory is a table of versions, one folder for each epoch that changed it. An
epoch reads the newest version before it and writes its own; a version counts once
its writer has finished, and an epoch whose version counts already is passed over.
So an epoch that runs again after a failure changes nothing, and a half-written
version is written anew.

Rows: key, value, first_epoch and first_order (where the key was first written; they
keep the order of the memory), updated_epoch (the last epoch that wrote a known key,
null for keys written once).

Defined cases: of several answers to one key in an epoch the last by `order` stands,
equal orders are decided by value; a null key or value is no answer; an empty epoch
makes no version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import delete_path

KEPT_VERSIONS = 2


def merge_answers(memory: DataFrame | None, answers: DataFrame, epoch: int, key: str, value: str, order: str) -> DataFrame:
    """The memory after an epoch's answers."""
    given = answers.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    last = given.groupBy(key).agg(F.max(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("_new"), F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
    fresh = F.lit(epoch).cast("long")
    if memory is None:
        return last.select(key, F.col("_new.v").alias(value), fresh.alias("first_epoch"), F.col("_first").alias("first_order"), F.when(F.col("_n") > 1, fresh).alias("updated_epoch"))
    met = memory.join(last, key, "full_outer")
    told, known = F.col("_n").isNotNull(), F.col("first_epoch").isNotNull()
    return met.select(
        key,
        F.when(told, F.col("_new.v")).otherwise(F.col(value)).alias(value),
        F.coalesce("first_epoch", fresh).alias("first_epoch"),
        F.when(known, F.col("first_order")).otherwise(F.col("_first")).alias("first_order"),
        F.when(told & (known | (F.col("_n") > 1)), fresh).otherwise(F.col("updated_epoch")).alias("updated_epoch"),
    )


def summary(memory: DataFrame | None, answers: DataFrame, key: str, value: str) -> DataFrame:
    """One row: answers that updated a key, keys that were appended, keys in all."""
    per = answers.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    known = per.limit(0).select(key).withColumn("_known", F.lit(True)) if memory is None else memory.select(key, F.lit(True).alias("_known"))
    met = per.join(known, key, "full_outer")
    appended = F.count_if(F.col("_known").isNull())
    return met.agg((F.coalesce(F.sum("_n"), F.lit(0)) - appended).alias("updated"), appended.alias("appended"), F.count(F.lit(1)).alias("total"))


def _versions(spark: SparkSession, table: str) -> list[int]:
    """Epochs whose version is complete, ascending."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(table)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{table}/{n}/_SUCCESS")))


def read_memory(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The newest version, or the newest one of an epoch before the given one; None if there is none."""
    found = [v for v in _versions(spark, table) if before is None or v < before]
    return spark.read.parquet(f"{table}/v{found[-1]}") if found else None


def merge_epoch(answers: DataFrame, epoch: int, table: str, key: str, value: str, order: str) -> None:
    """What foreachBatch does with an epoch; may run any number of times."""
    spark = answers.sparkSession
    if epoch in _versions(spark, table) or answers.isEmpty():
        return
    merged = merge_answers(read_memory(spark, table, epoch), answers, epoch, key, value, order)
    merged.write.mode("overwrite").parquet(f"{table}/v{epoch}")
    for old in [v for v in _versions(spark, table) if v < epoch][:-KEPT_VERSIONS]:
        delete_path(spark, f"{table}/v{old}")


def memory_stream(stream: DataFrame, table: str, key: str, value: str, order: str) -> None:
    """Merge all that the stream has by now; the checkpoint lies beside the versions, since epochs are its own."""
    query = stream.writeStream.foreachBatch(lambda answers, epoch: merge_epoch(answers, epoch, table, key, value, order)).option("checkpointLocation", f"{table}/_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
