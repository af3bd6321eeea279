"""Tables written to the folder that driver and executors share, and row numbers over sorted tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Where staged tables lie, for discard().
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master, where all tasks see one disk, a temporary folder if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended; the folder is scratch space
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}-{name}"
    atexit.register(_forget, spark, path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet and read back: lineage ends here and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            delete_path(table.sparkSession, path)


def with_ordinal(df: DataFrame, *order: Column | str, name: str = "ordinal") -> DataFrame:
    """1-based position in the global order, without a single-partition window.

    The sorted table is staged with each row's partition and place in it; what
    is summed up in one place is one count per partition.
    """
    placed = staged(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("_part", F.shiftright("_place", 33)).withColumn("_in", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_in") + 1).drop("_part", "_place", "_in", "_start")
