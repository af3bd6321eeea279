"""Units, markers and keyed memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def marker_unit(body: str = "body", record: str = "record", stem: str = "stem") -> F.Column:
    """The unit a marker is for: by its body, else by its record, else by its file name."""
    of = lambda c: F.nullif(F.get_json_object(c, "$.unit"), F.lit(""))
    return F.coalesce(of(body), of(record), F.col(stem))


def pending(units: DataFrame, markers: DataFrame, key: str = "unit") -> DataFrame:
    """Units without a terminal marker (done or failed)."""
    return units.join(markers.where(F.col("state").isin("done", "failed")).select(key).distinct(), key, "left_anti")


def tier_counts(states: DataFrame) -> DataFrame:
    """Per tier: total, done, failed, pending, and whether all units are terminal."""
    per = lambda s: F.count_if(F.col("state") == s)
    return (
        states.groupBy("tier")
        .agg(F.count(F.lit(1)).alias("total"), per("done").alias("done"), per("failed").alias("failed"))
        .withColumn("pending", F.col("total") - F.col("done") - F.col("failed"))
        .withColumn("complete", F.col("pending") == 0)
    )


def current_step(counts: DataFrame, tiers: list[str]) -> DataFrame:
    """The first incomplete tier in order, or "finished": one row from one row per tier."""
    order = F.array_position(F.array(*[F.lit(t) for t in tiers]), F.col("tier"))
    open_ = counts.where(~F.col("complete")).agg(F.min_by("tier", order).alias("t"))
    return open_.select(F.coalesce("t", F.lit("finished")).alias("step"))


def both_terminals(markers: DataFrame, key: str = "unit") -> DataFrame:
    """Units with more than one terminal state."""
    terminal = markers.where(F.col("state").isin("done", "failed")).select(key, "state").distinct()
    return terminal.groupBy(key).agg(F.count(F.lit(1)).alias("n_states")).where("n_states > 1")


def orphans(markers: DataFrame, units: DataFrame, key: str = "unit") -> DataFrame:
    return markers.join(units.select(key).distinct(), key, "left_anti")


def stale(markers: DataFrame, lineage: DataFrame) -> DataFrame:
    """Markers of tiers that lie downstream of a tier with appended rows; lineage: (tier, downstream)."""
    return markers.join(lineage.select(F.col("downstream").alias("tier")).distinct(), "tier", "left_semi")


def upsert(base: DataFrame, batch: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """base (key, value, pos) with the batch's last value per key in place, and new keys appended.

    pos keeps the base's order; appended keys follow by the order of their last
    write. updated tells what the batch touched.
    """
    last = batch.groupBy(key).agg(F.max_by(value, order).alias("_new"), F.max(order).alias("_pos"))
    joined = base.join(last, key, "full_outer")
    return joined.select(
        key,
        F.when(F.col("_pos").isNotNull(), F.col("_new")).otherwise(F.col(value)).alias(value),
        F.col("pos"),
        F.when(F.col("pos").isNull(), F.col("_pos")).alias("appended_at"),
        F.col("_pos").isNotNull().alias("updated"),
    )


def same_snapshot(a: DataFrame, b: DataFrame) -> bool:
    """Whether two (path, modified, size) snapshots are equal: order-free sums of row hashes, one row each."""
    digest = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first())
    return digest(a) == digest(b)
