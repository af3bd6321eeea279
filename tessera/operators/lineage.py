"""What follows from what: versions along a lineage, stale markers, presence rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import discard, staged


def upstream_versions(lineage: DataFrame, appended: DataFrame) -> DataFrame:
    """(node, version): the newest version that was appended to any node upstream, however far.

    lineage (node, downstream), appended (node, version). A round passes on only
    versions that have grown, so it ends after the longest path, and on cycles too,
    where a node is upstream of itself.
    """
    steps = lineage.select("node", "downstream").where("node IS NOT NULL AND downstream IS NOT NULL").distinct()
    moving = appended.groupBy("node").agg(F.max("version").alias("version")).where("version IS NOT NULL AND node IS NOT NULL")
    known = None
    while True:
        arrived = moving.join(steps, "node").groupBy(F.col("downstream").alias("node")).agg(F.max("version").alias("version"))
        if known is not None:
            arrived = arrived.join(known.withColumnRenamed("version", "_had"), "node", "left").where(F.coalesce(F.col("version") > F.col("_had"), F.lit(True))).drop("_had")
        moving = staged(arrived, "versions")
        if moving.isEmpty():
            return known if known is not None else moving
        grown = moving if known is None else staged(known.unionByName(moving).groupBy("node").agg(F.max("version").alias("version")), "versions")
        if known is not None:
            discard(known)
        known = grown


def stale_markers(markers: DataFrame, lineage: DataFrame, appended: DataFrame, node: str = "tier", made: str = "made_at") -> DataFrame:
    """Markers that are older than something appended upstream of them, with that version as stale_since.

    Rows appended to a marker's own node do not make it stale: they are new units.
    A marker without a version is older than anything.
    """
    versions = upstream_versions(lineage, appended).select(F.col("node").alias(node), F.col("version").alias("stale_since"))
    return markers.join(versions, node).where(F.coalesce(F.col("stale_since") > F.col(made), F.lit(True)))


def broken_implications(present: DataFrame, rules: DataFrame, run: str = "run", artifact: str = "artifact") -> DataFrame:
    """(run, issue): rules (issue, given, other, wanted) that a run breaks; it has `given`, and has `other` or not against `wanted`.

    Two artifacts that must both exist or both be absent are two rules.
    """
    held = present.select(run, F.col(artifact).alias("given")).distinct()
    others = held.select(run, F.col("given").alias("other"), F.lit(True).alias("_has"))
    met = held.join(rules, "given").join(others, [run, "other"], "left")
    return met.where(F.coalesce("_has", F.lit(False)) != F.col("wanted")).select(run, "issue").distinct()


def cover(groups: DataFrame, group: str, member: str, universe: DataFrame) -> DataFrame:
    """(member, issue, n_groups) of members that are not in exactly one group: `uncovered`, `several` or `unknown` (not in the universe).

    Pairs are counted by member after they are made distinct, so a member of very
    many groups is a number before it meets the universe; an unknown one that is in
    several groups has both issues.
    """
    counts = groups.select(group, member).where(F.col(member).isNotNull()).distinct().groupBy(member).agg(F.count(F.lit(1)).alias("n_groups"))
    known = universe.select(member).where(F.col(member).isNotNull()).distinct().withColumn("_known", F.lit(True))
    met = counts.join(known, member, "full_outer").withColumn("n_groups", F.coalesce("n_groups", F.lit(0)))
    issues = F.array_compact(F.array(F.when(F.col("n_groups") == 0, "uncovered"), F.when(F.col("n_groups") > 1, "several"), F.when(F.col("_known").isNull(), "unknown")))
    return met.select(member, F.explode(issues).alias("issue"), "n_groups")
