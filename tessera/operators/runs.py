"""Where a run stands: counts of its tiers, the stage to go on with, pages of pending units, and chunks with large files.

A run's facts are one row: which artifacts it has, how many units each tier has and
how many markers of either kind. Stages are conditions over that row, in order; the
first open one is the step.

Defined cases: a run without any artifact is at the first stage; a tier without
units has nothing pending; markers of tiers that have no total count all the same;
a failed unit is terminal and is not done.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packing


@dataclass(frozen=True)
class Stage:
    step: str
    action: str
    open: Column


def _has(artifact: str) -> Column:
    return F.array_contains("artifacts", artifact)


def _count(kind: str, tier: str) -> Column:
    return F.coalesce(F.try_element_at(kind, F.lit(tier)), F.lit(0))


def _pending(tier: str) -> Column:
    return (_count("total", tier) > 0) & (_count("done", tier) + _count("failed", tier) < _count("total", tier))


def run_facts(runs: DataFrame, artifacts: DataFrame, totals: DataFrame, markers: DataFrame, run: str = "run") -> DataFrame:
    """runs with artifacts array<string>, and total, done, failed as maps by tier.

    artifacts (run, name), totals (run, tier, total), markers (run, tier, unit, state).
    Markers are counted by run, tier and state before anything meets; what is kept
    of a run is one entry per tier and artifact name.
    """
    names = artifacts.groupBy(run).agg(F.collect_set("name").alias("artifacts"))
    entries = lambda df, value: df.groupBy(run).agg(F.map_from_entries(F.collect_list(F.struct("tier", value))).alias(value))
    whole = entries(totals.groupBy(run, "tier").agg(F.max("total").cast("long").alias("total")), "total")
    per = markers.select(run, "tier", "unit", "state").distinct().groupBy(run, "tier").agg(F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "failed").alias("failed"))
    both = per.groupBy(run).agg(*[F.map_from_entries(F.collect_list(F.struct("tier", k))).alias(k) for k in ("done", "failed")])
    met = runs.join(names, run, "left").join(whole, run, "left").join(both, run, "left")
    none = F.create_map().cast("map<string,bigint>")
    return met.withColumns({"artifacts": F.coalesce("artifacts", F.array().cast("array<string>")), **{k: F.coalesce(k, none) for k in ("total", "done", "failed")}})


def control_stages() -> tuple[Stage, ...]:
    """Stages of a scan of controls; its runs have mode, no_scout and skip_consistency."""
    return (
        Stage("merge", "merge partial inventories", F.col("mode") == "merge"),
        Stage("discover", "resume the scan", ~(_has("candidates") & _has("clusters")) & _has("scan_progress")),
        Stage("discover", "scan", ~(_has("candidates") & _has("clusters"))),
        Stage("scout", "plan batches", ~F.col("no_scout") & ~_has("scout_plan")),
        Stage("scout", "read batches", ~F.col("no_scout") & _pending("scout")),
        Stage("scout", "merge batches", ~F.col("no_scout") & (_count("total", "scout") > 0) & ~(_has("scout_candidates") & _has("scout_merge"))),
        Stage("scout", "fold in", ~F.col("no_scout") & (_count("total", "scout") > 0) & ~_has("scout_merged")),
        Stage("t1", "read clusters", _pending("t1")),
        Stage("t2", "synthesise", ~_has("t2_done") | ~_has("inventory")),
        Stage("t3", "write rules", _pending("t3")),
        Stage("assemble", "assemble rules", ~F.col("skip_consistency") & ~_has("t4_done")),
        Stage("done", "none", _has("manifest")),
    )


def survey_stages() -> tuple[Stage, ...]:
    """Stages of a survey of tests; its runs have skip_consistency."""
    return (
        Stage("classify", "classify tests", ~_has("test_groups")),
        Stage("extract", "extract groups", _pending("extract")),
        Stage("synthesize", "synthesise", ~_has("synthesize_done")),
        Stage("rules", "write rules", _pending("rules")),
        Stage("assemble", "assemble rules", ~_has("assemble_done")),
        Stage("consistency", "check consistency", ~F.col("skip_consistency") & ~_has("consistency_done")),
        Stage("mutators", "derive mutators", ~_has("mutators")),
        Stage("done", "none", _has("manifest")),
    )


def resume(facts: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """facts with step, action and resumable: the first open stage; none open means that the manifest is still to be written."""
    known = F.lit(None).cast("struct<step:string,action:string>")
    for stage in reversed(stages):
        own = F.struct(F.lit(stage.step).alias("step"), F.lit(stage.action).alias("action"))
        known = F.when(F.coalesce(stage.open, F.lit(False)), own).otherwise(known)
    held = F.coalesce(known, F.struct(F.lit("done").alias("step"), F.lit("write the manifest").alias("action")))
    return facts.withColumn("_s", held).select(*facts.columns, "_s.step", "_s.action", (~((F.col("_s.step") == "done") & F.array_contains("artifacts", "manifest"))).alias("resumable"))


def failure_notes(facts: DataFrame, tiers: Sequence[str], run: str = "run") -> DataFrame:
    """(run, tier, failed, total, high): tiers with failed units; high where they are more than half."""
    rows = F.array(*[F.struct(F.lit(t).alias("tier"), _count("failed", t).alias("failed"), _count("total", t).alias("total")) for t in tiers])
    each = facts.select(run, F.explode(rows).alias("r")).select(run, "r.*").where("failed > 0")
    return each.withColumn("high", (F.col("total") > 0) & (F.col("failed") * 2 > F.col("total")))


def pending_units(units: DataFrame, group: str, unit: str, markers: DataFrame) -> DataFrame:
    """Units that are neither done nor failed, of groups that are neither; markers (unit, state) name groups and units alike."""
    terminal = markers.where(F.col("state").isin("done", "failed")).select(F.col("unit").alias("_t")).distinct()
    return units.join(terminal, F.col(group) == F.col("_t"), "left_anti").join(terminal, F.col(unit) == F.col("_t"), "left_anti")


def group_totals(groups: DataFrame, group: str, pending: DataFrame, markers: DataFrame) -> DataFrame:
    """One row: total, done, failed, pending groups and pending units. A group is failed by its own marker, unless it is done too; one without pending units is done."""
    state = lambda s: markers.where(F.col("state") == s).select(F.col("unit").alias(group)).distinct().withColumn(f"_{s}", F.lit(True))
    open_ = pending.groupBy(group).agg(F.count(F.lit(1)).alias("_units"))
    met = groups.select(group).distinct().join(state("done"), group, "left").join(state("failed"), group, "left").join(open_, group, "left")
    failed = F.col("_failed").isNotNull() & F.col("_done").isNull()
    counts = met.agg(F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failed"), F.count_if(F.col("_units").isNotNull()).alias("pending"), F.coalesce(F.sum("_units"), F.lit(0)).alias("pending_units"))
    return counts.select("total", (F.col("total") - F.col("failed") - F.col("pending")).alias("done"), "failed", "pending", "pending_units")


def pending_page(pending: DataFrame, order: Sequence[Column | str], size: str, offset: int, limit: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """The page of pending units, and one row about it: offset, limit, effective_limit, shrunk."""
    page = packing.page(pending, order, size, offset, limit, budget)
    wanted = pending.orderBy(*order).offset(offset).limit(limit)
    counts = page.select(F.lit(1).alias("_got"), F.lit(0).alias("_wanted")).unionAll(wanted.select(F.lit(0), F.lit(1)))
    about = counts.agg(F.coalesce(F.sum("_got"), F.lit(0)).alias("effective_limit"), F.coalesce(F.sum("_wanted"), F.lit(0)).alias("_wanted"))
    return page, about.select(F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), "effective_limit", (F.col("effective_limit") < F.col("_wanted")).alias("shrunk"))


def needs_slice(chunks: DataFrame, chunk: str, files: str, sizes: DataFrame, big_bytes: int) -> DataFrame:
    """(chunk, needs_slice): the files of each chunk that are larger than big_bytes, in the chunk's order; unknown files are passed over.

    sizes (path, bytes): only large files meet the chunks.
    """
    large = sizes.where(F.col("bytes") > big_bytes).select(F.col("path").alias("_file")).distinct()
    each = chunks.select(chunk, F.posexplode(files).alias("_pos", "_file")).join(large, "_file")
    found = each.groupBy(chunk).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_file"))), lambda x: x["_file"]).alias("needs_slice"))
    return chunks.select(chunk).join(found, chunk, "left").withColumn("needs_slice", F.coalesce("needs_slice", F.array().cast("array<string>")))
