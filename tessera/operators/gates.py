"""Gates, scope tests and row checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import text as T
from . import matching


#: Fixed value: the confidence below which a finding is dropped.
LEAST_CONFIDENCE = 0.40


def present(value: Column) -> Column:
    return F.coalesce(F.length(F.trim(value.cast("string"))) > 0, F.lit(False))


def is_noise(path: Column) -> Column:
    return F.lower(T.posix(path)).rlike("(^|/)(" + "|".join(d.replace(".", "[.]") for d in R.NOISE_DIRS) + ")(/|$)")


def gate_reason(least_confidence: float = LEAST_CONFIDENCE) -> Column:
    """Why a finding is dropped, as one CASE so that the first failing gate names it; null if it is kept."""
    source, sink = F.trim(F.coalesce("source_ref", F.lit(""))), F.trim(F.coalesce("sink_ref", F.lit("")))
    confidence = F.coalesce(F.expr("try_cast(confidence AS double)"), F.lit(0.0))
    return (
        F.when((source == "") | (sink == ""), "missing reference")
        .when(~source.rlike(":[0-9]+") | ~sink.rlike(":[0-9]+"), "reference without line")
        .when(confidence < least_confidence, "low confidence")
        .when(is_noise(F.coalesce("file", F.lit(""))), "noise path")
    )


def gated(findings: DataFrame, least_confidence: float = LEAST_CONFIDENCE, scope: DataFrame | None = None) -> DataFrame:
    """findings with dropped_reason. scope: one column `file`; findings elsewhere are dropped last."""
    out = findings.withColumn("dropped_reason", gate_reason(least_confidence))
    if scope is None:
        return out
    inside = scope.select(T.posix(F.col("file")).alias("_in")).distinct()
    joined = out.join(inside, T.posix(F.coalesce("file", F.lit(""))) == F.col("_in"), "left")
    outside = F.col("dropped_reason").isNull() & present(F.col("file")) & F.col("_in").isNull()
    return joined.withColumn("dropped_reason", F.when(outside, "outside scope").otherwise(F.col("dropped_reason"))).drop("_in")


def in_scope(paths: DataFrame, path: str, globs: Sequence[str], roots: Sequence[str] = ()) -> DataFrame:
    """Rows whose path matches a glob, equals a root or lies below one (all given, so one expression)."""
    own = T.normal_path(F.col(path))
    tests = [own.rlike(T.glob_regex(g)) for g in globs] + [(own == r) | own.startswith(r + "/") for r in (x.strip("/") for x in roots)]
    test = tests[0] if tests else F.lit(False)
    for t in tests[1:]:
        test = test | t
    return paths.where(test)


def mentioned(texts: DataFrame, text: str, probes: DataFrame, probe: str) -> DataFrame:
    """The probes that some text contains, as one column `probe`."""
    return matching.contained(texts, text, probes, probe)


def overlapping(controls: DataFrame, key: str, entry_points: str, files: DataFrame, file: str) -> DataFrame:
    """controls with file_overlap: an entry point and a mentioned file contain one another, slashes and case put aside."""
    plain = lambda c: F.lower(T.posix(F.col(c)))
    points = controls.select(key, F.explode(entry_points).alias("_point")).withColumn("_point", plain("_point")).where("_point <> ''").distinct()
    named = files.select(plain(file).alias("_file")).where("_file <> ''").distinct()
    inside = matching.contained(named, "_file", points, "_point").withColumnRenamed("probe", "_point")
    hit = points.join(inside, "_point", "left_semi").select(key)
    # the other way round: files that stand in an entry point; an entry point is as short as a path
    held = matching.contained_in(points.select("_point"), "_point", named, "_file").select(F.col("text").alias("_point")).distinct()
    hit = hit.unionByName(points.join(held, "_point", "left_semi").select(key)).distinct()
    return controls.join(hit.withColumn("_hit", F.lit(True)), key, "left").withColumn("file_overlap", F.coalesce("_hit", F.lit(False))).drop("_hit")


def violations(df: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """(key, rule) for every broken rule; a rule is a condition that must hold, null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return df.select(*key, F.explode(broken).alias("rule"))


def missing_fields(df: DataFrame, fields: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(~present(F.col(c)), F.lit(c)) for c in fields]))


def broken_dependency(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """Determinants with several dependents: (determinant, n_values). Distinct pairs first, so hot keys stay small."""
    pairs = df.select(determinant, dependent).distinct()
    return pairs.groupBy(determinant).agg(F.count(F.lit(1)).alias("n_values")).where("n_values > 1")


def wrong_kind(df: DataFrame, category: str = "category", kind: str = "kind") -> Column:
    """Category and kind disagree with the registry."""
    return ~F.col(kind).eqNullSafe(R.mapped(R.CATEGORY_KINDS, R.normal_category(F.col(category))))


def repeated_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def outside_registry(df: DataFrame, column: str, allowed: DataFrame, name: str) -> DataFrame:
    """Values that the closed set does not hold."""
    return df.select(column).distinct().join(allowed.select(F.col(name).alias(column)), column, "left_anti")


def changed_outside(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Paths whose text outside the managed block has another hash than in the snapshot."""
    return current.alias("c").join(snapshot.alias("s"), "path").where(~F.col("c.outside_sha").eqNullSafe(F.col("s.outside_sha"))).select("path")
