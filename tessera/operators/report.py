"""Nested reports, roll-ups and managed blocks of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import scoring


def sarif_rules(findings: DataFrame, order: str) -> DataFrame:
    """Distinct rules in first-seen order: (rule_id, name, first_seen)."""
    rule = F.coalesce(F.nullif(F.trim(F.upper("cwe")), F.lit("")), F.lit("CWE-unknown"))
    return findings.select(rule.alias("rule_id"), order).groupBy("rule_id").agg(F.min(order).alias("first_seen")).withColumn("name", F.coalesce(R.mapped(R.CWE_NAMES, F.col("rule_id")), F.lit("Security finding")))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One JSON result per finding; a result file is these rows, so no report passes through one task."""
    level = F.when(F.col("severity").isin("Critical", "High"), "error").when(F.col("severity") == "Medium", "warning").otherwise("note")
    rule = F.coalesce(F.nullif(F.trim(F.upper("cwe")), F.lit("")), F.lit("CWE-unknown"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_start").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(
        rule.alias("ruleId"),
        level.alias("level"),
        F.struct(F.col("title").alias("text")).alias("message"),
        F.array(place).alias("locations"),
        F.struct(F.sha1(F.concat_ws("|", rule, "file", F.col("line_start").cast("string"))).alias("primary")).alias("partialFingerprints"),
        F.struct("severity", "confidence").alias("properties"),
    )
    return findings.select("id", rule.alias("rule_id"), level.alias("level"), F.to_json(result).alias("result"))


def severity_histogram(findings: DataFrame, score: Column) -> DataFrame:
    return findings.groupBy(scoring.severity(score).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def gap_rollup(gaps: DataFrame) -> DataFrame:
    """gaps (dimension, control, confirmed) per dimension: counts, confirmed and residual ones, distinct controls.

    `place` sorts alphabetically with "other" last.
    """
    named = F.coalesce(F.nullif("dimension", F.lit("")), F.lit("other"))
    out = gaps.groupBy(named.alias("dimension")).agg(
        F.count(F.lit(1)).alias("n_gaps"),
        F.count_if("confirmed").alias("n_confirmed"),
        F.count_if(~F.coalesce("confirmed", F.lit(False))).alias("n_residual"),
        F.count_distinct("control").alias("n_controls"),
    )
    return out.withColumn("place", F.concat(F.when(F.col("dimension") == "other", "1").otherwise("0"), "dimension"))


def unconfirmed(asked: DataFrame, memory: DataFrame, key: str = "fact_key") -> DataFrame:
    """Number of asked keys that memory lacks; a null key is never known."""
    return asked.join(memory.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("n_unconfirmed"))


def prefix_rollup(files: DataFrame, path: str, depth: int, *sums: str) -> DataFrame:
    """Sums by the first `depth` path segments."""
    prefix = F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")
    return files.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n_files"), *[F.sum(c).alias(c) for c in sums])


def outside_block(text: Column, begin: str, end: str) -> Column:
    """The text without its first managed block."""
    a = F.instr(text, begin)
    b = F.instr(F.substr(text, a), end)
    return F.when((a > 0) & (b > 0), F.concat(F.left(text, a - 1), F.substr(text, a + b + len(end) - 1))).otherwise(text)


def with_block(text: Column, body: Column, begin: str, end: str, after: str | None = None) -> Column:
    """The text with its managed block replaced; without one, put after a heading line or at the end."""
    block = F.concat(F.lit(begin + "\n"), body, F.lit("\n" + end))
    a = F.instr(text, begin)
    b = F.instr(F.substr(text, F.greatest(a, F.lit(1))), end)
    replaced = F.concat(F.left(text, a - 1), block, F.substr(text, a + b + len(end) - 1))
    appended = F.concat(F.rtrim(text, F.lit("\n")), F.lit("\n\n"), block, F.lit("\n"))
    out = F.when((a > 0) & (b > 0), replaced)
    if after is not None:
        h = F.instr(text, after + "\n")
        out = out.when(h > 0, F.concat(F.left(text, h + len(after)), F.lit("\n"), block, F.lit("\n"), F.substr(text, h + len(after) + 1)))
    return out.otherwise(appended)


def index_lines(rows: DataFrame, group: str, label: str, target: str) -> DataFrame:
    """One index text per group, sorted by label (an index entry per rule file, so groups are short)."""
    line = F.concat(F.lit("- ["), F.col(label), F.lit("]("), F.col(target), F.lit(")"))
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(label).alias("k"), line.alias("v")))), lambda x: x["v"]), "\n").alias("index_text"))
