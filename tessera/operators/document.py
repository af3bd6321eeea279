"""One nested JSON report of any size: ordered lines, written as parts that are one document when put together.

Head, rules, results and foot are rows of one table with an ordinal; elements of a
list but the first start with a comma. Rules and results are numbered without a
task that sees them all, rows are dealt in ranges of the ordinal before their
lines are made, and the parts' names sort as their lines do: no task or driver
holds the report, and no line is shuffled.

Defined cases: no findings give a report with empty lists; columns that findings
lack are null; a blank weakness is `CWE-Other`; a severity that is unknown is a note.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import registry as R
from ..functions import scoring
from ..sources.staging import with_ordinal

# Schema and version of the report, and levels of severities.
SCHEMA, VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"
LEVELS = {"Critical": "error", "High": "error", "Medium": "warning", "Low": "note", "Info": "none"}
OPTIONAL = {"title": "string", "impact": "string", "vuln_class": "string", "cvss_score": "double", "cvss_vector": "string", "confidence": "double", "severity": "string", "source_ref": "string", "sink_ref": "string", "file": "string"}
PART_LINES = 200_000
_NULLS = {"ignoreNullFields": "false"}


def _weakness() -> Column:
    return F.coalesce(F.nullif(F.btrim("cwe", F.lit(" \t\r\n\f\x0b")), F.lit("")), F.lit("CWE-Other"))


def _rule_id(cwe: Column) -> Column:
    return F.replace(cwe, F.lit("CWE-"), F.lit("cwe-"))


def rule_json(cwe: Column) -> Column:
    text = F.coalesce(R.mapped(R.CWE_NAMES, cwe), cwe)
    tags = F.struct(F.array(F.lit("security"), F.lower(cwe)).alias("tags"), F.lit("medium").alias("precision"))
    return F.to_json(F.struct(_rule_id(cwe).alias("id"), cwe.alias("name"), F.struct(text.alias("text")).alias("shortDescription"), tags.alias("properties")), _NULLS)


def _place() -> tuple[Column, Column]:
    """File and line of a finding: its source reference, or its file where that names no path."""
    ref = F.coalesce(F.nullif("source_ref", F.lit("")), F.col("file"), F.lit(""))
    at = scoring.location(ref)
    named = F.contains(at["file"], F.lit("/")) | F.contains(at["file"], F.lit("\\"))
    return F.when(named, at["file"]).otherwise(F.coalesce(F.nullif("file", F.lit("")), at["file"])), F.coalesce(at["line"], F.lit(1))


def result_json(uri: Column, line: Column) -> Column:
    cwe = F.col("cwe")
    level = F.coalesce(R.mapped(LEVELS, F.col("severity")), F.lit("note"))
    where = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.lit(1), line).alias("startLine")).alias("region")).alias("physicalLocation"))
    mark = F.concat_ws(":", uri, line.cast("string"), F.coalesce("vuln_class", F.lit("")))
    properties = F.struct("severity", F.struct(F.col("cvss_score").alias("score"), F.col("cvss_vector").alias("vector")).alias("cvss"), cwe.alias("cwe"), "confidence", "source_ref", "sink_ref")
    message = F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("impact", F.lit("")))
    return F.to_json(F.struct(_rule_id(cwe).alias("ruleId"), level.alias("level"), F.struct(message.alias("text")).alias("message"), F.array(where).alias("locations"), F.struct(mark.alias("primaryLocationLineHash")).alias("partialFingerprints"), properties.alias("properties")), _NULLS)


def report_rows(findings: DataFrame, order: list[str], *, tool: str, application: str = "", repository: str = "") -> DataFrame:
    """(part, n, fixed) and the columns that lines are made of, in the order of (part, n); rules by first finding, results in order."""
    spark = findings.sparkSession
    for name, kind in OPTIONAL.items():
        if name not in findings.columns:
            findings = findings.withColumn(name, F.lit(None).cast(kind))
    placed = with_ordinal(findings.select("cwe", *OPTIONAL, *[c for c in order if c not in ("cwe", *OPTIONAL)]), *order, name="_n")
    firsts = placed.groupBy(_weakness().alias("cwe")).agg(F.min("_n").alias("_first"))
    rules = with_ordinal(firsts, "_first", name="n").select(F.lit(1).alias("part"), "n", "cwe")
    results = placed.select(F.lit(3).alias("part"), F.col("_n").alias("n"), "cwe", *OPTIONAL)
    head = '{"$schema":%s,"version":%s,"runs":[{"tool":{"driver":{"name":%s,"rules":[' % tuple(map(json.dumps, (SCHEMA, VERSION, tool)))
    between = ']}},"invocations":[{"executionSuccessful":true}],"results":['
    foot = '],"properties":{"applicationId":%s,"repositoryName":%s}}]}' % (json.dumps(application), json.dumps(repository))
    frame = spark.createDataFrame([(0, 1, head), (2, 1, between), (4, 1, foot)], "part int, n long, fixed string")
    return frame.unionByName(rules, allowMissingColumns=True).unionByName(results, allowMissingColumns=True)


def lines_of(rows: DataFrame) -> DataFrame:
    """(part, n, line) of report_rows()."""
    # weakness and place are columns of their own, else each use inside a condition makes them again
    uri, line = _place()
    placed = rows.withColumn("cwe", _weakness()).withColumn("_uri", uri).withColumn("_line", line)
    own = F.when(F.col("part") == 1, rule_json(F.col("cwe"))).when(F.col("part") == 3, result_json(F.col("_uri"), F.col("_line")))
    return placed.select("part", "n", F.when(F.col("part").isin(1, 3), F.concat(F.when(F.col("n") > 1, F.lit(",")).otherwise(F.lit("")), own)).otherwise(F.col("fixed")).alias("line"))


def report_lines(findings: DataFrame, order: list[str], *, tool: str, application: str = "", repository: str = "") -> DataFrame:
    """(part, n, line): the report's lines in the order of (part, n)."""
    return lines_of(report_rows(findings, order, tool=tool, application=application, repository=repository))


def write_document(lines: DataFrame, path: str, part_lines: int = PART_LINES, made: Callable[[DataFrame], DataFrame] | None = None, compression: str | None = None) -> None:
    """The lines as text files whose names sort as their lines do.

    With `made`, rows are handed over without their lines, which it makes behind the shuffle.
    Compressed by gzip, the parts put together are one gzip file.
    """
    n = max(1, -(-lines.count() // part_lines))
    dealt = lines.repartitionByRange(n, "part", "n").sortWithinPartitions("part", "n")
    (made(dealt) if made else dealt).select(F.col("line").alias("value")).write.mode("overwrite").option("compression", compression or "none").text(path)


def document_parts(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes) of a written document; put together in the order of the names they are the document."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


@F.pandas_udf(LongType())
def _rows_before(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Number of rows before a row in its block; a task reads its blocks one after another."""
    last, n = None, 0
    for own in blocks:
        run = own.ne(own.shift(fill_value=last)).cumsum()  # 0: the block that the batch before ended in
        at = own.groupby(run).cumcount() + (run == 0) * n
        if len(own):
            last, n = own.iloc[-1], int(at.iloc[-1]) + 1
        yield at


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, n, line) of a written document: the parts' names and places that rise along each part.

    A line takes a byte at least, so the place in a block behind the block's start
    rises; a compressed part is one block, whose places are 0, 1, 2 ...
    """
    lines = spark.read.text(path, wholetext=False).select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("_at"), F.col("value").alias("line"))
    place = _rows_before.asNondeterministic()(F.xxhash64("name", "_at"))
    return lines.select("name", (F.col("_at") + place).alias("n"), "line")
