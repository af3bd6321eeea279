"""Managed blocks of texts, put together from drafts in order, and their placement.

A block is one text per unit; its lines are joined in the order of the drafts and
of their own places. Lines of a unit are joined by parts of PART of them first, so
that a unit of many drafts is joined from few texts.

Defined cases: a draft without requirements gives a block of its two marks; blank
headings get a default, blank bodies and blank tasks no line; a text without a block
gets one behind its section, or at its end after an empty line; placing a block
again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DRAFT = "struct<capability:string,gaps:array<struct<dimension:string>>,security_requirements:array<struct<heading:string,body:string>>,security_tasks:array<string>>"
HEADING = "Security requirement"
#: Heads of sections behind which a block of requirements goes.
SECTION = r"(?m)^##\s+(?:ADDED|MODIFIED)\s+Requirements\s*$"
PART = 10_000
_BLANK = " \t\n\r\f\x0b"


def parsed_drafts(drafts: DataFrame, text: str = "text") -> DataFrame:
    return drafts.withColumn("draft", F.from_json(text, DRAFT))


def requirements_block(draft: Column, begin: str, end: str, covered: tuple[str, str] = ("<!-- dimensions: ", " -->")) -> Column:
    """The block of one draft: covered dimensions in order, then each requirement under its heading."""
    dims = F.array_sort(F.array_distinct(F.filter(F.transform(draft["gaps"], lambda g: g["dimension"]), lambda d: F.coalesce(d, F.lit("")) != "")))
    head = F.when(F.size(dims) > 0, F.array(F.concat(F.lit(covered[0]), F.array_join(dims, ", "), F.lit(covered[1]))))
    title = lambda r: F.concat(F.lit("### Requirement: "), F.btrim(F.coalesce(r["heading"], F.lit(HEADING)), F.lit(_BLANK)))
    body = lambda r: F.btrim(F.coalesce(r["body"], F.lit("")), F.lit(_BLANK))
    each = F.transform(draft["security_requirements"], lambda r: F.concat(F.lit("\n"), title(r), F.when(body(r) != "", F.concat(F.lit("\n"), body(r))).otherwise("")))
    none = F.array().cast("array<string>")
    return F.concat(F.array_join(F.concat(F.array(F.lit(begin)), F.coalesce(head, none), F.coalesce(each, none), F.array(F.lit(end))), "\n"), F.lit("\n"))


def joined_lines(lines: DataFrame, unit: str, order: list[str], line: str, name: str = "text", part: int = PART) -> DataFrame:
    """(unit, text): each unit's lines in order, joined by line feeds; a unit is sorted once and joined in two steps."""
    numbered = lines.withColumn("_n", F.row_number().over(Window.partitionBy(unit).orderBy(*order)))
    parts = numbered.withColumn("_part", F.expr(f"_n div {part}")).groupBy(unit, "_part").agg(F.array_sort(F.collect_list(F.struct("_n", F.col(line).alias("_line")))).alias("_l"))
    texts = parts.select(unit, "_part", F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias("_text"))
    return texts.groupBy(unit).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "_text"))), lambda x: x["_text"]), "\n").alias(name))


def tasks_blocks(drafts: DataFrame, unit: str, order: str, begin: str, end: str) -> DataFrame:
    """(unit, block, n_tasks): the tasks of a unit's drafts as a list, in the drafts' order and their own."""
    tasks = drafts.select(unit, order, F.posexplode("draft.security_tasks").alias("_pos", "_task"))
    known = tasks.withColumn("_task", F.btrim(F.coalesce("_task", F.lit("")), F.lit(_BLANK))).where("_task <> ''")
    listed = known.withColumn("_line", F.when(F.startswith("_task", F.lit("- ")), F.col("_task")).otherwise(F.concat(F.lit("- "), "_task")))
    counts = listed.groupBy(unit).agg(F.count(F.lit(1)).alias("n_tasks"))
    return joined_lines(listed, unit, [order, "_pos"], "_line").join(counts, unit).select(unit, F.concat(F.lit(begin + "\n"), "text", F.lit("\n" + end + "\n")).alias("block"), "n_tasks")


def _held(text: Column, begin: str, end: str) -> tuple[Column, Column]:
    """Where a block starts, 0 if there is none, and where what follows it starts."""
    a = F.instr(text, begin)
    b = F.instr(F.substr(text, F.greatest(a, F.lit(1))), end)
    stop = a + b + len(end) - 1
    return F.when((a > 0) & (b > 0), a).otherwise(0), stop + F.when(F.substr(text, stop, F.lit(1)) == "\n", 1).otherwise(0)


def placed(text: Column, block: Column, begin: str, end: str, section: str | None = None) -> Column:
    """The text with its first block replaced; else the block goes behind the first head of a section, else to the end."""
    own = F.coalesce(text, F.lit(""))
    start, stop = _held(own, begin, end)
    out = F.when(start > 0, F.concat(F.left(own, start - 1), block, F.substr(own, stop)))
    if section is not None:
        head = F.regexp_extract(own, rf"(?ms)\A(.*?{section.removeprefix('(?m)')}[^\n]*\n?)", 1)
        out = out.when(head != "", F.concat(head, block, F.substr(own, F.length(head) + 1)))
    gap = F.when(own == "", "").when(F.endswith(own, F.lit("\n")), "\n").otherwise("\n\n")
    return out.otherwise(F.concat(own, gap, block))


def outside(text: Column, begin: str, end: str) -> Column:
    """The text without its first block, the line feed behind it included."""
    start, stop = _held(text, begin, end)
    return F.when(start > 0, F.concat(F.left(text, start - 1), F.substr(text, stop))).otherwise(text)


def block_faults(texts: DataFrame, key: str, text: str, begin: str, end: str, then: DataFrame) -> DataFrame:
    """(key, issue) against a snapshot (key, outside_sha): missing, several blocks, unpaired mark, changed outside."""
    met = then.select(key, F.col("outside_sha").alias("_was")).join(texts.select(key, F.col(text).alias("_t")), key, "left")
    n = lambda s: F.expr(f"(length(_t) - length(replace(_t, {_sql(s)}, ''))) div {len(s)}")
    issues = F.array_compact(
        F.array(
            F.when(F.col("_t").isNull(), "missing"),
            F.when(F.least(n(begin), n(end)) > 1, "several blocks"),
            F.when(F.contains("_t", F.lit(begin)) != F.contains("_t", F.lit(end)), "unpaired mark"),
            F.when(F.sha2(outside(F.col("_t"), begin, end), 256) != F.col("_was"), "changed outside"),
        )
    )
    return met.select(key, F.explode(issues).alias("issue"))


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
