"""Lines, structural spans and lookups in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines_of(docs: DataFrame, key: str, text: str = "text", *carry: str) -> DataFrame:
    """(key, line_no, line), 1-based."""
    return docs.select(key, *carry, F.posexplode(F.split(text, "\n", -1)).alias("_p", "line")).select(key, *carry, (F.col("_p") + 1).alias("line_no"), "line")


def node_spans(heads: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """heads (key, line_no, name) with line_end: the line before the next head, or the last line.

    A window per document: bounded by the document's own lines.
    """
    following = F.lead("line_no").over(Window.partitionBy(key).orderBy("line_no"))
    joined = heads.withColumn("_next", following).join(sizes, key)
    return joined.withColumn("line_end", F.greatest(F.col("line_no"), F.coalesce(F.col("_next"), F.col("n_lines") + 1) - 1)).drop("_next")


def enclosing(points: DataFrame, heads: DataFrame, key: str, at: str = "line_no", name: str = "name") -> DataFrame:
    """Backward as-of join: each point with the last head at or before it in the same key.

    Both sides are put together and the last name is carried along: one shuffle
    by key, and no range join.
    """
    columns = points.columns
    left = points.select(F.struct(*columns).alias("_row"), key, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(heads.schema[name].dataType).alias("_name"), F.lit(None).cast(heads.schema[at].dataType).alias("_head"))
    right = heads.select(F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), key, F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.col(name).alias("_name"), F.col(at).alias("_head"))
    so_far = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn(f"enclosing_{name}", F.last("_name", True).over(so_far)).withColumn("enclosing_line", F.last("_head", True).over(so_far))
    return both.where("_kind = 1").select("_row.*", f"enclosing_{name}", "enclosing_line")


def asof(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """As enclosing(), for any ordered column; returns left's columns and the last value."""
    return enclosing(left, right.select(key, at, F.col(value).alias("value")), key, at, "value").drop("enclosing_line")


def slice_for_line(probes: DataFrame, spans: DataFrame, key: str, window: int = 40) -> DataFrame:
    """The smallest span that holds a probed line (the last on ties), widened by a quarter window; else half a window around it.

    probes (key, probe), spans (key, line_no, line_end, n_lines). The join is by
    key with a range condition, so it is bounded by a document's spans.
    """
    fits = F.col("probe").between(F.col("line_no"), F.col("line_end"))
    joined = probes.join(spans.select(key, "line_no", "line_end", "name"), [key]).where(fits)
    best = joined.groupBy(key, "probe").agg(F.min_by(F.struct("line_no", "line_end", "name"), F.struct("line_end", (-F.col("line_no")).alias("s"))).alias("b"))
    sizes = spans.select(key, "n_lines").distinct()
    quarter, half = window // 4, window // 2
    out = probes.join(best, [key, "probe"], "left").join(sizes, key)
    start = F.when(F.col("b").isNotNull(), F.col("b.line_no") - quarter).otherwise(F.col("probe") - half)
    end = F.when(F.col("b").isNotNull(), F.col("b.line_end") + quarter).otherwise(F.col("probe") + half)
    return out.select(key, "probe", F.col("b.name").alias("name"), F.greatest(F.lit(1), start).cast("long").alias("slice_start"), F.least(F.col("n_lines"), end).cast("long").alias("slice_end"))


def sections(lines: DataFrame, key: str, head: Column, title: Column) -> DataFrame:
    """lines with section_no (0 before the first head) and section_title, by running counts."""
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section_no", F.sum(head.cast("int")).over(so_far)).withColumn("section_title", F.last(F.when(head, title), True).over(so_far))


def section_texts(sectioned: DataFrame, key: str) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return sectioned.groupBy(key, "section_no").agg(F.first("section_title", True).alias("section_title"), body.alias("body"))


def requirement_blocks(lines: DataFrame, key: str) -> DataFrame:
    """Requirement blocks inside ADDED or MODIFIED sections; any level-2 heading closes a section."""
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    level2 = F.col("line").rlike(r"^##[ \t]")
    opens = F.col("line").rlike(r"^##[ \t]+(ADDED|MODIFIED)[ \t]+Requirements[ \t]*$")
    head = F.col("line").rlike(r"^###[ \t]+Requirement:")
    state = lines.withColumn("_open", F.last(F.when(level2, opens), True).over(so_far)).withColumn("_req", F.sum((head | level2).cast("int")).over(so_far))
    inside = state.where("_open").withColumn("_head", F.when(head, F.trim(F.regexp_extract("line", r"^###[ \t]+Requirement:(.*)$", 1))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_head").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    return inside.groupBy(key, "_req").agg(F.max("_head").alias("heading"), body.alias("body")).where("heading IS NOT NULL").drop("_req")


def outside_fences(lines: DataFrame, key: str) -> DataFrame:
    """Lines with in_fence: between ``` or ~~~ marks, indented or not; the marks themselves are left out."""
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    return lines.withColumn("in_fence", F.sum(fence.cast("int")).over(so_far) % 2 == 1).where(~fence)


def without_blocks(lines: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """Lines outside begin...end blocks; an unterminated block takes the rest along.

    A line is inside when, up to it, the last mark was a begin; blocks are counted.
    """
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = F.trim("line") == begin, F.trim("line") == end
    state = F.last(F.when(opens, True).when(closes, False), True).over(so_far)
    return lines.withColumn("_inside", F.coalesce(state, F.lit(False)) | closes).where("NOT _inside").drop("_inside")


def prefix_sections(text: Column, level: int = 2) -> Column:
    """Texts between headings of up to this level, in order, as an array (for short texts)."""
    return F.split(text, r"(?m)^(?=#{1," + str(level) + r"}[ \t])")
