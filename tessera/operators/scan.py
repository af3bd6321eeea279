"""Pattern scans over texts and lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import text as T


def any_of(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def pattern_hits(docs: DataFrame, key: str, text: str = "text", rows: Sequence[tuple] | None = None) -> DataFrame:
    """(key, category, cat_ord, pat_ord, shape, confidence, pos, token) of every match of every pattern.

    Patterns are literals, so each is compiled once per task; a pattern with a
    literal part looks only at texts that contain it, and the matches of all
    patterns leave the row together: one pass, no join, no shuffle.
    """
    rows = R.pattern_rows() if rows is None else rows
    own = [_tagged(F.col(text), category, i, j, pattern, shape, confidence) for category, i, j, pattern, shape, confidence in rows]
    return docs.select(key, F.explode(F.concat(*own)).alias("h")).select(key, "h.*")


def _tagged(text: Column, category: str, cat_ord: int, pat_ord: int, pattern: str, shape: str, confidence: float) -> Column:
    def one(token: Column, pos: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(cat_ord).alias("cat_ord"), F.lit(pat_ord).alias("pat_ord"), F.lit(shape).alias("shape"), F.lit(confidence).alias("confidence"), pos.alias("pos"), token.alias("token"))

    literal, form = R.PATTERN_GATES.get(pattern, ("", pattern))
    found = T.found(text, form)
    return F.transform(F.when(text.contains(literal), found).otherwise(F.array().cast("array<string>")) if literal else found, one)


def line_terms(lines: DataFrame, key: str, terms: Sequence[str]) -> DataFrame:
    """(key, line_no, term) where a line holds a term: the terms are literals inside the row."""
    own = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower("line"), t))
    return lines.where(F.lower("line").rlike(any_of([t.replace(".", "[.]") for t in terms]))).select(key, "line_no", F.explode(own).alias("term"))


def allowed_only(hits: DataFrame, allowed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Hits that no allow-list row covers."""
    return hits.join(allowed, list(on), "left_anti")


def skeleton(files: DataFrame, key: str, text: str, name_pattern: str, link_pattern: str, limit: int = 64) -> DataFrame:
    """Per file: names and links, ordered-distinct and capped lists (the cap is the skeleton's feature), and sizes."""
    return files.select(
        key,
        T.ordered_distinct(T.found(F.col(text), name_pattern, 1), limit).alias("names"),
        T.ordered_distinct(T.found(F.col(text), link_pattern, 1), limit).alias("links"),
        F.octet_length(text).alias("bytes"),
    )
