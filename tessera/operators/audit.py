"""Rules over nested JSON values, with the place of every violation, and the place of what does not parse.

A rule stands at a level: the lists that are opened one inside the other to reach
its objects. Each level is opened once, by Spark's variant_explode, for all its
rules, so rows grow with the elements that are looked at and no document passes
through Python unless it does not parse.

Defined cases: a null text is a violation of its own (`no text`), as is one that is
no JSON (`malformed JSON`); an element that is no object has one violation, `not an
object`, instead of those of its fields; a list that is missing or no list has no
elements (say so by a rule of the level above). Empty means what a reader would take
for nothing: null, false, 0, "", [] and {}.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registry as R
from . import describe

NEARBY = 40
Test = Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    """What the field at a dotted path of each element of a level must be."""

    level: tuple[str, ...]
    field: str
    test: Test
    issue: str


def filled(value: Column) -> Column:
    return ~F.coalesce(F.to_json(value), F.lit("null")).isin("null", "false", '""', "[]", "{}", "0", "0.0", "-0.0", "-0")


def text_of(value: Column) -> Column:
    return F.when(describe.kind(value) == "str", F.try_variant_get(value, "$", "string"))


def one_of(*values: str) -> Test:
    return lambda v: text_of(v).isin(*values)


def not_blank(value: Column) -> Column:
    return F.trim(text_of(value)) != ""


def of_kind(*kinds: str, empty: bool = True) -> Test:
    return lambda v: describe.kind(v).isin(*kinds) & (F.lit(empty) | filled(v))


def known_category(value: Column) -> Column:
    return R.normal_category(text_of(value)).isin(*R.CATEGORY_PATTERNS)


#: A report of findings, and candidates of a reading stage.
REPORT_RULES = (
    Rule((), "version", one_of("2.1.0"), "wrong version"),
    Rule((), "runs", of_kind("list", empty=False), "runs missing or empty"),
    Rule(("runs",), "tool.driver.name", not_blank, "missing tool.driver.name"),
    Rule(("runs",), "invocations", of_kind("list", empty=False), "missing invocations[]"),
    Rule(("runs", "results"), "ruleId", filled, "missing ruleId"),
    Rule(("runs", "results"), "locations", filled, "missing locations"),
)
CANDIDATE_RULES = (
    Rule((), "candidates", of_kind("list"), "not a wrapper"),
    Rule(("candidates",), "source", one_of("scout"), "source must be 'scout'"),
    Rule(("candidates",), "file", filled, "missing file"),
    Rule(("candidates",), "line", filled, "missing line"),
    Rule(("candidates",), "category", filled, "missing category"),
    Rule(("candidates",), "category", lambda v: ~filled(v) | known_category(v), "category not in the registry"),
)


def _open(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The elements of a list of each row's value, with their places."""
    held = rows.select(key, "_at", F.try_variant_get("_v", "$['" + name.replace("'", "\\'") + "']", "variant").alias("_list")).where(describe.kind(F.col("_list")) == "list")
    opened = held.lateralJoin(held.sparkSession.tvf.variant_explode(F.col("_list").outer()))
    return opened.select(key, F.concat("_at", F.lit(f".{name}["), F.col("pos").cast("string"), F.lit("]")).alias("_at"), F.col("value").alias("_v"))


def violations(docs: DataFrame, key: str, text: str, rules: Sequence[Rule]) -> DataFrame:
    """(key, place, issue): places are JSON paths from $."""
    values = docs.select(key, F.col(text).alias("_text"), F.lit("$").alias("_at"), describe.parsed_whole(F.col(text)).alias("_v"))
    broken = F.when(F.col("_text").isNull(), "no text").when(F.col("_v").isNull(), "malformed JSON")
    out = values.where("_v IS NULL").select(key, F.col("_at").alias("place"), broken.alias("issue"))
    levels = {(): values.where("_v IS NOT NULL").select(key, "_at", "_v")}
    for rule in rules:
        for n in range(1, len(rule.level) + 1):
            if rule.level[:n] not in levels:
                levels[rule.level[:n]] = _open(levels[rule.level[: n - 1]], key, rule.level[n - 1])
    for level, rows in levels.items():
        own = [r for r in rules if r.level == level]
        failed = [F.when(~F.coalesce(r.test(describe.navigate(F.col("_v"), r.field)), F.lit(False)), F.struct(F.concat("_at", F.lit(f".{r.field}")).alias("place"), F.lit(r.issue).alias("issue"))) for r in own]
        shape = F.array(F.struct(F.col("_at").alias("place"), F.lit("not an object").alias("issue")))
        found = F.when(F.coalesce(describe.kind(F.col("_v")) == "dict", F.lit(False)), F.array_compact(F.array(*failed)) if failed else F.array().cast("array<struct<place:string,issue:string>>")).otherwise(shape)
        out = out.unionByName(rows.select(key, F.explode(found).alias("f")).select(key, "f.place", "f.issue"))
    return out


def parse_errors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, col, message, nearby) of the texts that are no JSON: 1-based place, and the text around it on one line."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, body in zip(batch["k"], batch["body"], strict=True):
                try:
                    json.loads(body)
                except json.JSONDecodeError as x:
                    around = body[max(0, x.pos - NEARBY) : x.pos + NEARBY]
                    rows.append((k, x.lineno, x.colno, x.msg, around.replace("\r", "\\r").replace("\n", "\\n")))
                except RecursionError:
                    rows.append((k, 1, 1, "nested too deeply", body[:NEARBY]))
            yield pd.DataFrame(rows, columns=[key, "line", "col", "message", "nearby"])

    kind = docs.schema[key].dataType.simpleString()
    broken = docs.where(F.col(text).isNotNull() & describe.parsed_whole(F.col(text)).isNull())  # only these reach Python
    return broken.select(F.col(key).alias("k"), F.col(text).alias("body")).mapInPandas(find, f"{key} {kind}, line int, col int, message string, nearby string")
