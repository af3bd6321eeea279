"""CVSS 3.1 base scores and severity bands as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import registry as R


def metrics(vector: Column) -> Column:
    """The vector's key:value pairs as a map."""
    return F.str_to_map(F.regexp_replace(vector, r"^CVSS:[^/]*/", ""), F.lit("/"), F.lit(":"))


def round_up(x: Column) -> Column:
    """To one decimal, upwards, on whole hundred-thousandths."""
    units = F.bround(x * 100000).cast("long")
    return F.when(units % 10000 == 0, units / 100000.0).otherwise((F.floor(units / 10000) + 1) / 10.0)


def base_score(vector: Column) -> Column:
    """Null when one of the eight metrics is missing or has an unknown letter."""
    m = metrics(vector)
    of = lambda table, key: R.mapped(R.CVSS[table], F.try_element_at(m, F.lit(key)))
    changed = F.try_element_at(m, F.lit("S")) == "C"
    scope = F.when(F.try_element_at(m, F.lit("S")).isin("C", "U"), F.lit(True))
    pr = F.when(changed, of("PR_C", "PR")).otherwise(of("PR_U", "PR"))
    iss = 1 - (1 - of("CIA", "C")) * (1 - of("CIA", "I")) * (1 - of("CIA", "A"))
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15))).otherwise(6.42 * iss)
    exploit = 8.22 * of("AV", "AV") * of("AC", "AC") * pr * of("UI", "UI")
    total = F.when(changed, 1.08 * (impact + exploit)).otherwise(impact + exploit)
    score = F.when(impact <= 0, F.lit(0.0)).otherwise(round_up(F.least(total, F.lit(10.0))))
    return F.when(scope & exploit.isNotNull() & iss.isNotNull(), score)


def severity(score: Column) -> Column:
    return (
        F.when(score.isNull() | (score == 0), "Info")
        .when(score < 4.0, "Low")
        .when(score < 7.0, "Medium")
        .when(score < 9.0, "High")
        .otherwise("Critical")
    )


def enriched_score(vector: Column, previous: Column) -> Column:
    return F.coalesce(base_score(vector), previous)


def location(ref: Column) -> Column:
    """{file, line} of "file:line", read from the right; line is null without digits."""
    line = F.nullif(F.regexp_extract(ref, r":([0-9]+)$", 1), F.lit("")).cast("int")
    return F.struct(F.when(line.isNotNull(), F.regexp_extract(ref, r"^(.*):[0-9]+$", 1)).otherwise(ref).alias("file"), line.alias("line"))
