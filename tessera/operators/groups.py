"""Layers, style families and groups of test-like texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import text as T

#: Families of a layer: the first needle that the text holds names it, "none" if none does.
FAMILIES = {
    "controller": ("WebMvcTest", "WebFluxTest", "SpringBootTest"),
    "service": ("MockitoExtension", "SpringBootTest"),
    "repository": ("DataJpaTest", "JdbcTest", "MybatisTest", "DataMongoTest"),
    "integration": ("Testcontainers", "SpringBootTest"),
    "config": ("TestConfiguration", "Configuration"),
}


def layer(text: Column, path: Column) -> Column:
    """The layer by what the text names, then by its directory, then by the end of its path."""
    has = lambda needles: T.contains_any(text, needles)
    rules = [(has(needles), F.lit(value)) for value, needles in R.LAYER_SIGNALS]
    rules += [(has(R.BOOT_TEST), F.when(has(R.FULL_STACK), "integration").when(has(("MockMvc",)), "controller").otherwise("service"))]
    rules += [(has(R.TEST_CONFIG), F.lit("config")), (has(R.SERVICE_MOCK), F.lit("service"))]
    out = F.when(*rules[0])
    for test, value in rules[1:]:
        out = out.when(test, value)
    hints = F.coalesce(T.first_of(T.directory(T.posix(path)), R.PACKAGE_HINTS), T.first_end(path, R.NAME_HINTS))
    some = F.when(has((*R.STATIC_MOCK, *R.PARAMETRIZED, "assertThat", "Assertions")), "util")
    return F.coalesce(out, hints, some, F.lit("other"))


def family(layer_: Column, text: Column) -> Column:
    style = F.lit("pure")
    for name, needles in reversed(R.UTIL_STYLES):
        style = F.when(T.contains_any(text, needles), name).otherwise(style)
    out = F.when(layer_ == "util", style)
    for name, needles in FAMILIES.items():
        out = out.when(layer_ == name, T.first_of(text, [(n, n) for n in needles], "none"))
    return out.otherwise("other")


def annotation(text: Column) -> Column:
    """The dominant test annotation of a text."""
    return T.first_of(text, [(n, n) for n in R.ANNOTATIONS], "none")


def is_test(text: Column) -> Column:
    """The text uses a test framework."""
    return T.contains_any(text, R.TEST_FRAMEWORKS)


def density(text: Column, asserts: Sequence[str], methods: Sequence[str]) -> Column:
    """Assertions per test method, half-even to two places; 0 without methods."""
    total = lambda needles: F.aggregate(F.array(*[F.lit(n) for n in needles]), F.lit(0), lambda n, x: n + ((F.length(text) - F.length(F.replace(text, x, F.lit("")))) / F.length(x)).cast("int"))
    return F.when(total(methods) > 0, F.bround(total(asserts) / total(methods), 2)).otherwise(F.lit(0.0))


def style_groups(files: DataFrame, threshold: float = 0.8) -> DataFrame:
    """files (member, layer, family, density) grouped by layer, and by family where none dominates.

    Counts per (layer, family) come first; windows run over that small table.
    Unclassified files (layer "other") are not grouped.
    """
    known = files.where("layer <> 'other'")
    per = known.groupBy("layer", "family").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("layer")
    share = per.withColumn("total", F.sum("n").over(whole)).withColumn("top", F.max("n").over(whole) / F.col("total"))
    uniform = share.select("layer", "family", (F.col("top") >= threshold).alias("uniform"))
    named = known.join(F.broadcast(uniform), ["layer", "family"]).withColumn("group_family", F.when(F.col("uniform"), F.lit("*")).otherwise(F.col("family")))
    return named.groupBy("layer", "group_family", "uniform").agg(F.count(F.lit(1)).alias("member_count"), F.bround(F.avg("density"), 2).alias("assert_density"), F.min("member").alias("first_member"))


def histogram(files: DataFrame, keys: Sequence[str], token: str) -> DataFrame:
    """(keys, token, n) rows, the long form of a group's token map."""
    return files.groupBy(*keys, token).agg(F.count(F.lit(1)).alias("n"))


def not_once(groups: DataFrame, group: str, member: str) -> DataFrame:
    """Members of several groups."""
    return groups.select(group, member).distinct().groupBy(member).agg(F.count(F.lit(1)).alias("n_groups")).where("n_groups > 1")
