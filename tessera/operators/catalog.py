"""Focus specifications, sensitive-data policy and masking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registry as R


def focus(dimensions: Column, facets: Column | None = None) -> Column:
    """Known dimensions in registry order; null where all are named without facets (no narrowing)."""
    own = F.filter(F.array(*[F.lit(d) for d in R.DIMENSIONS]), lambda d: F.array_contains(dimensions, d))
    everything = F.size(own) == len(R.DIMENSIONS)
    return F.when(everything & (F.lit(True) if facets is None else (F.size(facets) == 0)), F.lit(None)).otherwise(own)


def unknown_dimensions(dimensions: Column) -> Column:
    return F.array_except(dimensions, F.array(*[F.lit(d) for d in R.DIMENSIONS]))


def directive(dimensions: Column) -> Column:
    """The sentence that states a focus."""
    return F.when(dimensions.isNotNull(), F.concat(F.lit("Review only: "), F.array_join(dimensions, ", "), F.lit(".")))


def in_focus(hits: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Hits of categories that belong to one of the dimensions, with those dimensions."""
    per = F.create_map(*[x for c, ds in R.CATEGORY_DIMENSIONS.items() for x in (F.lit(c), F.array(*[F.lit(d) for d in ds]))])
    wanted = F.array(*[F.lit(d) for d in dimensions])
    return hits.withColumn("dimensions", F.array_intersect(F.try_element_at(per, F.col("category")), wanted)).where(F.size("dimensions") > 0)


def policy_rows(items: Column) -> Column:
    """Entries {key: {label, mask, rule}} of a policy map as rows (key, category, label, mask, rule)."""
    return F.transform(F.map_entries(items), lambda e: F.struct(e["key"].alias("key"), F.substring_index(e["key"], "/", 1).alias("category"), e["value"]["label"].alias("label"), e["value"]["mask"].alias("mask"), e["value"]["rule"].alias("rule")))


def policy_counts(policy: DataFrame) -> DataFrame:
    """Items per category and mask level, to be reconciled with stored counts."""
    return policy.groupBy("category").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("mask") == "full").alias("n_full"), F.count_if(F.col("mask") == "partial").alias("n_partial"))


#: Shapes of sensitive values and what is shown of them. Applied in order.
MASKS: Mapping[str, tuple[str, str]] = {
    "email": (r"([A-Za-z0-9._]+)@([A-Za-z0-9-]+[.][A-Za-z0-9.]+)", "***@$2"),
    "card": (r"([0-9]{9,12})([0-9]{4})", "****$2"),
    "key": (r"[0-9a-f]{28,60}([0-9a-f]{4})", "****$1"),
}


def masked(text: Column, masks: Mapping[str, tuple[str, str]] = MASKS) -> Column:
    out = text
    for pattern, shown in masks.values():
        out = F.regexp_replace(out, pattern, shown)
    return out


def mask_counts(text: Column, masks: Mapping[str, tuple[str, str]] = MASKS) -> dict[str, Column]:
    return {f"n_{name}": F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)) for name, (pattern, _) in masks.items()}
