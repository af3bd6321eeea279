"""Keyed dedup of findings, title similarity, clusters of hits, positional ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import text as T


def bucket_key(window: int = 5) -> list[Column]:
    """File, weakness and line bucket; a missing line and the first lines share bucket 0."""
    line = F.coalesce(F.col("line_start"), F.lit(0))
    return [
        F.lower(T.posix(F.coalesce("file", F.lit("")))).alias("file_key"),
        F.trim(F.upper(F.coalesce("cwe", F.lit("")))).alias("cwe_key"),
        F.when(line > 0, F.floor(line / max(1, window))).otherwise(F.lit(0)).cast("long").alias("bucket"),
    ]


def deduped(findings: DataFrame, order: Sequence[Column | str], window: int = 5) -> DataFrame:
    """One canonical finding per key, of highest confidence (first in order on ties), with n_duplicates.

    The first row of each key is taken in every task before the shuffle (a limit
    on row_number), and counts are partial sums, so a hot key is one row per task.
    """
    key = ["file_key", "cwe_key", "bucket"]
    keyed = findings.select("*", *bucket_key(window))
    ranked = Window.partitionBy(*key).orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), *order)
    best = keyed.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")
    counts = keyed.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("n_duplicates"))
    return best.join(counts, key).select(*findings.columns, *key, "n_duplicates")


def by_confidence(findings: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The findings as a report lists them: most certain first."""
    return findings.orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), *order)


def would_merge(findings: DataFrame, order: Sequence[Column | str], window: int = 5) -> DataFrame:
    """Keys that still hold several findings: rows of a deduplicated table that is not final."""
    return findings.select(*bucket_key(window)).groupBy("file_key", "cwe_key", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def with_duplicates(findings: DataFrame, order: Sequence[Column | str], window: int = 5, fields: Sequence[str] = ("id", "title", "file", "line_start"), columns: Sequence[str] | None = None) -> DataFrame:
    """As deduped(), with the folded findings as duplicates[{id, title, file, line_start}] in order; null without any.

    A key's findings meet once, in a list whose first entry is the canonical one;
    entries hold what `columns` of it (all by default) and `fields` of the others ask for.
    """
    columns = findings.columns if columns is None else columns
    ranks = {o if isinstance(o, str) else f"_o{i}": o for i, o in enumerate(order)}
    rest = [c for c in dict.fromkeys([*fields, *columns]) if c not in ranks]
    rank = [(F.col(o) if isinstance(o, str) else o).alias(name) for name, o in ranks.items()]
    entry = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("_c"), *rank, *rest)
    key = ["file_key", "cwe_key", "bucket"]
    folded = findings.select(entry.alias("_entry"), *bucket_key(window)).groupBy(*key).agg(F.sort_array(F.collect_list("_entry")).alias("_all"))
    others = F.transform(F.slice("_all", 2, F.size("_all")), lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    best = F.col("_all")[0]
    return folded.select(*[best[c].alias(c) for c in columns], F.when(F.size("_all") > 1, others).alias("duplicates"))


def title_tokens(title: Column) -> Column:
    words = F.transform(T.found(title, "[A-Za-z][A-Za-z0-9_]+"), lambda w: F.lower(w))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in R.STOP_WORDS]))


def jaccard(a: Column, b: Column) -> Column:
    """0 where either side is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def site_clusters(hits: DataFrame, sample: int = 8) -> DataFrame:
    """Hits by site (centralised shapes) or by token (distributed ones); ids end in a SHA-1 prefix of the key.

    hits: category, shape, file, anchor, token, hit_id. Members are counted in
    full; usage sites are the first `sample` files in order, cut in every task
    before the shuffle, so a token of all files is never one row.
    """
    site = F.concat_ws("::", "category", F.coalesce("anchor", "file"), "file")
    spread = F.concat_ws("::", "category", "token")
    key = ["category", "shape", "cluster_key"]
    keyed = hits.withColumn("cluster_key", F.when(F.col("shape") == "distributed", spread).otherwise(site))
    files = keyed.groupBy(*key, "file").agg(F.count(F.lit(1)).alias("n"))
    counts = files.groupBy(*key).agg(F.sum("n").alias("n_hits"), F.count(F.lit(1)).alias("n_files"), F.min("file").alias("first_file"))
    first = files.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("file"))).where(F.col("_n") <= sample)
    sites = first.groupBy(*key).agg(F.array_sort(F.collect_list("file")).alias("usage_sites"))
    return (
        counts.join(sites, key)
        .withColumn("cluster_id", F.concat_ws("::", "category", T.short_sha(F.col("cluster_key"), 8)))
        .withColumn("kind", R.mapped(R.CATEGORY_KINDS, F.col("category")))
    )


def suffixed_ids(df: DataFrame, base: str, order: Sequence[Column | str], name: str = "unit_id") -> DataFrame:
    """base, base-2, base-3 ... in order: one window per base, whose rows are sorted in one task."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return df.withColumn("_n", n).withColumn(name, F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat_ws("-", base, F.col("_n").cast("string")))).drop("_n")


def keyed_append(known: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """New rows whose key (nulls equal) is not known, the first of each key; categories are resolved before the key."""
    resolved = new.withColumn("category", R.normal_category(F.col("category"))).where("category IS NOT NULL")
    have = known.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).distinct()
    match = F.lit(True)
    for i, k in enumerate(key):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    fresh = resolved.join(have, match, "left_anti")
    own = F.struct(*[F.col(f"`{c}`") for c in resolved.columns])
    return fresh.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(key)]).agg(F.min_by(own, F.struct(*order)).alias("r")).select("r.*")
