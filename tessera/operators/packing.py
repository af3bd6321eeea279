"""Packing into batches under byte and count budgets, shards and pages."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged, with_ordinal

BLOCK_ROWS = 100_000
#: Tables of blocks that one task composes.
GROUP_BLOCKS = 16


def _following(sizes: np.ndarray, ends: np.ndarray, room: np.ndarray, count: int | None) -> np.ndarray:
    """For each row: where the next batch starts if one starts here; `ends` is where the row's group ends.

    An oversize row is a batch of its own.
    """
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(sizes))
    fits = np.searchsorted(total, total[:-1] + room, "right") - 1
    fits = np.minimum(fits, ends) if count is None else np.minimum(np.minimum(fits, ends), at + count)
    return np.maximum(at + 1, fits)


def _leaving(following: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first `own` rows: where the chain of batches from it leaves them, and how many batches start on the way."""
    n = int(max(own, following.max(initial=0))) + 1
    jump, steps = np.arange(n), np.zeros(n, np.int64)
    jump[:own], steps[:own] = following[:own], 1
    while (jump[:own] < own).any():  # twice as far each time; rows beyond stay where they are
        steps[:own] += steps[jump[:own]]
        jump = jump[jump]
    return jump[:own], steps[:own]


def _starts(following: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which rows start a batch, if batches start at the entries."""
    n = len(following)
    jump, found = np.append(np.minimum(following, n), n), np.zeros(n + 1, bool)
    found[entries] = True
    while True:
        more = found.copy()
        more[jump[found]] = True
        if (more == found).all():
            return found[:n]
        found, jump = more, jump[jump]


def segmented_next_fit(units: DataFrame, group: str, order: Sequence[Column | str], size: str, budget: int, *, header: str | None = None, count: int | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """Sequential next-fit inside every group, in parallel: adds ordinal (1-based in the group), shard_no and shard_start.

    A shard starts out with the group's header bytes and takes rows in order while
    it holds at most `budget` bytes (and `count` rows, if given); a row that does not
    fit opens the next one, and a row that fits nowhere stands alone.

    Groups of at most `block` rows are dealt out by hash, many to a task. A larger
    group is cut into blocks. A block is entered at one of its first rows, since no
    shard is longer than `reach` rows; its table says for every entry where it leaves
    the block (rows beyond the end are lent by the next one) and how many shards
    begin. Tables are composed GROUP_BLOCKS at a time until a group has one, and the
    real entries come back the same way. No task holds more than a block and the
    tables of GROUP_BLOCKS others.

    Defined cases: a null size or header is 0; without a count sizes below 1 are
    taken for 1, so that a shard's rows are bounded by the budget; a null group is a
    group of its own.
    """
    least = 0 if count else 1
    sized = units.withColumn("_size", F.greatest(F.lit(least), F.coalesce(F.col(size), F.lit(0))).cast("long")).withColumn("_header", (F.coalesce(F.col(header), F.lit(0)) if header else F.lit(0)).cast("long"))
    named = sized.withColumn("_group", F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("null")))
    placed = staged(with_ordinal(named, "_group", *order, name="_at"), "units")
    groups = staged(placed.groupBy("_group").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"), F.max("_header").alias("_held"), F.min("_size").alias("_smallest")), "groups")
    # the longest a shard can be in a group that is cut
    longest = groups.where(F.col("_rows") > block).agg(F.max(F.lit(budget) / F.greatest(F.col("_smallest"), F.lit(1)))).first()[0]
    reach = min(x for x in (count, int(longest or 1) + 1) if x is not None)
    block = max(block, reach + 1)
    slim = placed.select("_group", "_at", "_size").join(groups.drop("_smallest"), "_group").withColumn("_in", F.col("_at") - F.col("_first"))
    small = slim.where(F.col("_rows") <= block)
    n_small = groups.where(F.col("_rows") <= block).agg(F.sum("_rows")).first()[0] or 0
    buckets = -(-n_small // block) or 1

    def whole_groups(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        sizes, inside = pdf["_size"].to_numpy(), pdf["_in"].to_numpy()
        heads = np.flatnonzero(inside == 0)
        ends = np.repeat(np.append(heads[1:], len(pdf)), np.diff(np.append(heads, len(pdf))))
        found = _starts(_following(sizes, ends, budget - pdf["_held"].to_numpy(), count), heads)
        number = np.cumsum(found)
        return pd.DataFrame({"_at": pdf["_at"], "shard_no": number - np.repeat(number[heads], np.diff(np.append(heads, len(pdf)))), "_start": pdf["_at"].to_numpy()[np.flatnonzero(found)[number - 1]]})

    schema = "_at long, shard_no long, _start long"
    done = small.withColumn("_bucket", F.pmod(F.xxhash64("_group"), F.lit(buckets))).groupBy("_bucket").applyInPandas(whole_groups, schema)
    if longest is not None:
        done = done.unionByName(_cut_groups(slim.where(F.col("_rows") > block), budget, count, reach, block, schema))
    done = staged(done, "shards")
    joined = placed.join(done, "_at").join(groups.select("_group", "_first"), "_group")
    return joined.withColumn("ordinal", F.col("_at") - F.col("_first") + 1).withColumn("shard_start", F.col("_start") - F.col("_first") + 1).drop("_at", "_first", "_start", "_group", "_size", "_header")


def _cut_groups(rows: DataFrame, budget: int, count: int | None, reach: int, block: int, schema: str) -> DataFrame:
    blocked = rows.withColumn("_block", F.expr(f"_in div {block}"))
    lent = F.when((F.col("_in") % block <= reach) & (F.col("_block") > 0), F.array(F.col("_block"), F.col("_block") - 1)).otherwise(F.array(F.col("_block")))
    blocks = blocked.withColumn("_of", F.explode(lent))

    def shape(pdf: pd.DataFrame) -> tuple[pd.DataFrame, int, np.ndarray]:
        pdf = pdf.sort_values("_at")
        own = int((pdf["_block"] == pdf["_of"]).sum())
        return pdf, own, _following(pdf["_size"].to_numpy(), np.full(len(pdf), len(pdf)), budget - pdf["_held"].to_numpy(), count)

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, own, following = shape(pdf)
        leaves, steps = _leaving(following, own)
        n = min(reach, own)
        return pd.DataFrame({"_group": [pdf["_group"].iloc[0]], "_node": [int(pdf["_of"].iloc[0])], "leaves": [leaves[:n] - own], "steps": [steps[:n]]})

    def through(pdf: pd.DataFrame, entry: np.ndarray, began: np.ndarray):
        """Entries and shards begun before each node, in order, and where the last one leaves them."""
        for r in pdf.sort_values("_node").itertuples():
            yield r, entry, began
            entry, began = np.asarray(r.leaves)[entry], began + np.asarray(r.steps)[entry]
        yield None, entry, began

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        # a last block may be shorter than the reach: it is never entered beyond its rows
        n = len(pdf.sort_values("_node")["leaves"].iloc[0])
        *_, (_, leaves, steps) = through(pdf, np.arange(n), np.zeros(n, np.int64))
        return pd.DataFrame({"_group": [pdf["_group"].iloc[0]], "_node": [int(pdf["_parent"].iloc[0])], "leaves": [leaves], "steps": [steps]})

    def descend(pdf: pd.DataFrame) -> pd.DataFrame:
        entry, began = (np.array([pdf[k].iloc[0]]) for k in ("entry", "began"))
        return pd.DataFrame([(r._1, int(r._2), int(e[0]), int(b[0])) for r, e, b in through(pdf[["_group", "_node", "leaves", "steps"]], entry, began) if r is not None], columns=["_group", "_node", "entry", "began"])

    tables = "_group string, _node long, leaves array<long>, steps array<long>"
    levels = [staged(blocks.groupBy("_group", "_of").applyInPandas(table, tables), "tables")]
    while levels[-1].agg(F.max("_node")).first()[0]:
        parent = levels[-1].withColumn("_parent", F.expr(f"_node div {GROUP_BLOCKS}"))
        levels.append(staged(parent.groupBy("_group", "_parent").applyInPandas(compose, tables), "tables"))
    entries = levels[-1].select("_group", "_node", F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("began"))
    for below in reversed(levels[:-1]):
        above = entries.withColumnRenamed("_node", "_parent")
        entries = staged(below.withColumn("_parent", F.expr(f"_node div {GROUP_BLOCKS}")).join(above, ["_group", "_parent"]).groupBy("_group", "_parent").applyInPandas(descend, "_group string, _node long, entry long, began long"), "entries")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        entry, began = int(pdf["entry"].iloc[0]), int(pdf["began"].iloc[0])
        pdf, own, following = shape(pdf)
        if entry >= own:
            return pd.DataFrame({"_at": [], "shard_no": [], "_start": []}, dtype="int64")
        starts = np.flatnonzero(_starts(following, np.array([entry]))[:own])
        stop = int(following[starts[-1]])
        number = np.zeros(stop, np.int64)
        number[starts] = 1
        number = np.cumsum(number)[entry:]
        at = pdf["_at"].to_numpy()
        return pd.DataFrame({"_at": at[entry:stop], "shard_no": began + number - 1, "_start": at[starts[number - 1]]})

    return blocks.join(entries.withColumnRenamed("_node", "_of"), ["_group", "_of"]).groupBy("_group", "_of").applyInPandas(assign, schema)


def next_fit(units: DataFrame, order: Sequence[Column | str], size: str, budget: int, count: int, block: int = BLOCK_ROWS) -> DataFrame:
    """Sequential next-fit over the global order: ordinal, batch_start and batch_no per row, at most `count` rows a batch."""
    if block <= count:
        raise ValueError("a block must be longer than a batch")
    packed = segmented_next_fit(units.withColumn("_everything", F.lit(0)), "_everything", order, size, budget, count=count, block=block)
    return packed.withColumn("batch_no", F.col("shard_no") + 1).withColumnRenamed("shard_start", "batch_start").drop("_everything", "shard_no")


#: Bytes that a list of hits adds to its cluster's header as JSON: `, "candidates": []`; and a separator between two hits.
LIST_BYTES, SEPARATOR_BYTES = 18, 2


def cluster_units(hits: DataFrame, cluster: str, order: Sequence[Column | str], size: str, header: str, budget: int, *, block: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(hits with unit_id, units): every cluster as one unit if it fits the budget, else as shards `<cluster>::shard-<n>`.

    units: unit_id, cluster, n_hits, bytes (header, hits and separators), sharded,
    and oversize where even one hit does not fit.
    """
    packed = segmented_next_fit(hits, cluster, order, size, budget, header=header, block=block)
    bytes_of = lambda: F.max(F.coalesce(F.col(header), F.lit(0))) + LIST_BYTES + F.sum(F.coalesce(F.col(size), F.lit(0))) + SEPARATOR_BYTES * (F.count(F.lit(1)) - 1)
    full = packed.groupBy(F.col(cluster).alias("_c")).agg((bytes_of() > budget).alias("sharded"))
    known = packed.join(full, F.col(cluster).eqNullSafe(F.col("_c"))).drop("_c")
    name = F.coalesce(F.col(cluster).cast("string"), F.lit(""))
    own = known.withColumn("unit_id", F.when(F.col("sharded"), F.concat(name, F.lit("::shard-"), F.col("shard_no").cast("string"))).otherwise(name))
    units = own.groupBy("unit_id", F.col(cluster).alias("cluster"), "sharded").agg(F.count(F.lit(1)).alias("n_hits"), bytes_of().alias("bytes")).withColumn("oversize", F.col("bytes") > budget)
    return own, units


def batch_summary(packed: DataFrame, size: str, budget: int) -> DataFrame:
    """Per batch: rows, bytes and whether its one row is oversize."""
    return packed.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n_units"), F.sum(size).alias("bytes")).withColumn("oversize", F.col("bytes") > budget)


def over_budget(batches: DataFrame, budget: int) -> DataFrame:
    """Audit: batches of several rows beyond the budget."""
    return batches.where((F.col("bytes") > budget) & (F.col("n_units") > 1))


def shards(units: DataFrame, category: str, size: str, budget: int) -> DataFrame:
    """One shard per category (unnamed ones together), with its bytes and whether it is oversize."""
    named = F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit("_uncategorized"))
    return units.groupBy(named.alias("shard")).agg(F.count(F.lit(1)).alias("n_units"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).withColumn("oversize", F.col("bytes") > budget)


def two_phase(shard_rows: DataFrame, budget: int) -> DataFrame:
    """Whether everything fits one pass, or shards are needed first."""
    return shard_rows.agg(F.sum("n_units").alias("n_units"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_shards")).withColumn("mode", F.when(F.col("bytes") <= budget, "single").otherwise("two_phase"))


def page(units: DataFrame, order: Sequence[Column | str], size: str, offset: int, limit: int, budget: int) -> DataFrame:
    """Rows offset..offset+limit in order, cut to the largest prefix within the budget (one row at least).

    The limit is the page's own; only a page's rows meet in one task.
    """
    rows = units.orderBy(*order).offset(offset).limit(limit).withColumn("page_no", F.row_number().over(Window.orderBy(*order)))
    running = F.sum(size).over(Window.orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0))
    # a JSON list of n members is 2 brackets and n - 1 separators of 2 bytes longer than its members
    cost = running + 2 + 2 * (F.col("page_no") - 1)
    return rows.withColumn("page_bytes", cost).where((F.col("page_bytes") <= budget) | (F.col("page_no") == 1))


def first_members(groups: DataFrame, members: str, n: Column) -> DataFrame:
    """The first n members in name order of each group (the sample is the feature)."""
    return groups.withColumn("sample", F.slice(F.array_sort(members), 1, n))


def fitting_sample(groups: DataFrame, members: str, cap: int) -> DataFrame:
    """The first n, n/2, n/4 ... members of {name, bytes} whose bytes fit the cap; one at least."""
    ordered = F.array_sort(members)
    halves = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(members), F.lit(1)))).cast("int")), lambda k: F.greatest(F.lit(1), F.floor(F.size(members) / F.pow(F.lit(2), k)).cast("int")))
    total = lambda n: F.aggregate(F.slice(ordered, F.lit(1), n), F.lit(0).cast("long"), lambda a, m: a + m["bytes"])
    fits = F.filter(halves, lambda n: (total(n) <= cap) | (n == 1))
    return groups.withColumn("sample_size", F.coalesce(F.element_at(fits, 1), F.lit(0)))
