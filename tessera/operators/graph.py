"""Call edges, reach and scope."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import discard, staged, with_ordinal


#: Files of one side of a block, and cells (callee, caller) that a task counts and hands over at once.
BLOCK_FILES, CELLS = 4096, 1 << 18
#: Where files of equal names are counted as one: files and names of one side of a block, files of one side of a row of lists, rows handed over at once.
LINK_FILES, LINK_NAMES, LIST, LIST_ROWS = 1 << 16, 1 << 21, 256, 256
#: Where callers are counted and no pair is made: sets of names of one side of a block, words of the bitmaps of some callees, bytes of all names' bitmaps, words that a caller in a list is worth.
SETS, WORDS, BITMAP_BYTES, CALLER_WORDS = 1 << 16, 1 << 16, 1 << 26, 16


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for every span, one after another."""
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(int(lengths.sum()))


def _counted(table: pa.Table, cells: int = CELLS) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Callers, some callees, and how many names lie between them (a row per callee) of one block's (calls, key, name)."""
    names, side = table["name"].combine_chunks().dictionary_encode().indices.to_numpy(), table["calls"].to_numpy()
    ends = [pc.filter(table["key"].combine_chunks(), pa.array(own)).dictionary_encode() for own in (side, ~side)]
    (callers, c), (callees, d) = ((e.dictionary, e.indices.to_numpy()) for e in ends)
    if not len(c) or not len(d):
        return
    order = np.argsort(names[side], kind="stable")
    called, c = names[side][order], c[order]
    order = np.argsort(d, kind="stable")
    defined, d = names[~side][order], d[order]
    start = np.searchsorted(called, defined)
    length = np.searchsorted(called, defined, "right") - start
    own = pc.index_in(callees, callers).to_numpy(zero_copy_only=False)
    n, step = len(callers), max(1, cells // len(callers))
    for low in range(0, len(callees), step):
        rows = min(step, len(callees) - low)
        i, end = np.searchsorted(d, (low, low + rows)).tolist()
        found = np.zeros(rows * n, np.int64)
        while i < end:  # a name has one pair for each caller at most
            j = min(i + max(1, 8 * cells // n), end)
            at = np.repeat((d[i:j] - low).astype(np.int64) * n, length[i:j]) + c[_spans(start[i:j], length[i:j])]
            found += np.bincount(at, minlength=rows * n)
            i = j
        found = found.reshape(rows, n)
        same = own[low : low + rows]
        has = np.flatnonzero(~np.isnan(same.astype(float)))
        found[has, same[has].astype(np.int64)] = 0
        yield callers, callees.slice(low, rows), found


def _blocks(defs: DataFrame, calls: DataFrame, key: str, name: str, block_files: int) -> DataFrame:
    """(i, j, calls, key, name): the callers of block i beside the callees of block j, for all of them.

    Every pair of files meets in one task, which counts its names, so what shuffles
    is a name for every block of the other side, never a pair.
    """
    d = staged(defs.select(F.col(key).alias("key"), F.col(name).alias("name")).dropna().distinct(), "definitions")
    c = staged(calls.select(F.col(key).alias("key"), F.col(name).alias("name")).dropna().distinct().join(d.select("name").distinct(), "name", "left_semi").select("key", "name"), "calls")
    n = [max(1, -(-side.agg(F.count_distinct("key")).first()[0] // block_files)) for side in (c, d)]
    own = lambda count: F.pmod(F.xxhash64("key"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    callers = c.select(own(n[0]).alias("i"), every(n[1]).alias("j"), F.lit(True).alias("calls"), "key", "name")
    callees = d.select(every(n[0]).alias("i"), own(n[1]).alias("j"), F.lit(False).alias("calls"), "key", "name")
    # the number is given, since small inputs make large outputs here and must not be put together
    return callers.unionByName(callees).repartition(min(n[0] * n[1], 4096), "i", "j")


def _n_blocks(df: DataFrame, files: int, block_files: int = LINK_FILES) -> int:
    """Blocks of one side: enough for their pairs to keep all cores busy, unless files are few."""
    several = math.ceil((12 * df.sparkSession.sparkContext.defaultParallelism) ** 0.5)
    return max(1, -(-files // block_files), min(several, -(-files // 1024)))


def _coded(defs: DataFrame, calls: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(key, names) of definitions and of calls: names that are both called and defined, once each as numbers in order; files without any are left out."""
    own = lambda df, kind: staged(df.select(F.col(key).alias("key"), F.col(name).alias("name")).dropna(), kind)
    d, c = own(defs, "definitions"), own(calls, "calls")
    both = c.groupBy("name").agg(F.count(F.lit(1)).alias("n")).join(d.select("name").distinct(), "name", "left_semi")
    codes = with_ordinal(both, F.desc("n"), "name", name="code").select("name", F.col("code").cast("int").alias("code"))
    sets = lambda df, kind: staged(df.join(codes, "name").groupBy("key").agg(F.array_sort(F.collect_set("code")).alias("names")), f"{kind}-sets")
    out = sets(d, "definitions"), sets(c, "calls")
    discard(d, c)
    return out


def _sizes(side: DataFrame) -> tuple[int, int]:
    """Rows of (..., names), and their names."""
    return tuple(side.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("names")), F.lit(0))).first())


def _alike(defs: DataFrame, calls: DataFrame, key: str, name: str, block_files: int) -> DataFrame:
    """(i, j, calls, keys, names): as _blocks, but the files of a block that call, or define, just the same names are one row, and names are numbers."""
    d, c = _coded(defs, calls, key, name)
    n = []
    for side in (c, d):
        files, names = _sizes(side)
        n.append(max(-(-names // LINK_NAMES), _n_blocks(d, files, block_files)))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    units = lambda side, count: side.groupBy(F.pmod(F.xxhash64("key"), F.lit(count)).cast("int").alias("own"), "names").agg(F.collect_list("key").alias("keys"))
    callers = units(c, n[0]).select(F.col("own").alias("i"), every(n[1]).alias("j"), F.lit(True).alias("calls"), "keys", "names")
    callees = units(d, n[1]).select(every(n[0]).alias("i"), F.col("own").alias("j"), F.lit(False).alias("calls"), "keys", "names")
    # the number is given, since small inputs make large outputs here and must not be put together; twice as many as blocks, so that few tasks get several
    return callers.unionByName(callees).repartition(min(2 * n[0] * n[1], 4096), "i", "j")


def _linked(table: pa.Table, cells: int = CELLS, most: int = LIST) -> Iterator[pa.RecordBatch]:
    """(callers, callees, weight): lists of `most` files at most, between all of which lie `weight` names, of one block of _alike."""
    sides = []
    for own in (table["calls"], pc.invert(table["calls"])):
        keys, names = (table[c].filter(own).combine_chunks() for c in ("keys", "names"))
        size = keys.value_lengths().to_numpy().astype(np.int64)
        sides.append((keys.flatten(), size, np.cumsum(size) - size, names.flatten(), names.value_lengths().to_numpy()))
    (callers, n_c, from_c, called, per_c), (callees, n_d, from_d, defined, per_d) = sides
    if not len(n_c) or not len(n_d):
        return
    # rows of files are numbered, those of callees below zero, so that none meets itself
    number = np.concatenate([np.repeat(np.arange(len(n_c)), per_c), np.repeat(-1 - np.arange(len(n_d)), per_d)])
    flat = pa.table({"calls": np.arange(len(number)) < len(called), "key": number, "name": pa.chunked_array([called, defined])})
    lists = lambda values, at, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values.take(pa.array(at)))
    for own, other, found in _counted(flat, max(1, cells // len(callers)) * len(n_c)):
        row, column = np.nonzero(found)
        if not len(row):
            continue
        weight = found[row, column]
        # of one row after another by weight; few different values are sorted by radix
        value = row * (int(weight.max()) + 1) + weight
        order = np.argsort(value.astype(np.uint16) if value.max() < 1 << 16 else value, kind="stable")
        row, column, weight = row[order], column[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(weight) != 0)]))
        c, d, weight = own.to_numpy()[column], -1 - other.to_numpy()[row[first]], weight[first]
        at, size = _spans(from_c[c], n_c[c]), np.add.reduceat(n_c[c], first)
        start = np.cumsum(size) - size
        parts_c, parts_d = -(-size // most), -(-n_d[d] // most)
        group = np.repeat(np.arange(len(first)), parts_c * parts_d)
        part = _spans(np.zeros(len(first), np.int64), parts_c * parts_d)
        for low in range(0, len(group), LIST_ROWS):
            g, p = group[low : low + LIST_ROWS], part[low : low + LIST_ROWS]
            skip_c, skip_d = p // parts_d[g] * most, p % parts_d[g] * most
            take_c, take_d = np.minimum(most, size[g] - skip_c), np.minimum(most, n_d[d[g]] - skip_d)
            own_c, own_d = at[_spans(start[g] + skip_c, take_c)], _spans(from_d[d[g]] + skip_d, take_d)
            yield pa.RecordBatch.from_arrays([lists(callers, own_c, take_c), lists(callees, own_d, take_d), pa.array(weight[g])], names=["callers", "callees", "weight"])


def expanded(lists: DataFrame) -> DataFrame:
    """(caller, callee, weight): every caller of a row's list with every callee but itself; a row is expanded in memory, so its lists are short."""
    return lists.select(F.explode("callers").alias("caller"), "callees", "weight").select("caller", F.explode("callees").alias("callee"), "weight").where("caller <> callee")


def call_edges(defs: DataFrame, calls: DataFrame, key: str, name: str = "name", block_files: int = LINK_FILES) -> DataFrame:
    """(caller, callee, weight): distinct called names met with their definitions elsewhere.

    Two passes, so no order of files matters. Blocks of callers meet blocks of
    callees; files that share all their names are counted once, and lists of
    callers and callees leave Python, which Spark expands: the work by edge is
    that of writing it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _linked(pa.Table.from_batches(list(batches)))

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    kind = defs.schema[key].dataType.simpleString()
    return expanded(_alike(defs, calls, key, name, block_files).groupBy("i", "j").applyInArrow(run, f"callers array<{kind}>, callees array<{kind}>, weight long"))


def edges_of_sets(links: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(caller, callee, weight) of links (called, defined, weight) between sets of names; files: (key, called, defined), a set or null.

    Lists of files of one set meet the links, and their pairs are dealt out before they are expanded.
    """
    count = files.count()
    blocks = max(1, -(-count // LINK_FILES))

    def lists(own: str, out: str) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.lit(blocks))
        met = files.where(F.col(own).isNotNull()).groupBy(own, block.alias("_block")).agg(F.collect_list(key).alias("_all"))
        starts = F.sequence(F.lit(1), F.size("_all"), F.lit(LIST))
        return met.select(own, F.explode(F.transform(starts, lambda x: F.slice("_all", x, F.lit(LIST)))).alias(out))

    pairs = links.join(lists("called", "callers"), "called").join(lists("defined", "callees"), "defined").select("callers", "callees", "weight")
    return expanded(pairs.repartition(min(2 * _n_blocks(files, count) ** 2, 4096), F.col("callers")[0], F.col("callees")[0]))


def _reached(table: pa.Table, words: int = WORDS) -> pa.RecordBatch:
    """(id, n): how many files of a block call one of a set's names; the block's (id, n, names) are sets of callees, and with a null id sets of n callers.

    A caller is a bit. Names of many callers are bitmaps, others lists of bits;
    what a set of callees reaches is the union of its names.
    """
    callers, callees = table.filter(pc.is_null(table["id"])), table.filter(pc.is_valid(table["id"]))
    if not callers.num_rows or not callees.num_rows:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["id", "n"])
    # sets of equally many files lie side by side, in words of their own
    n = callers["n"].to_numpy()
    order = np.argsort(n, kind="stable")
    files, first, count = np.unique(n[order], return_index=True, return_counts=True)
    wide = -(-count // 64)
    begin, width = np.cumsum(wide) - wide, int(wide.sum())
    bit = np.empty(len(n), np.int64)
    bit[order] = np.repeat(begin * 64 - first, count) + np.arange(len(n))
    files_of, span = np.repeat(files, wide * 64), width * 64
    (called, per_c), (defined, per_d) = ((x.flatten().to_numpy(), x.value_lengths().to_numpy()) for x in (t["names"].combine_chunks() for t in (callers, callees)))
    names, defined = np.unique(defined, return_inverse=True)
    at, found = np.searchsorted(names, called), np.repeat(bit, per_c)
    met = names[np.minimum(at, len(names) - 1)] == called
    called, found = at[met], found[met]
    order = np.argsort(called, kind="stable")
    found, start = found[order], np.searchsorted(called[order], np.arange(len(names) + 1))
    size = np.diff(start)
    many = np.flatnonzero(size * CALLER_WORDS > width)
    many = many[np.argsort(size[many])[-max(1, BITMAP_BYTES // (8 * width)) :]]
    bitmaps, bitmap_of, lit = np.zeros((len(many), width), "<u8"), np.full(len(names), -1), np.zeros(span, bool)
    bitmap_of[many] = np.arange(len(many))
    for k, x in enumerate(many):
        lit[found[start[x] : start[x + 1]]] = True
        bitmaps[k] = np.packbits(lit, bitorder="little").view("<u8")
        lit[found[start[x] : start[x + 1]]] = False
    # callees in order of how many bitmaps they have, so that the k-th bitmaps of some are those of the first ones
    row = np.repeat(np.arange(callees.num_rows), per_d)
    has = bitmap_of[defined] >= 0
    by = np.argsort(-np.bincount(row[has], minlength=callees.num_rows), kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))

    def entries(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(rank[row[own]], kind="stable")
        rows = rank[row[own]][order]
        return rows, defined[own][order], np.searchsorted(rows, np.arange(len(by) + 1))

    (_, own_maps, map_at), (list_row, own_lists, list_at) = entries(has), entries(~has & (size[defined] > 0))
    maps, ends = bitmap_of[own_maps], np.cumsum(size[own_lists])
    step, out = max(1, words // width), np.zeros(len(by), np.int64)
    last = np.empty(step * span, np.int32)
    for low in range(0, len(by), step):
        top = min(low + step, len(by))
        union, length = np.zeros((top - low, width), "<u8"), np.diff(map_at[low : top + 1])
        for k in range(length[0]):
            some = int((length > k).sum())
            union[:some] |= bitmaps[maps[map_at[low : low + some] + k]]
        out[low:top] = np.add.reduceat(np.bitwise_count(union), begin, axis=1, dtype=np.int64) @ files
        i, end, flat = list_at[low], list_at[top], union.reshape(-1)
        while i < end:
            j = min(max(i + 1, int(np.searchsorted(ends, ends[i] + 8 * words))), end)
            own = own_lists[i:j]
            bits = np.repeat((list_row[i:j] - low) * span, size[own]) + found[_spans(start[own], size[own])]
            # a bit that several names set counts once
            last[bits] = np.arange(len(bits))
            bits = bits[last[bits] == np.arange(len(bits))]
            mask = np.uint64(1) << (bits & 63).astype(np.uint64)
            new = flat[bits >> 6] & mask == 0
            bits, mask, i = bits[new], mask[new], j
            out[low:top] += np.bincount(bits // span, weights=files_of[bits % span], minlength=top - low).astype(np.int64)
            if i < end:
                np.bitwise_or.at(flat, bits >> 6, mask)
    return pa.RecordBatch.from_arrays([callees["id"].combine_chunks().take(pa.array(by)), pa.array(out)], names=["id", "n"])


def callers_of(defs: DataFrame, calls: DataFrame, key: str, name: str = "name", block_files: int = SETS) -> DataFrame:
    """(node, fan_in): how many other files call a file, as fan_in of the call edges, of which none is made.

    Files that define the same names have the same callers but for themselves, so
    sets of names meet in blocks, as numbers; a block is as large as its bitmaps
    allow, and few copies of a set shuffle.
    """
    d, c = _coded(defs, calls, key, name)
    callees = staged(d.groupBy("names").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()), "callees")
    callers = staged(c.groupBy("names").agg(F.count(F.lit(1)).alias("n")), "callers")
    least = lambda sets, names: max(1, -(-sets // block_files), -(-names // LINK_NAMES))
    n_i, sets = least(*_sizes(callers)), _sizes(callees)
    n_j = max(least(*sets), min(-(-4 * defs.sparkSession.sparkContext.defaultParallelism // n_i), -(-sets[0] // 1024)))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = lambda of, count: F.pmod(F.xxhash64(of), F.lit(count)).cast("int")
    sides = callers.select(own("names", n_i).alias("i"), every(n_j).alias("j"), F.lit(None).cast("long").alias("id"), "n", "names")
    sides = sides.unionByName(callees.select(every(n_i).alias("i"), own("id", n_j).alias("j"), "id", "n", "names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _reached(pa.Table.from_batches(list(batches)))

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    counts = sides.repartition(min(2 * n_i * n_j, 4096), "i", "j").groupBy("i", "j").applyInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    itself = c.join(d.withColumnRenamed("names", "defined"), "key").where(F.arrays_overlap("names", "defined")).select("key", F.lit(1).alias("own"))
    met = d.join(callees.select("names", "id").join(counts, "id"), "names").join(itself, "key", "left")
    return met.select(F.col("key").alias("node"), (F.col("n") - F.coalesce("own", F.lit(0))).alias("fan_in")).where("fan_in > 0")


def first_callers(defs: DataFrame, calls: DataFrame, key: str, n: int, name: str = "name") -> DataFrame:
    """(node, callers): the n smallest other files that call a file, sorted; n + 1 of each name hold them, one of which may be the file itself."""
    d, c = defs.select(F.col(key).alias("node"), name).distinct(), calls.select(F.col(key).alias("caller"), name).distinct()
    # a hot name is ranked by slices first
    ranked = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(name, *by).orderBy("caller"))).where(F.col("_n") <= n + 1).drop("_n")
    few = ranked(ranked(c.withColumn("_slice", F.pmod(F.xxhash64("caller"), F.lit(64))), "_slice").drop("_slice"))
    lists = few.groupBy(name).agg(F.collect_list("caller").alias("_callers"))
    met = d.join(lists, name).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("_callers"))).alias("_callers"))
    own = F.array_sort(F.filter("_callers", lambda x: x != F.col("node")))
    return met.select("node", F.slice(own, 1, n).alias("callers")).where(F.size("callers") > 0)


def name_pairs(defs: DataFrame, calls: DataFrame, key: str, name: str = "name") -> DataFrame:
    """(name, n_callers, n_callees, n_pairs): the call graph by name, not expanded; a file's own pair with itself does not count.

    Sums by name are combined before they shuffle, so a name of every file is one row.
    """
    sides = calls.select(key, name, F.lit(1).alias("c"), F.lit(0).alias("d")).distinct().unionByName(defs.select(key, name, F.lit(0).alias("c"), F.lit(1).alias("d")).distinct())
    files = sides.groupBy(key, name).agg(F.max("c").alias("c"), F.max("d").alias("d"))
    sums = files.groupBy(name).agg(F.sum("c").alias("n_callers"), F.sum("d").alias("n_callees"), F.sum(F.col("c") * F.col("d")).alias("_both"))
    return sums.select(name, "n_callers", "n_callees", (F.col("n_callers") * F.col("n_callees") - F.col("_both")).alias("n_pairs"))


def calls_received(defs: DataFrame, calls: DataFrame, key: str, name: str = "name") -> DataFrame:
    """(node, calls): the weights of the edges that end in a node, from counts by name; no edge is made."""
    d, c = defs.select(key, name).distinct(), calls.select(key, name).distinct()
    callers = c.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    own = c.select(key, name, F.lit(1).alias("_own"))
    met = d.join(callers, name).join(own, [key, name], "left")
    return met.groupBy(F.col(key).alias("node")).agg(F.sum(F.col("_n") - F.coalesce("_own", F.lit(0))).alias("calls"))


def fan_in(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("callee").alias("node")).agg(F.count(F.lit(1)).alias("fan_in"))


def directed(edges: DataFrame, direction: str) -> DataFrame:
    forward = edges.select(F.col("caller").alias("a"), F.col("callee").alias("b"))
    if direction == "forward":
        return forward
    reverse = edges.select(F.col("callee").alias("a"), F.col("caller").alias("b"))
    return reverse if direction == "reverse" else forward.unionByName(reverse)


def reach(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """(node, depth) within `depth` steps of the seeds; the edges and each level are written to the shared folder, so no level makes them again."""
    steps = directed(staged(edges.select("caller", "callee"), "edges"), direction)
    seen = seeds.select(F.col("node")).distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        nodes = frontier.select("node").join(steps, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = staged(nodes.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)), f"level-{d}")
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def scope(edges: DataFrame, seeds: DataFrame, framework: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """(node, role): seed, in_scope, framework_hinted (framework nodes next to a seed) or unresolved (the other ones)."""
    near = directed(edges, "both").join(seeds.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
    hinted = framework.join(near, "node", "left_semi").distinct()
    inside = reach(edges, seeds, depth, direction).select("node").unionByName(hinted).distinct()
    role = lambda df, name: df.select("node").distinct().withColumn("role", F.lit(name))
    unresolved = framework.select("node").distinct().join(inside, "node", "left_anti")
    return role(seeds, "seed").unionByName(role(inside, "in_scope")).unionByName(role(hinted, "framework_hinted")).unionByName(role(unresolved, "unresolved"))


def applicable(rows: DataFrame, key: str, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows whose node is a seed or is called by one."""
    touched = edges.join(seeds.select(F.col("node").alias("caller")), "caller", "left_semi").select(F.col("callee").alias(key)).unionByName(seeds.select(F.col("node").alias(key))).distinct()
    return rows.join(touched, key, "left_semi")


def outside_callers(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, n_outside): callers that are not seeds, per called seed."""
    called = edges.join(seeds.select(F.col("node").alias("callee")), "callee", "left_semi")
    return called.join(seeds.select(F.col("node").alias("caller")), "caller", "left_anti").groupBy(F.col("callee").alias("node")).agg(F.count(F.lit(1)).alias("n_outside"))


def unresolved(framework: DataFrame, touched: DataFrame) -> DataFrame:
    return framework.select("node").subtract(touched.select("node"))
