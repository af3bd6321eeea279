"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its components.

1. Rows with the same shingle set (128-bit signature and size) form a class; one
   row of each class represents it.
2. Shingle frequencies over all representatives are counted exactly in cells of
   2**CELL_BITS hash values; frequency classes (from 2, 16, 128, 1024 documents)
   are kept in a Bloom filter. Cells and filter grow with what they hold, up to
   2**MOST_CELL_BITS cells and 2**MOST_LOG_BITS bits: where most lone shingles pass
   for shared ones, every prefix is sent in full. All documents order their
   shingles by (class, hash), rare ones first.
3. A document's prefix for l matches is its first n - ceil(0.75 n) + l shingles:
   two similar documents share at least min(l, l') shingles of their prefixes.
   Each document chooses the l of least estimated cost from the frequencies in
   its prefix. Shingles of no other document are not sent at all.
4. Each prefix shingle names the smallest node of its list as hub, so a list of m
   documents is m rows and never m*m pairs, and every candidate pair meets at a
   hub. A hub's cluster is compared in blocks of bounded size, with the hub first:
   shared prefix shingles, then exact intersections for what reaches the smaller
   l. Pairs that are already connected are skipped, pairs too far apart by their
   distances to the hub as well, and only a spanning forest leaves the task.
5. Components by large-star/small-star rounds, each written to the shared folder.

Defined cases: null, empty and blank texts have no shingles (n_shingles 0) and
are alone; fewer than five words are one shingle; a null doc_id takes part but
never names a component unless it is alone; equal rows are one class; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import support as S

SHINGLE, PERCENT = 5, 75
CELL_BITS = 32
MOST_CELL_BITS, CELLS_PER_SHINGLE = 40, 16
MOST_LOG_BITS, BITS_PER_KEY = 29, 6  # 64 MiB
RANGE_BITS = 22  # cells per counting range: 2**22 counters, 16 MiB
FREQUENCIES = (2, 16, 128, 1024)
TYPICAL = np.array([0.0, 4, 32, 256, 4096])
MAX_MATCHES = 8
VERIFY_COST = 16.0
CHUNK = 1 << 18  # edges that a task joins at once
BLOCK = 1 << 15  # set members (hashes) of a group, 256 KiB
_FLUSH = 1 << 20


def shingle_sets(buf: np.ndarray, at: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    low = S.lower_ascii(buf)
    starts, ends, bounds = S.word_bounds(low, at)
    words = S.span_hashes(low, starts, ends)
    grams, out = S.gram_hashes(words, n), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            out.append(S.run_hashes(words[a:b], np.zeros(1, np.int64), np.array([b - a])) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, node, n_shingles, sig1, sig2) per row; node is the row's key."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, at in S.slices(batches, "text"):
            sets = shingle_sets(buf, at, n)
            sums = [np.array([S.mix64(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64) for salt in (0x1234567, 0x89ABCDEF01)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(S.signed(s)) for s in sums)], names=["doc_id", "node", "n_shingles", "sig1", "sig2"])

    return docs.select("doc_id", S.row_key().alias("node"), "text").mapInArrow(run, f"doc_id {kind}, node long, n_shingles long, sig1 long, sig2 long")


def _cell_key(cells: np.ndarray, level: int) -> np.ndarray:
    return S.mix64(cells.astype(np.uint64) << np.uint64(8) | np.uint64(level))


def bits_for(held: int, per_item: int, least: int, most: int) -> int:
    """The bits of a number of cells or filter bits that has `per_item` for each item held, within bounds."""
    return min(most, max(least, (max(1, held) * per_item - 1).bit_length()))


def frequency_classes(docs: DataFrame, is_rep, n: int, log_bits: int | None = None, cell_bits: int = CELL_BITS) -> bloom.Bloom:
    """The filter of (cell, class), counted over all representatives; without log_bits its size follows the number of its keys.

    Tasks send sorted cells, packed to about two bytes each, by range of cells;
    a range's counters have a fixed size and its parts are streamed.
    """
    width = min(RANGE_BITS, cell_bits)
    shift, ranges = np.uint64(64 - cell_bits), 1 << (cell_bits - width)

    def send(cells: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own = np.sort(np.concatenate(cells))
        cuts = np.searchsorted(own, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(width)).tolist()
        low = (own & np.uint64((1 << width) - 1)).astype(np.uint32)
        rows = [(k, bloom.pack(low[cuts[k] : cuts[k + 1]])) for k in range(ranges) if cuts[k] < cuts[k + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["part", "cells"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for part, buf, at in S.slices(batches, "text"):
            reps = is_rep(part.column(0))
            found = [s >> shift for s, rep in zip(shingle_sets(buf, at, n), reps, strict=True) if rep and len(s)]
            waiting += found
            held += sum(map(len, found))
            if held >= _FLUSH:
                yield from send(waiting)
                waiting, held = [], 0
        if waiting:
            yield from send(waiting)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few, held, seen, part = [], 0, None, 0
        for batch in batches:
            part = batch.column(0)[0].as_py()
            for packed in batch.column(1):
                cells = bloom.unpack(packed.as_py())
                held += len(cells)
                few.append(cells)
                if held > 1 << max(0, width - 3):  # counters for the whole range pay from here on
                    seen = np.zeros(1 << width, np.uint32) if seen is None else seen
                    for x in few:
                        np.add.at(seen, x, 1)
                    few = []
        if seen is None:
            found, counts = np.unique(np.concatenate(few), return_counts=True)
        else:
            found = np.flatnonzero(seen >= FREQUENCIES[0]).astype(np.uint32)
            counts = seen[found]
        for level, least in enumerate(FREQUENCIES, 1):
            cells = found[counts >= least]
            for i in range(0, len(cells), 1 << 16):
                few = cells[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([part], pa.int32()), pa.array([len(few)], pa.int64()), pa.array([bloom.pack(few)], pa.binary())], names=["level", "part", "n", "cells"])

    count.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for level, part, cells in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                yield _cell_key(bloom.unpack(cells).astype(np.uint64) | np.uint64(part << width), level)

    # staged, so that no task holds counters and filter segments in two Python workers at a time
    counted = S.staged(docs.mapInArrow(scan, "part int, cells binary").groupBy("part").applyInArrow(count, "level int, part int, n long, cells binary"), "frequent-cells")
    if log_bits is None:
        log_bits = bits_for(counted.agg(F.sum("n")).first()[0] or 0, BITS_PER_KEY, bloom.LOG_BITS, MOST_LOG_BITS)
    frequent = bloom.build(counted, keys, "once", log_bits)
    S.discard(counted)
    return frequent


def levels_of(tokens: np.ndarray, frequent: bloom.Bloom, cell_bits: int = CELL_BITS) -> np.ndarray:
    """0 for a shingle of one document only, else its frequency class."""
    cells, out = tokens >> np.uint64(64 - cell_bits), np.zeros(len(tokens), np.int8)
    left = np.arange(len(tokens))
    for level in range(1, len(FREQUENCIES) + 1):
        left = left[frequent.test(_cell_key(cells[left], level))]
        out[left] = level
    return out


def prefix_of(tokens: np.ndarray, levels: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """The number of matches the document asks for, and its prefix without shingles of class 0."""
    n, order = len(tokens), np.lexsort((tokens, levels))
    need = -(-percent * n // 100)
    length = n - need + 1
    most = min(MAX_MATCHES, need)
    sums = np.cumsum(TYPICAL[levels[order[: length + most - 1]]])
    if sums[length - 1] == 0:
        return 1, tokens[:0]
    matches = np.arange(1, most + 1)
    lists = sums[length - 1 : length + most - 1]
    best = int(matches[np.argmin(lists * (1 + VERIFY_COST / matches))])
    prefix = order[: length + best - 1]
    return best, tokens[prefix[levels[prefix] > 0]]


def prefixes(docs: DataFrame, is_rep, frequent, n: int, percent: int, cell_bits: int = CELL_BITS) -> DataFrame:
    """(node, n, matches, prefix, tokens) of the representatives that share a prefix shingle with another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, at in S.slices(batches, "text"):
            nodes, sets = part.column(0).to_pylist(), shingle_sets(buf, at, n)
            reps = is_rep(part.column(0))
            own = [i for i, s in enumerate(sets) if len(s) and reps[i]]
            if not own:
                continue
            levels = levels_of(np.concatenate([sets[i] for i in own]), frequent.value, cell_bits)
            rows, first = [], 0
            for i in own:
                mine, first = levels[first : first + len(sets[i])], first + len(sets[i])
                matches, prefix = prefix_of(sets[i], mine, percent)
                if len(prefix):
                    rows.append((nodes[i], len(sets[i]), matches, S.signed(prefix), sets[i].tobytes()))
            if rows:
                node, size, matches, prefix, tokens = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(matches, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(tokens, pa.binary())], names=["node", "n", "matches", "prefix", "tokens"])

    return docs.mapInArrow(run, "node long, n int, matches int, prefix array<long>, tokens binary")


class _Lists:
    """Inverted lists of a group's rows, given as the rows' members one after another."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        order = np.argsort(values, kind="stable")
        values = values[order]
        first = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
        self.ids, self.n = np.empty(len(order), np.int64), len(sizes)
        self.ids[order] = np.cumsum(first) - 1
        self.own, self.docs = np.concatenate([[0], np.cumsum(sizes)]), np.repeat(np.arange(self.n), sizes)[order]
        self.at = np.append(np.flatnonzero(first), len(order))

    def shared(self, x: int) -> np.ndarray:
        """How many members of row x each row has."""
        ids = self.ids[self.own[x] : self.own[x + 1]]
        return np.bincount(self.docs[S.ranges(self.at[ids], self.at[ids + 1] - self.at[ids])], minlength=self.n)


@dataclass
class Group:
    """Rows that meet: nodes, set sizes, matches asked for, and inverted lists of prefixes and sets."""

    nodes: np.ndarray
    sizes: np.ndarray
    matches: np.ndarray
    near: _Lists
    full: _Lists

    @staticmethod
    def of(table: pa.Table, order: np.ndarray) -> Group:
        prefix, lengths = S.int_lists(table["prefix"].combine_chunks())
        data, at = S.buffer_of(table["tokens"])
        sizes = np.array(table["n"], np.int64)
        pick = lambda values, counts: values[S.ranges((np.cumsum(counts) - counts)[order], counts[order])]
        near, full = _Lists(pick(prefix, lengths), lengths[order]), _Lists(pick(data.view(np.uint64), np.diff(at) >> 3), sizes[order])
        return Group(np.array(table["node"])[order], sizes[order], np.array(table["matches"], np.int64)[order], near, full)

    def similarity(self, x: int) -> np.ndarray:
        """Of row x and each row, in percent."""
        common = self.full.shared(x)
        return 100.0 * common / (self.sizes + self.sizes[x] - common)

    def forest(self, percent: int, label: np.ndarray, todo: np.ndarray, distance: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Edges that connect what is similar, of the pairs with a row of `todo`; rows of one label are connected already.

        Row 0 is compared first. From then on only rows outside the largest
        component are, each with all others, until all that is left is one
        component. `distance` (to one pivot) rules pairs out by the triangle
        inequality, which the Jaccard distance obeys.
        """
        label, edges, left, x = label.copy(), [], np.ones(len(self.nodes), bool), 0
        gap = 1 - percent / 100 + 1e-6
        while True:
            smaller, larger = np.minimum(self.sizes, self.sizes[x]), np.maximum(self.sizes, self.sizes[x])
            wanted = left & (label != label[x]) & (100 * smaller >= percent * larger)
            if distance is not None:
                wanted &= np.abs(distance - distance[x]) <= gap
            if wanted.any():
                wanted &= self.near.shared(x) >= np.minimum(self.matches, self.matches[x])
            if wanted.any():
                common = self.full.shared(x)
                found = np.flatnonzero(wanted & (100 * common >= percent * (self.sizes + self.sizes[x] - common)))
                joined, first = np.unique(label[found], return_index=True)
                edges += [(int(self.nodes[x]), int(self.nodes[y])) for y in found[first]]
                label[np.isin(label, joined)] = label[x]
            left[x] = False
            open_rows = np.flatnonzero(left & todo)
            if not len(open_rows):
                return edges
            most = np.bincount(label[left]).argmax()
            other = open_rows[label[open_rows] != most]
            if len(other):
                x = int(other[0])
            elif (label[left] != most).any():
                x = int(open_rows[0])
            else:
                return edges


def _edges(found: list[tuple[int, int]]) -> list[pa.Array]:
    return [pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)]


def links(found: DataFrame, *, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all similar representatives, by way of hubs.

    A hub's cluster of at most `block` set members (hashes) is one group. A larger
    one is dealt into blocks that each get a copy of the hub's row: a first pass
    that grows with the cluster and connects nearly all of a group of near
    copies. Only rows that are not connected with their hub then meet the other
    blocks, and of the connected ones only those that the distances to the hub
    leave possible.
    """
    tokens = found.select("node", "n", F.explode("prefix").alias("token"))
    hubs = tokens.groupBy("token").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").select("token", "hub")
    members = S.staged(tokens.join(hubs, "token").select("hub", "node", "n").distinct(), "hub-members")
    large = members.groupBy("hub").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks")).where("blocks > 1")
    places = F.when((F.col("hub") == F.col("node")) & F.col("blocks").isNotNull(), F.sequence(F.lit(0), F.col("blocks") - 1))
    places = F.coalesce(places, F.array(F.coalesce(F.pmod(F.xxhash64("node"), "blocks"), F.lit(0)).cast("int")))
    groups = members.join(large, "hub", "left").select("hub", "node", F.explode(places).alias("at"), F.col("blocks").isNotNull().alias("large")).join(found, "node")
    names = ["hub", "a", "b", "n", "distance"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # one block and its hub
        hub, nodes = np.array(table["hub"]), np.array(table["node"])
        rows = Group.of(table, np.lexsort((nodes, nodes != hub)))
        n = len(rows.nodes)
        edges = rows.forest(percent, np.arange(n), np.ones(n, bool)) if n > 1 else []
        none = pa.nulls(len(edges), pa.int64())
        yield pa.RecordBatch.from_arrays([none, *_edges(edges), none.cast(pa.int32()), none.cast(pa.float64())], names=names)
        if table["large"][0].as_py() and n > 1:
            none = pa.nulls(n - 1, pa.int64())
            distance = 1 - rows.similarity(0)[1:] / 100
            yield pa.RecordBatch.from_arrays([pa.array(hub[1:]), pa.array(rows.nodes[1:]), none, pa.array(rows.sizes[1:], pa.int32()), pa.array(distance)], names=names)

    compare.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    first = S.staged(groups.groupBy("hub", "at").applyInArrow(compare, "hub long, a long, b long, n int, distance double"), "hub-links")
    S.discard(members)
    edges = first.where("hub IS NULL").select("a", "b")
    if first.where("hub IS NOT NULL").isEmpty():
        return edges
    return edges.unionByName(_links_of_the_rest(first.where("hub IS NOT NULL").select("hub", F.col("a").alias("node"), "n", "distance"), edges, found, percent, block * 16))


def _links_of_the_rest(placed: DataFrame, edges: DataFrame, found: DataFrame, percent: int, block: int) -> DataFrame:
    """Edges of the rows that are not connected with their large hub, with all rows of its cluster that may be similar."""
    roots = components(edges)
    of_hub = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    known = placed.join(roots, "node", "left").join(of_hub, "hub", "left")
    known = S.staged(known.select("hub", "node", "n", "distance", F.coalesce("root", "node").alias("root"), F.coalesce("hub_root", "hub").alias("hub_root")), "hub-distances")
    apart = known.where("root <> hub_root")
    per_hub = apart.groupBy("hub").agg(F.min("distance").alias("least"), F.ceil(F.sum("n") / block).cast("int").alias("rows"))
    near = known.join(per_hub, "hub").where((F.col("root") != F.col("hub_root")) | (F.col("distance") >= F.col("least") - (1 - percent / 100 + 1e-6)))
    per_near = near.groupBy("hub").agg(F.ceil(F.sum("n") / block).cast("int").alias("columns"))
    near = near.join(per_near, "hub")
    own = lambda count, salt: F.pmod(F.xxhash64("node", F.lit(salt)), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    keep = ["hub", "node", "distance", "root"]
    todo = near.where("root <> hub_root").select(*keep, own("rows", "r").alias("i"), every("columns").alias("j"), F.lit(True).alias("todo"))
    others = near.select(*keep, every("rows").alias("i"), own("columns", "c").alias("j"), F.lit(False).alias("todo"))
    groups = todo.unionByName(others).join(found, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # two blocks
        todo, nodes = np.array(table["todo"]), np.array(table["node"])
        order = np.lexsort((nodes, ~todo))
        rows, todo = Group.of(table, order), todo[order]
        _, label = np.unique(np.array(table["root"])[order], return_inverse=True)
        found = rows.forest(percent, label, todo, np.array(table["distance"])[order]) if todo.any() else []
        yield pa.RecordBatch.from_arrays(_edges(found), names=["a", "b"])

    compare.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return groups.groupBy("hub", "i", "j").applyInArrow(compare, "a long, b long")


def forest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of some edges that is not the smallest of its component, and that smallest one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, root = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while len(u):
        ru, rv = root[u], root[v]
        apart = ru != rv
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def components(edges: DataFrame, max_rounds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    Chunks of at most about `chunk` edges become forests of trees of depth one,
    in tasks. If there was more than one chunk, alternating large-star and
    small-star rounds join them; neighbours' minima are partial aggregates joined
    back, so a node with many neighbours is spread over tasks.
    """
    edges = S.staged(edges.where("a <> b").select("a", "b"), "edges")
    chunks = -(-edges.count() // chunk)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.array(b.column(0)), np.array(b.column(1))) for b in batches]
        if found:
            nodes, roots = forest_of(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["a", "b"])

    forests = S.staged(edges.repartition(max(1, chunks)).mapInArrow(shrink, "a long, b long"), "forests")
    S.discard(edges)
    edges, state = forests, None
    for _ in range(max_rounds if chunks > 1 else 0):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = S.staged(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-star")
        S.discard(edges)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = large.join(least, "a")
        edges = S.staged(kept.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b")).distinct(), "small-star")
        S.discard(large)
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    else:
        if chunks > 1:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def similarity_components(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, log_bits: int | None = None, cell_bits: int | None = None) -> DataFrame:
    """doc_id, node, root, n_shingles, component_id: a row per document.

    node is the row's key and root that of its component, for rows that share a doc_id.
    """
    spark = docs.sparkSession
    S.small_batches(spark)
    rows = S.staged(signatures(docs, shingle), "signatures")
    same = ["n_shingles", "sig1", "sig2"]
    classes = S.staged(rows.where("n_shingles > 0").groupBy(*same).agg(F.min("node").alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("members")), "classes")

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield S.mix64(np.array(batch.column(0)).view(np.uint64))

    chosen = spark.sparkContext.broadcast(bloom.build(classes.select("rep"), nodes, "once", log_bits or bloom.LOG_BITS))
    cell_bits = cell_bits or bits_for(classes.agg(F.sum("n_shingles")).first()[0] or 0, CELLS_PER_SHINGLE, CELL_BITS, MOST_CELL_BITS)

    def is_rep(column: pa.Array) -> np.ndarray:
        return chosen.value.test(S.mix64(np.array(column).view(np.uint64)))

    texts = docs.select(S.row_key().alias("node"), "text")
    frequent = spark.sparkContext.broadcast(frequency_classes(texts, is_rep, shingle, log_bits, cell_bits))
    found = S.staged(prefixes(texts, is_rep, frequent, shingle, percent, cell_bits).dropDuplicates(["node"]), "prefixes")
    S.release(chosen, frequent)
    roots = components(links(found, percent=percent, block=block))
    S.discard(found)
    rooted = classes.join(roots, classes["rep"] == roots["node"], "left").withColumn("root", F.coalesce("root", "rep"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("members").alias("size")).where("size > 1").drop("size")
    named = rooted.join(least, "root").select(*same, "root", "component_id")
    return rows.join(named, same, "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents of smallest id of every component, one row each; documents without shingles all stay.

    Decisions are rows of ids. Only rows that go, or that have equal twins, are
    named in the table that meets the texts.
    """
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")
    rows = found.where("n_shingles > 0").select("doc_id", "node", "root")
    keepers = rows.groupBy("root").agg(F.min(order)["node"].alias("keeper"))
    per_node = rows.groupBy("node", "root").agg(F.count(F.lit(1)).alias("twins")).join(keepers, "root")
    odd = per_node.where("node <> keeper OR twins > 1").select(F.col("node").alias("_odd"), (F.col("node") == F.col("keeper")).alias("_stays"))
    marked = docs.withColumn("_node", S.row_key()).join(odd, F.col("_node") == F.col("_odd"), "left")
    plain = marked.where("_odd IS NULL").select(*docs.columns)
    return plain.unionByName(marked.where("_stays").dropDuplicates(["_node"]).select(*docs.columns))
