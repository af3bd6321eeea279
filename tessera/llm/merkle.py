"""Merkle manifest of a dataset: one tree per group of rows, one tree over the groups, a proof for every row.

H is the lower-case hex sha256 of its inputs, digests as hex text. Leaves of a
group ascend by key; a level's nodes are joined in runs of two from the left, and
a last run of one node becomes the H of that one. A lone leaf is the root itself.

1. The leaf digests are range-sorted by (group, key) into partitions of at most
   some `ROWS` rows; a hot group spreads over many of them. Counts by partition
   and group, summed along the partitions, give every row its place in its group.
2. Each partition builds the complete aligned subtrees of its stretch of a group.
   What its parents need from a neighbour are ragged boundary nodes, at most two a
   level, known by (group, level, index).
3. Boundary nodes meet by coordinate: a round joins stripes of 2**top leaves, of
   FAN times more leaves in each round, until every group has one node.
4. The groups' roots are the leaves of the upper tree, built by the same steps.
5. Paths come back the same way, from a stripe's root to its boundary nodes, and a
   second pass over the sorted digests rebuilds the local subtrees for the rest.

Nothing passes through the driver but the number of rows and of the levels.

Defined cases: a null value is `-`; a null group sorts first and is a group of
its own; null keys come first in theirs; rows of one key are ordered by leaf, so
equal rows are leaves of their own next to each other; an empty table gives no
rows; input columns other than the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import support as S

#: Rows of a range partition; what a task holds are their digests.
ROWS = 200_000
#: log2 of how many times more leaves a stripe of boundary nodes spans in the next round.
FAN = 6


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---------------------------------------------------------------- trees, as lists of levels


def level_sizes(n: int) -> list[int]:
    """Nodes of each level, leaves first."""
    out = [n]
    while out[-1] > 1:
        out.append((out[-1] + 1) // 2)
    return out


class Subtrees:
    """Nodes of the levels `first`, `first` + 1, ... of one group that follow from nodes known by (level, index)."""

    def __init__(self, known: dict[tuple[int, int], str], sizes: list[int]):
        self.nodes, self.sizes = known, sizes

    def run(self, first: int, start: int, end: int) -> None:
        """Complete subtrees over the nodes start..end-1 of level `first`."""
        nodes, level = self.nodes, first
        while start < end and level + 1 < len(self.sizes):
            up, size = (start + 1) // 2, self.sizes[level]
            stop = (end + 1) // 2 if end == size else end // 2
            for j in range(up, stop):
                left = nodes[level, 2 * j]
                nodes[level + 1, j] = digest(left, nodes[level, 2 * j + 1]) if 2 * j + 1 < size else digest(left)
            start, end, level = up, stop, level + 1

    def join(self, top: int) -> None:
        """All parents up to level `top` whose children are known; works on few nodes."""
        for level in range(top):
            size = self.sizes[level]
            for j in sorted({i // 2 for k, i in self.nodes if k == level}):
                left, right = self.nodes.get((level, 2 * j)), self.nodes.get((level, 2 * j + 1))
                if (level + 1, j) not in self.nodes and left is not None and (right is not None or 2 * j + 1 == size):
                    self.nodes[level + 1, j] = digest(left, right) if right is not None else digest(left)

    def climb(self, level: int, index: int) -> tuple[list[str], int, int]:
        """Siblings from a node up to its highest known ancestor, and that one's level and index."""
        path = []
        while (level + 1, index // 2) in self.nodes:
            if (other := self.nodes.get((level, index ^ 1))) is not None:
                path.append(other)
            level, index = level + 1, index // 2
        return path, level, index


def fold(leaf: str, place: int, size: int, siblings: Iterator[str]) -> str:
    """The root that follows from a leaf, its place and its siblings."""
    while size > 1:
        if place % 2:
            leaf = digest(next(siblings), leaf)
        elif place + 1 < size:
            leaf = digest(leaf, next(siblings))
        else:
            leaf = digest(leaf)
        place, size = place // 2, (size + 1) // 2
    return leaf


# ---------------------------------------------------------------- leaves


def field(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:`, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def group_key(group: Column) -> Column:
    """Never null and ordered as the group, null first: text compares by its UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit("n"))


# ---------------------------------------------------------------- the distributed tree

_NODES = "grp string, level int, idx long, digest string, size long, part int"
_CLIMBS = "grp string, level int, idx long, up_level int, up_idx long, up_digest string, size long, path array<string>"


def range_sorted(leaves: DataFrame, *, rows: int = ROWS) -> DataFrame:
    """leaves (grp, key, leaf, ...) with `part` and `place`, rows of a part in the order of (grp, key, leaf)."""
    n = leaves.count()
    order = ["grp", F.asc_nulls_first("key"), "leaf"]
    dealt = leaves.repartitionByRange(max(1, -(-n // rows), min(n // 1000, _partitions(leaves))), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    return S.staged(dealt.select("*", F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "merkle-sorted")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def offsets(leaves: DataFrame) -> DataFrame:
    """(part, grp, start, n, size): where a part's rows of a group begin in it; a group has a row for each part that it touches."""
    counts = leaves.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("grp")
    before = F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("part", "grp", F.coalesce(before, F.lit(0)).alias("start"), "n", F.sum("n").over(own).alias("size"))


def _stretches(leaves: pa.Table, where: pa.Table) -> Iterator[tuple[str, int, int, pa.Table, Subtrees]]:
    """By group of one part: group, start, size, its rows in order, its complete subtrees."""
    leaves = leaves.sort_by("place")
    first = 0
    for grp, start, n, size in sorted(zip(*(where.column(k).to_pylist() for k in ("grp", "start", "n", "size")), strict=True)):
        own, first = leaves.slice(first, n), first + n
        known = {(0, start + i): x for i, x in enumerate(own.column("leaf").to_pylist())}
        tree = Subtrees(known, level_sizes(size))
        tree.run(0, start, start + n)
        yield grp, start, size, own, tree


def _ragged(tree: Subtrees, start: int, n: int) -> list[tuple[int, int]]:
    """The highest complete subtrees over the leaves start..start+n-1, as coordinates from left to right."""
    out, i = [], start
    while i < start + n:
        _, level, index = tree.climb(0, i)
        out.append((level, index))
        i = (index + 1) << level
    return out


def _boundary_nodes(leaves: pa.Table, where: pa.Table) -> pa.Table:
    rows = []
    for grp, start, size, own, tree in _stretches(leaves, where):
        rows += [(grp, level, index, tree.nodes[level, index], size) for level, index in _ragged(tree, start, own.num_rows)]
    names = ["grp", "level", "idx", "digest", "size"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
    table = pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(zip(names, kinds, strict=True))})
    part = where.column("part")[0].as_py() if where.num_rows else 0
    return table.append_column("part", pa.array([part] * len(rows), pa.int32()))


def _stripe_climbs(top: int):
    """For the nodes of one stripe of 2**top leaves: siblings up to the stripe's root."""

    def run(nodes: pa.Table) -> pa.Table:
        columns = {k: nodes.column(k).to_pylist() for k in ("grp", "level", "idx", "digest", "size")}
        sizes = level_sizes(columns["size"][0])
        tree = Subtrees({(k, i): d for k, i, d in zip(columns["level"], columns["idx"], columns["digest"], strict=True)}, sizes)
        tree.join(min(top, len(sizes) - 1))
        climbs = [tree.climb(k, i) for k, i in zip(columns["level"], columns["idx"], strict=True)]
        return pa.table(
            {
                "grp": pa.array(columns["grp"], pa.string()),
                "level": pa.array(columns["level"], pa.int32()),
                "idx": pa.array(columns["idx"], pa.int64()),
                "up_level": pa.array([c[1] for c in climbs], pa.int32()),
                "up_idx": pa.array([c[2] for c in climbs], pa.int64()),
                "up_digest": pa.array([tree.nodes[c[1], c[2]] for c in climbs], pa.string()),
                "size": pa.array(columns["size"], pa.int64()),
                "path": pa.array([c[0] for c in climbs], pa.list_(pa.string())),
            }
        )

    return run


def upper_paths(nodes: DataFrame, *, rows: int = ROWS, fan: int = FAN) -> DataFrame:
    """(grp, level, idx, size, root, path) for boundary nodes: their siblings up to the group's root."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    levels, top, rounds = len(level_sizes(largest)) - 1 if largest else 0, max(1, (rows - 1).bit_length()), []
    now = nodes.select("grp", "level", "idx", "digest", "size")
    while True:
        top = min(top + fan, max(levels, 1))
        # a node above the stripe's level is a stripe by itself
        stripe = F.when(F.col("level") < top, F.struct(F.lit(0).alias("level"), F.expr(f"shiftright(idx, {top} - level)").alias("idx"))).otherwise(F.struct(F.col("level").cast("int").alias("level"), F.col("idx").alias("idx")))
        climbs = now.withColumn("stripe", stripe).groupBy("grp", "stripe").applyInArrow(_stripe_climbs(top), _CLIMBS)
        rounds.append(S.staged(climbs, "merkle-climbs"))
        if top >= levels:
            break
        now = rounds[-1].select("grp", F.col("up_level").alias("level"), F.col("up_idx").alias("idx"), F.col("up_digest").alias("digest"), "size").distinct()
    found = rounds[-1].select("grp", "level", "idx", "size", F.col("up_digest").alias("root"), "path")
    for below in reversed(rounds[:-1]):
        above = found.select("grp", F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), "root", F.col("path").alias("above"))
        found = below.join(above, ["grp", "up_level", "up_idx"]).select("grp", "level", "idx", "size", "root", F.concat("path", "above").alias("path"))
    return found


def with_paths(ordered: DataFrame, found: DataFrame, extra: str, finish) -> DataFrame:
    """finish(rows of one stretch, places, size, path of each row, the boundary node's other columns) for all stretches."""

    def run(leaves: pa.Table, paths: pa.Table) -> pa.Table:
        above = {(r["grp"], r["level"], r["idx"]): r for r in paths.to_pylist()}
        # one row for each group that the part touches, from its boundary nodes
        known: dict[str, dict] = {}
        for r in above.values():
            known.setdefault(r["grp"], {"part": r["part"], "grp": r["grp"], "start": r["start"], "n": r["n"], "size": r["size"]})
        where = pa.Table.from_pylist(list(known.values()), pa.schema([("part", pa.int32()), ("grp", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("size", pa.int64())]))
        tables = []
        for grp, start, size, own, tree in _stretches(leaves, where):
            climbs = [tree.climb(0, start + i) for i in range(own.num_rows)]
            tables.append(finish(own, start, size, [(path, above[grp, level, index]) for path, level, index in climbs]))
        return pa.concat_tables(tables)

    return ordered.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(run, extra)


def group_trees(leaves: DataFrame, *, rows: int = ROWS, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """The range-sorted leaves, and (part, grp, start, n, level, idx, size, root, path) of the parts' highest complete subtrees."""
    ordered = range_sorted(leaves, rows=rows)
    where = S.staged(offsets(ordered), "merkle-offsets")
    slim = ordered.select("part", "place", "leaf")
    nodes = S.staged(slim.groupBy("part").cogroup(where.groupBy("part")).applyInArrow(_boundary_nodes, _NODES), "merkle-nodes")
    paths = upper_paths(nodes, rows=rows, fan=fan)
    return ordered, nodes.select("grp", "level", "idx", "part").join(paths, ["grp", "level", "idx"]).join(where.drop("size"), ["part", "grp"])


def _with_upper(own: pa.Table, start: int, size: int, climbs: list) -> pa.Table:
    paths = [path + node["path"] for path, node in climbs]
    return pa.table(
        {
            "key": own.column("key").cast(pa.string()),
            "subroot": own.column("leaf").cast(pa.string()),
            "place": pa.array(range(start, start + own.num_rows), pa.int64()),
            "groups": pa.array([size] * own.num_rows, pa.int64()),
            "root": pa.array([node["root"] for _, node in climbs], pa.string()),
            "path": pa.array(paths, pa.list_(pa.string())),
        }
    )


def _verified(own: pa.Table, start: int, size: int, climbs: list) -> pa.Table:
    leaf, tampered = own.column("leaf").to_pylist(), own.column("tampered").to_pylist()
    proofs, folded, roots, subroots = [], [], [], []
    for i, (path, node) in enumerate(climbs):
        siblings = path + node["path"] + node["upper"]
        rest = iter(siblings)
        sub = fold(leaf[i] if tampered[i] is None else tampered[i], start + i, size, rest)
        folded.append(fold(sub, node["group_place"], node["groups"], rest))
        proofs.append(siblings)
        roots.append(node["top"])
        subroots.append(node["root"])
    out = {k: own.column(k) for k in own.column_names if k not in ("grp", "part", "place", "tampered")}
    texts = {"subroot": subroots, "root": roots, "folded_root": folded}
    return pa.table(out | {k: pa.array(v, pa.string()) for k, v in texts.items()} | {"place": pa.array(range(start, start + own.num_rows), pa.int64()), "proof": pa.array(proofs, pa.list_(pa.string()))})


def manifest(leaves: DataFrame, *, rows: int = ROWS, fan: int = FAN) -> DataFrame:
    """(key, leaf, subroot, root, folded_root, place, proof) of every row of leaves (grp, key, leaf, tampered).

    `grp` sorts the groups and is not null (see group_key). `proof` lists the
    siblings from the leaf via the group's root to the root, and folded_root is
    what follows from it and the leaf, or from `tampered` where that is not null.
    """
    spark = leaves.sparkSession
    S.small_batches(spark)
    held = S.staged(leaves.select("grp", "key", "leaf", "tampered"), "merkle-leaves")
    ordered, nodes = group_trees(held, rows=rows, fan=fan)
    nodes = S.staged(nodes, "merkle-paths")
    roots = nodes.groupBy("grp").agg(F.first("root").alias("leaf")).select(F.lit("all").alias("grp"), F.col("grp").alias("key"), "leaf")
    upper_leaves, upper_nodes = group_trees(S.staged(roots, "merkle-subroots"), rows=rows, fan=fan)
    upper = S.staged(with_paths(upper_leaves, upper_nodes, "key string, subroot string, place long, groups long, root string, path array<string>", _with_upper), "merkle-upper")
    named = upper.select(F.col("key").alias("grp"), F.col("place").alias("group_place"), "groups", F.col("root").alias("top"), F.col("path").alias("upper"))
    kind = leaves.schema["key"].dataType.simpleString()
    schema = f"key {kind}, leaf string, subroot string, root string, folded_root string, place long, proof array<string>"
    return with_paths(ordered, nodes.join(named, "grp"), schema, _verified)


TAMPERED = 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest_of(docs: DataFrame, *, rows: int = ROWS, fan: int = FAN) -> DataFrame:
    """The manifest of documents by lang; where TAMPERED divides crc32(doc_id), n_chars is tampered with by 1."""
    values = {k: F.col(k) for k in COLUMNS}
    changed = leaf_of(*(values | {"n_chars": F.col("n_chars") + 1}).values())
    chosen = (F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select(group_key(F.col("lang")).alias("grp"), F.col("doc_id").alias("key"), leaf_of(*values.values()).alias("leaf"), F.when(chosen, changed).alias("tampered"))
    return manifest(leaves, rows=rows, fan=fan)


ORACLE = r"""
WITH RECURSIVE
-- crc32 of a short text, by its reflected polynomial
steps AS (SELECT i AS n, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
docs AS (
  SELECT row_number() OVER () AS r, d.*,
         xor(4294967295::BIGINT, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) % 7 = 0 AND n_chars IS NOT NULL AS bad
  FROM documents d, crc),
field AS (
  SELECT r, doc_id, lang, bad,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS own,
    coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS other,
    coalesce(strlen(text) || ':' || text, '-') AS body FROM docs),
leaves AS (
  SELECT r, doc_id, lang, bad, sha256(head || own || body) AS leaf, CASE WHEN bad THEN sha256(head || other || body) ELSE sha256(head || own || body) END AS shown
  FROM field),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
-- every level of every language's tree
tree AS (
  SELECT lang, 0 AS k, i, leaf AS h, n FROM placed
  UNION ALL
  SELECT lang, k + 1, i // 2, sha256(h || coalesce(nxt, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (PARTITION BY lang ORDER BY i) AS nxt FROM tree WHERE n > 1) WHERE i % 2 = 0),
sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS n FROM tree WHERE n = 1),
above AS (
  SELECT 0 AS k, g AS i, h, n FROM sub
  UNION ALL
  SELECT k + 1, i // 2, sha256(h || coalesce(nxt, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (ORDER BY i) AS nxt FROM above WHERE n > 1) WHERE i % 2 = 0),
-- each row's way up: its language's tree, then the tree of languages
walk AS (
  SELECT p.r, t.k, (p.i >> t.k) AS at, t.n, s.h AS other
  FROM placed p JOIN (SELECT DISTINCT lang, k, n FROM tree WHERE n > 1) t ON p.lang IS NOT DISTINCT FROM t.lang
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM p.lang AND s.k = t.k AND s.i = xor(p.i >> t.k, 1)
  UNION ALL
  SELECT p.r, 1000 + t.k, (u.g >> t.k), t.n, s.h
  FROM placed p JOIN sub u ON p.lang IS NOT DISTINCT FROM u.lang JOIN (SELECT DISTINCT k, n FROM above WHERE n > 1) t ON true
  LEFT JOIN above s ON s.k = t.k AND s.i = xor(u.g >> t.k, 1)),
steps_up AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY k) AS s FROM walk),
proofs AS (SELECT r, sha256(coalesce(string_agg(other, '' ORDER BY s), '')) AS proof FROM steps_up GROUP BY r),
folded AS (
  SELECT r, shown AS h, 0::BIGINT AS s FROM leaves
  UNION ALL
  SELECT f.r, sha256(CASE WHEN u.at % 2 = 1 THEN u.other || f.h ELSE f.h || coalesce(u.other, '') END), u.s
  FROM folded f JOIN steps_up u ON u.r = f.r AND u.s = f.s + 1),
ends AS (SELECT r, arg_max(h, s) AS h FROM folded GROUP BY r),
root AS (SELECT h FROM above WHERE n = 1)
SELECT p.doc_id, p.leaf, u.h AS subroot, root.h AS root, coalesce(q.proof, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = root.h AS verified
FROM placed p JOIN sub u ON p.lang IS NOT DISTINCT FROM u.lang JOIN ends e ON e.r = p.r LEFT JOIN proofs q ON q.r = p.r, root
"""
