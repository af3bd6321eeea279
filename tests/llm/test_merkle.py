"""The Merkle manifest against a recursive tree in plain Python, over many small partitions and stripes."""

import hashlib
import zlib

import pytest
from compare import difference, duck
from pyspark.sql import functions as F

from tessera.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, add=0):
    doc_id, text, lang, source, n_chars = row
    return sha("".join(map(enc, (doc_id, source, lang, None if n_chars is None else n_chars + add, text))))


def proofs(leaves):
    """Root, and for each leaf the siblings and the way to fold another leaf in."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, a in enumerate(at):
            other = a ^ 1
            paths[i].append((a % 2, level[other] if other < len(level) else None))
            at[i] = a // 2
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], paths


def folded(h, path):
    for right, other in path:
        h = sha((other or "") + h if right else h + (other or ""))
    return h


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    out, built = [], {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[g] = (own, *proofs([leaf(r) for r in own]))
    root, above = proofs([built[g][1] for g in order])
    for g, up in zip(order, above, strict=True):
        own, sub, paths = built[g]
        for r, path in zip(own, paths, strict=True):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            way = path + up
            end = folded(leaf(r, int(bad)), way)
            out.append((r[0], leaf(r), sub, root, sha("".join(x for _, x in way if x)), end, end == root))
    return sorted(out, key=repr)


def rows_of(n, groups):
    rows = [(i, f"text {i} é\n", f"l{i * i % groups}", f"s{i % 3}", i % 50) for i in range(n)]
    return rows


def got_rows(spark, data, parts=3, **settings):
    docs = spark.createDataFrame(data, SCHEMA).repartition(parts).withColumns({"grp": F.lit("x"), "leaf": F.lit(1), "part": F.lit(2)})
    found = merkle.manifest_of(docs, **settings)
    out = found.select("key", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256), "folded_root", F.col("folded_root") == F.col("root"))
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize(("n", "groups", "rows", "fan"), [(61, 1, 4, 1), (90, 3, 7, 2)])
def test_equals_a_plain_tree_over_ragged_partitions(spark, n, groups, rows, fan):
    data = rows_of(n, groups)
    assert got_rows(spark, data, rows=rows, fan=fan) == expected(data)


def test_nulls_ties_repeats_and_long_texts(spark):
    data = rows_of(20, 2)
    data += [(None, None, None, None, None), (None, "a", None, "s", 1), (7, "other", "l0", None, None), (500, "x" * 3_000_000, "", "", 3), (501, "", "é", "s", 0)]
    data += data[:9] + [data[3]] * 4
    got = got_rows(spark, data, rows=6, fan=1)
    assert got == expected(data)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_one_row_and_none(spark):
    one = [(1, "t", None, "s", 5)]
    assert got_rows(spark, one) == expected(one)
    assert got_rows(spark, one)[0][4] == sha("")
    assert spark.createDataFrame([], SCHEMA).transform(merkle.manifest_of).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_subtrees_of_any_cut_join_to_the_root(n):
    leaves = [sha(str(i)) for i in range(n)]
    for cut in range(n + 1):
        sizes, nodes = merkle.level_sizes(n), {}
        for start, end in ((0, cut), (cut, n)):
            tree = merkle.Subtrees({(0, i): leaves[i] for i in range(start, end)}, sizes)
            tree.run(0, start, end)
            nodes |= {c: tree.nodes[c] for c in merkle._ragged(tree, start, end - start)}
        assert len(nodes) <= 2 * len(sizes)
        whole = merkle.Subtrees(nodes, sizes)
        whole.join(len(sizes) - 1)
        assert whole.nodes[len(sizes) - 1, 0] == proofs(leaves)[0]


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    ours = queries.QUERIES["op11_merkle_manifest"](spark, sf).toPandas()
    assert difference(ours, duck(sf).execute(merkle.ORACLE).df()) == ""
