"""What the fourth round's findings asked for, on small inputs."""

import random

import numpy as np

from pyspark.sql import functions as F


def test_rows_of_a_stream_are_small(spark):
    """a chunk is many small rows, so neither Parquet's writer nor its reader holds whole chunks; names of all its rows meet again."""
    from tessera.llm import bloom
    from tessera.llm import collocations as C

    rng = random.Random(7)
    text = " ".join(f"w{rng.randrange(300)}" for _ in range(4000))
    docs = spark.createDataFrame([(text, "en")] * 2 + [("w1 w2", "de")], "text string, lang string").coalesce(1)
    every = spark.sparkContext.broadcast(bloom.Bloom(np.full(1 << 13, 255, np.uint8), 16))
    stream = C.text_stream(docs, every, every, every)
    rows = stream.collect()
    assert len({r.chunk % (1 << C.CHUNK_BITS) for r in rows}) == 1 and len(rows) > 20
    assert max(len(r[c]) for r in rows for c in ("codes", "left", "right", "n")) == C.PIECE
    words = [*text.split()]
    assert sum(sum(r.n) for r in rows) == 2 * (len(words) - 1) + 1
    pairs = C.name_pairs(stream, 2)
    following = C.next_stream(stream, pairs).collect()
    assert max(len(r.left) for r in following) == C.PIECE
    assert sum(sum(r.n) for r in following) == 2 * (len(words) - 2)
    triples = {(words[i], words[i + 1], words[i + 2]) for i in range(len(words) - 2)}
    assert len({x for r in following for x in zip(r.left, r.right, strict=True)}) == len(triples)


def _linked_names(spark, seed, files, names, hot=3):
    """Definitions and calls of files, some of them alike, and the callers of every file."""
    rng = random.Random(seed)
    pick = lambda most: {f"n{rng.randrange(hot if rng.random() < 0.4 else names)}" for _ in range(rng.randrange(most))}
    own = [(pick(4), pick(9)) for _ in range(files // 2)]
    own = [rng.choice(own) if rng.random() < 0.7 else (pick(30), pick(60)) for _ in range(files)]
    want = {f"f{j}": n for j, (d, _) in enumerate(own) if (n := sum(bool(c & d) for i, (_, c) in enumerate(own) if i != j))}
    rows = lambda k: [(f"f{i}", x) for i, sides in enumerate(own) for x in sides[k]]
    schema = "path string, name string"
    return spark.createDataFrame(rows(0) + [(None, "n1")], schema), spark.createDataFrame(rows(1) + [("f1", None)], schema), want


def test_callers_are_counted_by_sets(spark):
    """sets of names meet as numbers, each caller a bit; bitmaps and lists, of any number of files, give the same counts."""
    import pyarrow as pa

    from tessera.operators import graph

    defs, calls, want = _linked_names(spark, 3, 300, 90)
    for files in (11, 1 << 16):
        assert {r.node: r.fan_in for r in graph.callers_of(defs, calls, "path", block_files=files).collect()} == want
    assert graph.callers_of(defs.where("false"), calls, "path").count() == 0
    rng = random.Random(4)
    sets = [(i if i < 60 else None, 1 + rng.randrange(5) ** 3, rng.sample(range(40), rng.randrange(1, 9))) for i in range(400)]
    table = pa.table({"id": pa.array([r[0] for r in sets], pa.int64()), "n": pa.array([r[1] for r in sets], pa.int64()), "names": pa.array([r[2] for r in sets], pa.list_(pa.int32()))})
    met = {i: sum(n for k, n, c in sets if k is None and set(c) & set(own)) for i, _, own in sets[:60]}
    for words, nbytes, worth in ((1, 1 << 26, 16), (1 << 16, 1 << 26, 16), (1 << 16, 1, 16), (2, 200, 0), (40, 1 << 26, 1 << 20)):
        graph_was = graph.BITMAP_BYTES, graph.CALLER_WORDS
        graph.BITMAP_BYTES, graph.CALLER_WORDS = nbytes, worth
        try:
            out = graph._reached(table, words).to_pylist()
        finally:
            graph.BITMAP_BYTES, graph.CALLER_WORDS = graph_was
        assert {r["id"]: r["n"] for r in out} == met


def test_few_copies_of_names_shuffle(spark):
    """What meets in blocks is numbers, once a set."""
    from tessera.operators import graph

    defs, calls, want = _linked_names(spark, 5, 200, 40)
    d, c = graph._coded(defs, calls, "path", "name")
    assert dict(d.dtypes)["names"] == "array<int>" and d.where("names <> array_sort(array_distinct(names))").count() == 0
    both = {r.name for r in defs.select("name").intersect(calls.where("path IS NOT NULL").select("name")).collect()}
    assert {x for side in (d, c) for r in side.collect() for x in r.names} == set(range(1, len(both - {None}) + 1))
    blocks = graph._alike(defs, calls, "path", "name", 1 << 14)
    assert dict(blocks.dtypes)["names"] == "array<int>"
    edges = graph.call_edges(defs, calls, "path")
    assert {r.node: r.fan_in for r in graph.fan_in(edges).collect()} == want
