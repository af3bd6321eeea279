"""What the third round's findings asked for, on small inputs."""

import random

from pyspark.sql import functions as F

from tessera.operators import graph, graph_store, source_index


def _names(spark, seed, files=40, names=12):
    rng = random.Random(seed)
    pick = lambda most: [(f"f{i}", f"n{rng.randrange(names)}") for i in range(files) for _ in range(rng.randrange(most))]
    defs, calls = pick(4), pick(7) + [(None, "n1"), ("f1", None)]
    weights = {}
    for name in {n for _, n in defs}:
        for a in {f for f, n in calls if n == name and f}:
            for b in {f for f, n in defs if n == name and f != a}:
                weights[a, b] = weights.get((a, b), 0) + 1
    schema = "path string, name string"
    return spark.createDataFrame(defs, schema), spark.createDataFrame(calls, schema), weights


def test_call_edges_in_blocks(spark):
    """pairs are counted in the block in which their files meet, for any size of blocks."""
    defs, calls, weights = _names(spark, 1)
    for files in (7, 4096):
        found = graph.call_edges(defs, calls, "path", block_files=files).collect()
        assert len(found) == len(weights) and {(r.caller, r.callee): r.weight for r in found} == weights
    table = graph._blocks(defs, calls, "path", "name", 4096).toArrow()
    few = [x for _, _, x in graph._counted(table, cells=64)]
    assert sum(int(x.sum()) for x in few) == sum(weights.values()) and max(x.size for x in few) <= 64
    assert graph.call_edges(defs.where("false"), calls, "path").count() == 0


def test_edges_leave_python_as_lists(spark):
    """files of equal names are counted once; lists of callers and callees are what a task hands over, none longer than it may be."""
    files = [(f"s{i}", f"n{i % 3}", f"n{(i + 1) % 3}") for i in range(90)]
    defs = spark.createDataFrame([f[:2] for f in files], "path string, name string")
    calls = spark.createDataFrame([(p, n) for p, *own in files for n in own], "path string, name string")
    table = graph._alike(defs, calls, "path", "name", 4096).toArrow()
    assert table.num_rows == 6
    for most, cells in ((7, 40), (128, 1 << 18)):
        rows = [r for batch in graph._linked(table, cells, most) for r in batch.to_pylist()]
        found = [(a, b, r["weight"]) for r in rows for a in r["callers"] for b in r["callees"] if a != b]
        assert sorted(found) == sorted((a, b, 1) for a, n, m in files for b, x, _ in files if x in (n, m) and a != b)
        assert max(len(r[c]) for r in rows for c in ("callers", "callees")) <= most and len(rows) < len(found) / 30
    for seed, size in ((4, 5), (5, 4096)):
        defs, calls, weights = _names(spark, seed, names=4)
        got = graph.call_edges(defs, calls, "path", block_files=size).collect()
        assert len(got) == len(weights) and {(r.caller, r.callee): r.weight for r in got} == weights


def test_the_stored_graph_grows_with_its_sets(spark, tmp_path):
    """a store keeps links between sets of names, not edges; links of sets that stay are kept, the others are made anew."""

    def names(files):
        return spark.createDataFrame(files, "path string, definitions array<string>, calls array<string>")

    def edges(files):
        return sorted((a, b, n) for a, _, called in files for b, defined, _ in files if a != b and (n := len(set(called) & set(defined))))

    was = [(f"f{i}", [f"n{i % 3}"] if i % 4 else [], [f"n{(i + 1) % 3}", f"n{i % 3}"]) for i in range(60)]
    now = [(p, d, ["n0", "n1", "n2"]) if p in ("f5", "f6") else (p, ["n1", "n0"], c) if p == "f7" else (p, d, c) for p, d, c in was if p != "f9"]
    before, after = (graph_store.with_sets(names(x)) for x in (was, now))
    links = graph_store._links(graph_store._sets(before, "called"), graph_store._sets(before, "defined"))
    assert links.count() == 6
    made = {(r.called, r.defined): r.weight for r in graph_store.updated_links(links.withColumn("weight", F.lit(99)), before, after).collect()}
    assert sorted(made.values()) == [1, 1, 1, 1, 1, 2, 2] + [99] * 6
    for files, own, got in ((was, before, links), (now, after, graph_store.updated_links(links, before, after))):
        found = graph.edges_of_sets(got, own, "path").collect()
        assert sorted((r.caller, r.callee, r.weight) for r in found) == edges(files)
    files = spark.createDataFrame([(f"s{i}", "python", f"def run{i % 3}(a):\n    run{(i + 1) % 3}(a)\n") for i in range(60)], "path string, lang string, text string")
    got = graph_store.refresh(spark, f"{tmp_path}/store", files, files.select("path", F.lit(1).alias("modified"), F.lit(1).alias("bytes")))
    assert spark.read.parquet(f"{tmp_path}/store/v0/links").count() <= 6 and got.edges.count() > 2000


def test_fan_in_without_edges(spark):
    """callers are counted from the names."""
    defs, calls, weights = _names(spark, 2)
    want = {}
    for _, b in weights:
        want[b] = want.get(b, 0) + 1
    assert {r.node: r.fan_in for r in graph.callers_of(defs, calls, "path", block_files=9).collect()} == want


def test_first_callers_without_edges(spark):
    """Entry points and fan_in of files do not need the call graph."""
    defs, calls, weights = _names(spark, 3)
    want = {b: sorted(a for a, x in weights if x == b)[:3] for _, b in weights}
    assert {r.node: r.callers for r in graph.first_callers(defs, calls, "path", 3).collect()} == want
    files = [(f"s{i}.py", "python", f"def run{i % 3}(a):\n    run{(i + 1) % 3}(a)\n    mask_value(a)\n") for i in range(30)]
    own = source_index.scan(spark.createDataFrame(files, "path string, lang string, text string"))
    edges = source_index.call_graph(own)
    assert source_index.candidates(own, points=source_index.entry_points(own)).exceptAll(source_index.candidates(own, edges)).count() == 0
    assert source_index.skeleton(own).exceptAll(source_index.skeleton(own, edges)).count() == 0
    assert source_index.skeleton(own).agg(F.sum("fan_in")).first()[0] == edges.count()


def test_whole_jobs_of_the_graph_queries(spark):
    """Every edge of all names, callers beside calls, suppliers' parts, and four steps over the dense graph."""
    from tessera.plans import views as V
    from tessera.plans.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    run = lambda name: QUERIES[name](spark, sf)
    edges = {(r.caller, r.callee, r.weight) for r in run("call_edges").collect()}
    assert {(r.caller, r.callee, r.weight) for r in run("call_edges_all_names").collect()} == edges
    assert {(r.node, r.fan_in) for r in run("fan_in_all_names").collect()} == {(r.node, r.fan_in) for r in run("fan_in").collect()}
    dense = {(r.caller, r.callee) for r in V.all_edges(spark, sf).collect()}
    assert {r.node for r in run("scope_applicable").collect()} == {b for a, b in dense if a in ("s1", "s2", "s3")}
    near = {}
    for a, b in dense:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    depth, level = dict.fromkeys(("s1", "s2", "s3"), 0), {"s1", "s2", "s3"}
    for d in range(1, 5):
        level = {x for a in level for x in near.get(a, ()) if x not in depth}
        depth |= dict.fromkeys(level, d)
    assert {r.node: r.depth for r in run("bfs_scope_all_edges").collect()} == depth
    sevens = {a for a, _ in dense if a.endswith("7")}
    assert {r.node for r in run("unresolved_all_edges").collect()} == sevens - set(depth)
    roles = {(r.node, r.role) for r in run("scope_manifest_all_edges").collect()}
    assert {x for x, role in roles if role == "in_scope"} == set(depth)
    for name in ("bfs_scope_all_edges", "scope_manifest_all_edges", "unresolved_all_edges"):
        assert "r.depth < 4" in ORACLES[name]


def test_filters_of_the_join_follow_the_input(spark):
    """lone shingles stay out of the prefixes, whatever the number of shingles."""
    from tessera.llm import jaccard_join as J

    assert [J.bits_for(n, J.CELLS_PER_SHINGLE, J.CELL_BITS, J.MOST_CELL_BITS) for n in (0, 1 << 27, 1 << 30, 1 << 40)] == [32, 32, 34, 40]
    assert [J.bits_for(n, J.BITS_PER_KEY, 27, J.MOST_LOG_BITS) for n in (10, 1 << 25, 1 << 30)] == [27, 28, 29]
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0] + " end"])], "doc_id long, text string").selectExpr("doc_id AS node", "text")
    every = lambda column: [True] * len(column)
    sent = {}
    for cells in (6, 36):
        frequent = spark.sparkContext.broadcast(J.frequency_classes(docs, every, J.SHINGLE, None, cells))
        sent[cells] = {r.node for r in J.prefixes(docs, every, frequent, J.SHINGLE, J.PERCENT, cells).collect()}
    assert len(sent[6]) == 41 and sent[36] == {0, 40}


def test_chunks_are_named_one_by_one(spark):
    """names meet their chunk in a group of its own; no aggregate holds lists of several chunks."""
    from tessera.llm import collocations as C

    stream = spark.createDataFrame([(k, 2, [0, 1, -1, 1], [1, 2], [2, 3], [1, 2]) for k in range(3)] + [(9, 1, [0], [7], [8], [1])], C._STREAM)
    pairs = spark.createDataFrame([(100, 1, 2, 30), (101, 2, 3, 60)], "id long, left long, right long, f long")
    following = C.next_stream(stream, pairs)
    assert sorted((r.chunk, r.linked, r.left, r.right, r.n) for r in following.collect()) == [(k, 0, [100], [101], [1]) for k in range(3)]
    assert "ObjectHashAggregate" not in following._jdf.queryExecution().executedPlan().toString()


def test_globs_meet_paths_by_their_whole_run(spark):
    """globs without literal ends meet only the paths that hold their longest run."""
    from tessera.operators import matching

    globs = [f"*/fr/{i}*" for i in range(20)] + ["*er?", "*[ab]x/en/7?"]
    paths = [f"http://h/fr/{i}/x" for i in range(40)] + ["qbx/en/71", "der"]
    made = matching.glob_pairs(spark.createDataFrame([(p,) for p in paths], "p string"), "p", spark.createDataFrame([(g,) for g in globs], "g string"), "g")
    want = {(f"*/fr/{i}*", f"http://h/fr/{j}/x") for i in range(20) for j in range(40) if str(j).startswith(str(i))}
    assert {(r.pattern, r.path) for r in made.collect()} == want | {("*[ab]x/en/7?", "qbx/en/71")}
    runs = matching._patterns(spark.createDataFrame([(g,) for g in globs], "g string"), "g").where("_kind = 'run'")
    # as many keys as runs: before, all twenty shared the first three characters of theirs
    assert runs.select("_key").distinct().count() == runs.select("_run").distinct().count()


def test_tasks_of_a_scan_follow_the_files(spark, monkeypatch):
    """files are dealt over tasks by their number, not by the bytes they are made of."""
    monkeypatch.setattr(source_index, "TASK_FILES", 10)
    files = spark.range(200, numPartitions=1).selectExpr("concat('f', id) AS path", "'python' AS lang", "concat('def run', id, '(a):') AS text")
    scanned = source_index.scan(files)
    assert scanned.rdd.getNumPartitions() == 20 and scanned.count() == 200


def test_lines_of_a_report_do_not_shuffle(spark, tmp_path):
    """lines are made behind the shuffle, written compressed, and find their places where they are read."""
    import gzip
    import json

    from tessera.operators import document
    from tessera.plans.queries import QUERIES

    findings = spark.createDataFrame([(i, f"CWE-{i % 7}", f"a/b{i}.java:{i}") for i in range(300)], "n int, cwe string, source_ref string").repartition(5)
    rows = document.report_rows(findings, ["n"], tool="t")
    assert "line" not in rows.columns
    document.write_document(rows, f"{tmp_path}/r", part_lines=40, made=document.lines_of, compression="gzip")
    parts = sorted((tmp_path / "r").glob("part-*.gz"))
    run = json.loads(gzip.decompress(b"".join(p.read_bytes() for p in parts)))["runs"][0]
    assert len(parts) > 3 and [r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in run["results"]] == [max(1, i) for i in range(300)]
    found = {}
    for r in document.read_lines(spark, f"{tmp_path}/r").collect():
        found.setdefault(r.name, {})[r.n] = r.line
    assert {name: [own[n] for n in range(len(own))] for name, own in found.items()} == {p.name: gzip.decompress(p.read_bytes()).decode().splitlines() for p in parts}
    document.write_document(document.report_lines(findings, ["n"], tool="t"), f"{tmp_path}/plain", part_lines=1000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # a file in many blocks
    try:
        back = document.read_lines(spark, f"{tmp_path}/plain")
        assert back.rdd.getNumPartitions() > 5 and "".join(r.line for r in sorted(back.collect(), key=lambda r: r.n)) == gzip.decompress(b"".join(p.read_bytes() for p in parts)).decode().replace("\n", "")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plan = QUERIES["report_document"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("+- Window [") == 1


def test_script_calls_are_found_in_each_row(spark):
    """no shuffle, sort or window holds the lines of documents; line numbers are those of the text, whatever rows share a key."""
    from tessera.operators import invocations as calls

    text = "one\n```bash\npy a.py -x \\\n  --y\necho\npy b.py \\\\\n -z\npy c.py\\```\n\n```bash\n\npy d.py\n```\nsee ```bash\npy e.py -q``` on\n```bash\npy never.py\n"
    found = calls.invocations(spark.createDataFrame([(1, text), (1, "```bash\npy f.py\n```"), (2, None), (3, "```bash\n```")], "id int, text string"), "id")
    want = [(1, 2, "f.py", []), (1, 3, "a.py", ["-x", "--y"]), (1, 6, "b.py", ["-z"]), (1, 8, "c.py", []), (1, 12, "d.py", []), (1, 15, "e.py", ["-q"])]
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Exchange", "Sort", "Window", "Aggregate") if x in plan]
    many = "".join(f"x\n```bash\npy s.py -a{i}\n```\n" for i in range(3000)) + "```bash\n" + "py t.py\n" * 20000
    assert [tuple(r) for r in calls.invocations(spark.createDataFrame([(1, many)], "id int, text string"), "id").select("line_no", F.col("flags")[0]).collect()] == [(4 * i + 3, f"-a{i}") for i in range(3000)]


def test_duplicates_are_folded_by_one_shuffle(spark):
    """findings of a key meet once; of equal ones one is canonical, as in deduped()."""
    from tessera.operators import dedup

    rows = [(f"i{i % 9}", f"t{i}", "A\\b.java" if i % 2 else "a/B.java", " cwe-1" if i % 3 else None, i % 4, None if i % 5 == 0 else i % 3 / 2, i // 2) for i in range(60)] + [("same", "t", "z.java", "", 7, 0.5, 1)] * 3
    findings = spark.createDataFrame(rows, "id string, title string, file string, cwe string, line_start int, confidence double, n int")
    groups = {}
    for r in rows:
        groups.setdefault((r[2].replace("\\", "/").lower(), (r[3] or "").strip().upper(), r[4] // 5), []).append(r)
    want = []
    for own in groups.values():
        own.sort(key=lambda r: (-(r[5] or 0.0), r[6], r[0], r[1]))
        want.append((own[0], [(r[0], r[1], r[2], r[4]) for r in own[1:]] or None))
    out = dedup.with_duplicates(findings, ["n"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = [(tuple(r)[:-1], r.duplicates and [tuple(d) for d in r.duplicates]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and out.columns == [*findings.columns, "duplicates"]
    assert len(got) == dedup.deduped(findings, ["n"]).count()
    assert dedup.with_duplicates(findings, [-F.col("n")], fields=("id",), columns=("id",)).columns == ["id", "duplicates"]
