"""Pattern matching, lineage, presence rules, cover, script calls and the streamed memory against plain Python."""

import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import gates, lineage, matching
from tessera.operators import invocations as calls
from tessera.streaming import memory


def norm(p):
    return p.replace("\\", "/").strip("/")


def test_globs_meet_paths_like_a_check_of_all_pairs(spark):
    rng = random.Random(1)
    names = ["src", "main", "A.java", "b.py", "x", "Test", "a b", "é", "[z]", "v1.2"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(150)}) + ["/src/main/", "src\\main\\A.java", "", "/", "a+b(c)", "A.JAVA"]
    bits = ["*", "**", "?", "src", "/", "main", ".java", ".", "[ab]", "[!ab]", "[a-m]*", "x", "Test", "[", "]", "é", "1.2", "+b(c)", "[z"]
    globs = sorted({"".join(rng.choice(bits) for _ in range(rng.randint(1, 5))) for _ in range(400)}) + ["*", "?", "*.java", "src/**", "", "src/main/A.java", "*ain*", "/src/main/"]
    got = matching.glob_pairs(spark.createDataFrame([(p,) for p in [*paths, *paths[:5], None]], "file string"), "file", spark.createDataFrame([(g,) for g in [*globs, None]], "glob string"), "glob")
    want = {(g, p) for g in globs for p in paths if norm(p) and norm(g) and fnmatch.fnmatchcase(norm(p), norm(g))}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(want) > 300


def test_controls_in_scope(spark):
    controls = [(1, ["src/*.java"], []), (2, None, ["src/a/B.java"]), (3, [], ["lib/x"]), (4, ["*"], None), (5, None, None), (6, ["SRC/*"], ["sr"]), (7, ["nothing/**"], ["src/a/"])]
    df = spark.createDataFrame(controls, "id int, protects array<string>, entry_points array<string>")
    scope = spark.createDataFrame([("/src/a",), ("src\\a\\C.java",), (None,), ("",)], "path string")
    assert {r.id for r in matching.controls_in_scope(df, "id", "protects", "entry_points", scope, "path").collect()} == {1, 2, 4, 7}


def test_contained_probes_of_many_lengths(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc/") for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "é" * 9]
    probes = ["".join(rng.choice("abc/") for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None, "éé", "ééééééééé", "é" * 10]
    got = matching.contained_in(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(p,) for p in probes], "p string"), "p").collect()
    assert {tuple(r) for r in got} == {(t, p) for t in texts if t for p in probes if p and p in t}
    none = spark.createDataFrame([], "p string")
    assert matching.contained(spark.createDataFrame([("a",)], "t string"), "t", none, "p").count() == 0


def test_overlaps_ignore_case_and_slashes(spark):
    controls = spark.createDataFrame([(1, ["SRC\\A.java"]), (2, ["x/src/a.JAVA/y"]), (3, ["b"]), (4, [""])], "id int, points array<string>")
    files = spark.createDataFrame([("src/a.java",)], "file string")
    assert {r.id: r.file_overlap for r in gates.overlapping(controls, "id", "points", files, "file").collect()} == {1: True, 2: True, 3: False, 4: False}


def test_versions_pass_along_chains_branches_and_cycles(spark):
    rng = random.Random(3)
    chain = [(f"c{i}", f"c{i + 1}") for i in range(9)]
    edges = chain + [(f"x{rng.randrange(12)}", f"x{rng.randrange(12)}") for _ in range(16)] + [("c9", "x1"), (None, "x2")]
    appended = [("c0", 5), ("c4", 3), ("c6", 9), ("x3", 7), ("x5", None), ("x3", 2)]
    want = {}
    versions = {}
    for n, v in appended:
        if v is not None:
            versions[n] = max(v, versions.get(n, v))
    for start, v in versions.items():
        seen, todo = set(), [b for a, b in edges if a == start]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [b for a, b in edges if a == n]
        for n in seen:
            want[n] = max(v, want.get(n, v))
    flow = spark.createDataFrame(edges, "node string, downstream string")
    new = spark.createDataFrame(appended, "node string, version int")
    assert {r.node: r.version for r in lineage.upstream_versions(flow, new).collect()} == want
    markers = spark.createDataFrame([("c0", 1, 4), ("c5", 2, 4), ("c5", 3, 5), ("c9", 4, 8), ("c9", 5, None), ("y", 6, 0)], "tier string, unit int, made_at int")
    assert {(r.unit, r.stale_since) for r in lineage.stale_markers(markers, flow, new).collect()} == {(2, 5), (4, 9), (5, 9)}
    assert lineage.upstream_versions(flow, new.limit(0)).count() == 0


def test_presence_rules_and_cover(spark):
    rules = spark.createDataFrame([("marker without inventory", "t2.done", "inventory", True), ("inventory without marker", "inventory", "t2.done", True), ("failed beside done", "failed", "done", False)], "issue string, given string, other string, wanted boolean")
    present = spark.createDataFrame([("a", "t2.done"), ("b", "inventory"), ("b", "t2.done"), ("c", "inventory"), ("d", "done"), ("d", "failed"), ("d", "done"), ("e", "other")], "run string, artifact string")
    got = {(r.run, r.issue) for r in lineage.broken_implications(present, rules).collect()}
    assert got == {("a", "marker without inventory"), ("c", "inventory without marker"), ("d", "failed beside done")}
    groups = spark.createDataFrame([("g1", "a"), ("g1", "a"), ("g2", "b"), ("g3", "b"), ("g3", "z"), ("g4", "z"), ("g4", None), *[(f"h{i}", "hot") for i in range(500)]], "g string, m string")
    universe = spark.createDataFrame([("a",), ("b",), ("lone",), ("lone",), ("hot",), (None,)], "m string")
    assert {tuple(r) for r in lineage.cover(groups, "g", "m", universe).collect()} == {("b", "several", 2), ("z", "several", 2), ("z", "unknown", 2), ("lone", "uncovered", 0), ("hot", "several", 500)}


def plain_calls(text):
    for block in re.findall(r"```bash\n(.*?)```", text, re.DOTALL):
        for line in re.sub(r"\\\n", " ", block).split("\n"):
            line = line.strip(" \t\r\f\x0b")
            if line.startswith("py ") and (m := re.search(r"([\w-]+\.py)", line)):
                yield m.group(1), re.findall(r"(?<![\w-])(--?[a-zA-Z][\w-]*)", line)


def test_script_calls_equal_the_pattern_on_random_texts(spark):
    rng = random.Random(4)
    bits = ["```bash\n", "```", "```\n", "\n", "py a/b-c.py --x-y -z", "  py d.py \\\n", " --more=1", "py none", "text```bash\n", "echo py e.py\n", "\\\n", "x --no", "```bash", "\\", "py f.py-g --h\n"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 18)))) for i in range(1500)] + [(9000, None), (9001, "")]
    got = calls.invocations(spark.createDataFrame(docs, "id int, text string"), "id").collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.id, r.line_no)):
        found.setdefault(r.id, []).append((r.script, r.flags))
    want = {i: own for i, text in docs if (own := list(plain_calls(text or "")))}
    assert found == want and len(want) > 100


def test_undeclared_flags(spark):
    used = spark.createDataFrame([(1, 3, "a.py", ["--x", "-y", "--x"]), (1, 5, "gone.py", ["--x"]), (2, 1, "bare.py", ["-q"])], "id int, line_no int, script string, flags array<string>")
    declared = calls.declared_flags(spark.createDataFrame([("a.py", "usage [--x X] not-a-flag"), ("bare.py", None)], "s string, h string"), "s", "h")
    assert {tuple(r) for r in calls.undeclared(used, declared, "id").collect()} == {(1, 3, "a.py", "-y"), (1, 5, "gone.py", None), (2, 1, "bare.py", "-q")}


def plain_memory(epochs):
    """Answers one by one, as a list that keeps its order."""
    rows = {}
    for epoch, answers in enumerate(epochs):
        for key, value, order in sorted((a for a in answers if a[0] is not None and a[1] is not None), key=lambda a: (a[2], a[1])):
            rows[key] = (value, *rows[key][1:3], epoch) if key in rows else (value, epoch, order, None)
    return rows


def answers_of(spark, rows):
    return spark.createDataFrame(rows, "k string, v string, at int")


def test_memory_replays_keep_order_and_last_write(spark, tmp_path):
    rng = random.Random(5)
    epochs = [[(rng.choice(["a", "b", "c", "d", f"n{e}", None]), rng.choice(["x", "y", None]), i) for i in range(rng.randint(0, 12))] for e in range(7)]
    table = f"{tmp_path}/memory"
    for e, rows in enumerate(epochs):
        frame = answers_of(spark, rows)
        memory.merge_epoch(frame, e, table, "k", "v", "at")
        before = sorted(map(tuple, memory.read_memory(spark, table).collect()))
        memory.merge_epoch(frame, e, table, "k", "v", "at")  # again, after a failure
        assert sorted(map(tuple, memory.read_memory(spark, table).collect())) == before
    got = {r.k: (r.v, r.first_epoch, r.first_order, r.updated_epoch) for r in memory.read_memory(spark, table).collect()}
    assert got == plain_memory(epochs)
    assert len(memory._versions(spark, table)) <= memory.KEPT_VERSIONS + 1


def test_a_half_written_version_is_written_anew(spark, tmp_path):
    table = f"{tmp_path}/memory"
    memory.merge_epoch(answers_of(spark, [("a", "1", 1)]), 0, table, "k", "v", "at")
    (tmp_path / "memory" / "v1").mkdir()
    (tmp_path / "memory" / "v1" / "part-0.parquet").write_bytes(b"broken")
    assert [r.v for r in memory.read_memory(spark, table).collect()] == ["1"]
    memory.merge_epoch(answers_of(spark, [("a", "2", 1)]), 1, table, "k", "v", "at")
    assert [(r.v, r.updated_epoch) for r in memory.read_memory(spark, table).collect()] == [("2", 1)]


def test_memory_as_a_stream_over_several_runs(spark, tmp_path):
    table, folder = f"{tmp_path}/memory", f"{tmp_path}/in"
    runs = [[("b", "1", 1), ("a", "1", 2)], [("a", "2", 3), ("c", "1", 4), ("c", "2", 5)], []]
    for rows in runs:
        if rows:
            answers_of(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("k string, v string, at int").parquet(folder)
        memory.memory_stream(stream, table, "k", "v", "at")
    got = [(r.k, r.v, r.updated_epoch) for r in memory.read_memory(spark, table).orderBy("first_epoch", "first_order").collect()]
    assert got == [("b", "1", None), ("a", "2", 1), ("c", "2", 1)]


def test_memory_summary(spark):
    given = answers_of(spark, [("a", "1", 1), ("a", "2", 2), ("n", "1", 3), ("n", "2", 4), (None, "x", 5), ("m", None, 6)])
    assert tuple(memory.summary(None, given, "k", "v").first()) == (2, 2, 2)
    known = memory.merge_answers(None, answers_of(spark, [("a", "0", 1), ("z", "0", 2)]), 0, "k", "v", "at")
    assert tuple(memory.summary(known, given, "k", "v").first()) == (3, 1, 3)
    assert tuple(memory.summary(known, given.limit(0), "k", "v").first()) == (0, 0, 2)
    assert known.where(F.col("updated_epoch").isNotNull()).count() == 0
