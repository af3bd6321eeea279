"""Operators on small tables of their own: cases that the driver's tables do not hold."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import registry as R
from tessera.functions import scoring
from tessera.functions import text as X
from tessera.operators import dedup, describe, gates, graph, groups, packing, source_index, spans, state
from tessera.sources import readers, sinks
from tessera.streaming import incremental


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def next_fit(sizes, budget, count):
    out, used, n, batch = [], 0, 0, 0
    for s in sizes:
        if batch == 0 or used + s > budget or n >= count:
            batch, used, n = batch + 1, 0, 0
        used, n = used + s, n + 1
        out.append(batch)
    return out


@pytest.mark.parametrize("block, group", [(7, 256), (7, 3), (1000, 16)])
def test_next_fit_equals_a_sequential_pass(spark, monkeypatch, block, group):
    monkeypatch.setattr(packing, "GROUP_BLOCKS", group)
    rng = random.Random(block)
    sizes = [rng.choice([0, 1, 5, 30, 99, 150]) for _ in range(180)]
    df = spark.createDataFrame([(f"f{i:04}", s) for i, s in enumerate(sizes)], "file string, size long")
    got = values(packing.next_fit(df, ["file"], "size", 100, 5, block=block), "ordinal", "batch_no")
    assert [b for _, b in sorted(got)] == next_fit(sizes, 100, 5)


@pytest.mark.parametrize("block, fan", [(60, 2), (61, 16), (10_000, 16)])
def test_segmented_next_fit_equals_a_pass_over_each_group(spark, monkeypatch, block, fan):
    monkeypatch.setattr(packing, "GROUP_BLOCKS", fan)
    rng = random.Random(block)
    rows = [("hot", 30, rng.choice([2, 9, 40, 45, 60, 101, 400])) for _ in range(700)] + [(f"c{rng.randrange(60)}", 7, rng.choice([2, 50, 93, 94, 120])) for _ in range(300)] + [(None, None, None), (None, 0, 99), (None, 0, 1), ("one", 500, 3), ("one", 500, 3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, cluster string, head long, size long").repartition(5)
    got = {r.id: (r.ordinal, r.shard_no, r.shard_start) for r in packing.segmented_next_fit(df, "cluster", ["id"], "size", 100, header="head", block=block).collect()}
    want, state = {}, {}
    for i, (cluster, head, size) in enumerate(rows):
        head, size = head or 0, max(1, size or 0)
        n, shard, start, used = state.get(cluster, (0, -1, 0, None))
        if used is None or used + size > 100:
            shard, start, used = shard + 1, n + 1, head
        state[cluster] = (n + 1, shard, start, used + size)
        want[i] = (n + 1, shard, start)
    assert got == want


def test_cluster_units_shard_only_what_does_not_fit(spark):
    rows = [("big::X::zz", i, 3000, 200) for i in range(6)] + [("small", 1, 100, 50), ("small", 2, 100, 50), ("huge", 1, 9000, 10), ("edge", 1, 1990, 1990), ("edge", 2, 0, 1990)]
    hits = spark.createDataFrame(rows, "cluster string, id int, size long, head long")
    own, units = packing.cluster_units(hits, "cluster", ["id"], "size", "head", 4000)
    got = {r.unit_id: (r.n_hits, r.bytes, r.sharded, r.oversize) for r in units.collect()}
    assert got == {f"big::X::zz::shard-{i}": (1, 3218, True, False) for i in range(6)} | {"small": (2, 270, False, False), "huge::shard-0": (1, 9028, True, True), "edge": (2, 4000, False, False)}
    assert sorted((r.unit_id, r.id) for r in own.where("cluster = 'small'").collect()) == [("small", 1), ("small", 2)]


def test_cvss_known_vectors_and_gaps(spark):
    rows = [("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0), ("CVSS:3.1/AV:P/AC:H/PR:H/UI:R/S:U/C:N/I:N/A:N", 0.0), ("CVSS:3.1/AV:N/AC:L", None), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "v string, expected double").withColumn("score", scoring.base_score(F.col("v")))
    assert all(r.score == r.expected for r in df.collect())
    bands = spark.createDataFrame([(None,), (0.0,), (3.5,), (5.0,), (8.0,), (9.5,)], "s double").select(scoring.severity(F.col("s")).alias("b"))
    assert [r.b for r in bands.collect()] == ["Info", "Info", "Low", "Medium", "High", "Critical"]


def test_gates_name_the_first_failing_check(spark):
    rows = [("a.java", "0.9", "a:1", "b:2"), ("a.java", "0.9", " ", "b:2"), ("a.java", "0.9", "a", "b:2"), ("a.java", "x", "a:1", "b:2"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "file string, confidence string, source_ref string, sink_ref string")
    assert [r.dropped_reason for r in gates.gated(df).collect()] == [None, "missing reference", "reference without line", "low confidence", "missing reference"]


def test_reach_stops_at_the_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "a"), ("d", "a")], "caller string, callee string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert values(graph.reach(edges, seeds, 2, "forward"), "node", "depth") == [("a", 0), ("b", 1), ("c", 2)]
    assert values(graph.reach(edges, seeds, 1), "node", "depth") == [("a", 0), ("b", 1), ("d", 1), ("x", 1)]
    assert values(graph.reach(edges, seeds.where("false"), 3), "node") == []


def test_spans_end_before_the_next_one(spark):
    lines = spark.createDataFrame([("f", 1, "A"), ("f", 4, "B"), ("f", 4, "B2"), ("g", 2, "C")], "file string, line_no int, name string")
    sizes = spark.createDataFrame([("f", 9), ("g", 2)], "file string, n_lines int")
    assert ("f", 1, "A", 3) in values(spans.node_spans(lines, "file", sizes), "file", "line_no", "name", "line_end")
    points = spark.createDataFrame([("f", 3), ("f", 4), ("g", 1)], "file string, line_no int")
    heads = lines.where("name <> 'B2'")
    assert values(spans.enclosing(points, heads, "file"), "file", "line_no", "enclosing_name") == [("f", 3, "A"), ("f", 4, "B"), ("g", 1, None)]


def test_blocks_and_requirements(spark):
    text = "# x\n## ADDED Requirements\n### Requirement: One\nbody\nmore\n### Requirement: Two\nb2\n## Notes\n### Requirement: Not\nno\nBEGIN\nin\nEND\nout\nBEGIN\nlost"
    lines = spans.lines_of(spark.createDataFrame([(1, text)], "k int, text string"), "k")
    assert values(spans.requirement_blocks(lines, "k"), "heading", "body") == [("One", "body\nmore"), ("Two", "b2")]
    kept = [r.line for r in spans.without_blocks(lines, "k", "BEGIN", "END").orderBy("line_no").collect()]
    assert "out" in kept and "in" not in kept and "lost" not in kept


def test_upsert_appends_and_keeps_order(spark):
    base = spark.createDataFrame([("a", "1", 1), ("b", "2", 2)], "fact_key string, value string, pos long")
    batch = spark.createDataFrame([("b", "x", 1), ("b", "y", 2), ("c", "z", 3)], "fact_key string, value string, at long")
    got = values(state.upsert(base, batch, "fact_key", "value", "at"), "fact_key", "value", "updated", "appended_at")
    assert got == [("a", "1", False, None), ("b", "y", True, None), ("c", "z", True, 3)]


def test_keyed_append_takes_nulls_as_equal(spark):
    known = spark.createDataFrame([("logging", None, "a")], "category string, k string, v string")
    fresh = spark.createDataFrame([("logging", None, "b"), ("logging", "x", "d"), ("logging", "x", "c"), (None, "y", "e")], "category string, k string, v string")
    got = values(dedup.keyed_append(known, fresh, ["k"], ["v"]), "k", "v")
    assert ("x", "c") in got and ("x", "d") not in got and (None, "b") not in got


def test_source_tree_is_pruned_on_relative_paths(spark, tmp_path):
    root = tmp_path / ".hidden" / "repo"
    for name in ("src/main/java/A.java", "src/test/java/ATest.java", "node_modules/x.js", ".git/y.py", "README.zzz"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("﻿class A {}\n")
    tree = readers.source_tree(spark, str(root))
    assert values(tree, "path") == [("src/main/java/A.java",), ("src/test/java/ATest.java",)]
    assert values(readers.source_tree(spark, str(root), tests=False), "path", "text") == [("src/main/java/A.java", "class A {}\n")]
    assert readers.truncated(spark, str(root), 1) is True


def test_word_and_sheet_documents(spark, tmp_path):
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hel</w:t></w:r><w:r><w:t>lo</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p><w:tbl></w:tbl></w:body></w:document>')
    sheet, ns = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(sheet, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>sh</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>3</v></c><c t="inlineStr"><is><t>in</t></is></c><c t="b"><v>1</v></c></row></sheetData></worksheet>')
    (tmp_path / "a.docx").write_bytes(word.getvalue())
    (tmp_path / "b.xlsx").write_bytes(sheet.getvalue())
    (tmp_path / "c.md").write_text("﻿# T")
    (tmp_path / "d.docx").write_bytes(b"broken")
    got = {r.path[-6:]: r for r in readers.requirement_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == "Hello\ntwo" and got["a.docx"].lost == ["tables"]
    assert got["b.xlsx"].text == "## S\nsh\t3\tin\tTRUE"
    assert got["d.docx"].text is None and "BadZipFile" in got["d.docx"].error
    assert [r.text for r in got.values() if r.path.endswith("c.md")] == ["# T"]


def test_changed_files_and_mutators(spark):
    text = "M\ta.java\nA\tb.py\nD\tc.java\nR100\told.java\tnew.java\nM\tx.bin"
    status = spark.createDataFrame([(text,)], "t string").select(F.explode(readers.name_status(F.col("t"))).alias("s")).select("s.*")
    assert values(readers.changed_files(status), "path", "role") == [("a.java", "seed"), ("b.py", "seed"), ("c.java", "deleted"), ("new.java", "seed"), ("old.java", "deleted")]
    built = spark.createDataFrame([("<mutators><mutator>A1</mutator><mutator>A1</mutator></mutators>", None, None), (None, "mutators = ['G1', 'G2']", None), (None, None, None)], "p string, g string, k string")
    got = [r.m for r in built.select(readers.mutators(F.coalesce("p", F.lit("")), F.coalesce("g", F.lit("")), F.coalesce("k", F.lit(""))).alias("m")).collect()]
    assert got == [["A1"], ["G1", "G2"], list(readers.DEFAULT_MUTATORS)]


def test_json_and_unit_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a/b", 1), ("a/b", 2), ("a:b", 3), ("a_b", 4)], "unit string, v int")
    sinks.write_units(df, "unit", str(tmp_path / "units"))
    folders = {p.name: p for p in (tmp_path / "units").iterdir() if p.is_dir()}
    assert len(folders) == 3 and "unit_dir=a_b" in folders and all(name.startswith("unit_dir=a_b") for name in folders)
    assert spark.read.json(str(folders["unit_dir=a_b"])).first().v == 4
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "good.json").write_text('{"a": 1}')
    (tmp_path / "j" / "bad.json").write_text('{"a": ')
    got = readers.json_artifact(spark, str(tmp_path / "j"), "a int, _corrupt_record string")
    rows = [(r.a, r._corrupt_record is None) for r in got.collect()]
    assert sorted(rows, key=repr) == [(1, True), (None, False)]


def test_cache_is_rebuilt_when_files_change(spark, tmp_path):
    built = []

    def build(n):
        built.append(n)
        return spark.range(n)

    snap = lambda size: spark.createDataFrame([("f", 1, size)], "path string, modified long, bytes long")
    for size in (1, 1, 2):
        out = sinks.fresh_or(spark, str(tmp_path / "cache"), snap(size), lambda size=size: build(size))
    assert built == [1, 2] and out.count() == 2


def test_incremental_scan_takes_only_new_files(spark, tmp_path):
    docs = tmp_path / "docs"
    run = lambda: incremental.scan_new_files(spark, str(docs), str(tmp_path / "hits"), str(tmp_path / "cp"))
    text = "password = 'abcdefgh' ### $$$ ***"
    spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1).write.parquet(str(docs))
    run()
    first = spark.read.parquet(str(tmp_path / "hits")).count()
    assert first > 0
    run()
    assert spark.read.parquet(str(tmp_path / "hits")).count() == first
    spark.createDataFrame([(2, text)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(docs))
    run()
    assert spark.read.parquet(str(tmp_path / "hits")).groupBy("doc_id").count().count() == 2


def test_globs_and_paths(spark):
    df = spark.createDataFrame([("a/b/c.java",), ("c.java",), ("a/b.c",)], "p string")
    assert [r[0] for r in df.select(F.col("p").rlike(X.glob_regex("**/*.java"))).collect()] == [True, True, False]
    assert [r[0] for r in df.select(F.col("p").rlike(X.glob_regex("a/*.c"))).collect()] == [False, False, True]


# ---------------------------------------------------------------- fixed values and their rules


def test_token_estimates_are_characters_by_kind(spark):
    row = spark.createDataFrame([("abcd" * 10 + "项目é",)], "t string").select(*[c.alias(k) for k, c in X.text_stats(F.col("t")).items()])
    got = row.select("*", *[c.alias(k) for k, c in X.token_range(F.col("n_cjk"), F.col("n_ascii"), F.col("n_other")).items()]).first()
    assert (got.n_cjk, got.n_ascii, got.n_other, got.n_lines) == (2, 40, 1, 1)
    assert (got.tokens_low, got.tokens_mid, got.tokens_high) == (12, 12, 12)  # 10 + 1.5 is even-rounded, 10 + 2, 10 + 2.5 likewise
    lines = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\nb",)], "t string").select(X.text_stats(F.col("t"))["n_lines"].alias("n")).collect()
    assert [r.n for r in lines] == [0, 1, 1, 2]


def test_english_words_in_chinese_prose(spark):
    lines = {"# heading 中文 word": None, "> 引用 word": None, "| 表 | word |": None, "no ideographs here": None, "只有中文": None, "用 `code word` 的中文": None, "用 JSON 和 git 与 T1 s12": None, "来源层 producer 物化": 1 / 6, "中文 foo-bar it's a": 2 / 5}
    got = {r.t: r.v for r in spark.createDataFrame([(k,) for k in lines], "t string").select("t", X.ascii_atom_share(F.col("t")).alias("v")).collect()}
    assert {k: None if v is None else round(v, 9) for k, v in got.items()} == {k: None if v is None else round(v, 9) for k, v in lines.items()}


def test_fences_of_both_kinds_and_indented(spark):
    text = "a\n```py\nb\n  ~~~\nc\n~~~\nd\n```\ne"
    lines = spans.lines_of(spark.createDataFrame([(1, text)], "k int, text string"), "k")
    assert {r.line: r.in_fence for r in spans.outside_fences(lines, "k").collect()} == {"a": False, "b": True, "c": False, "d": True, "e": False}


def test_layers_and_families(spark):
    cases = [
        ("@WebMvcTest", "a/X.java", "controller", "WebMvcTest"), ("@JdbcTest", "a/X.java", "repository", "JdbcTest"), ("org.testcontainers.X", "a/X.java", "integration", "none"),
        ("@SpringBootTest TestRestTemplate", "a/X.java", "integration", "SpringBootTest"), ("@SpringBootTest MockMvc", "a/X.java", "controller", "SpringBootTest"), ("@SpringBootTest", "a/X.java", "service", "SpringBootTest"),
        ("@TestConfiguration", "a/X.java", "config", "TestConfiguration"), ("@InjectMocks", "a/X.java", "service", "none"), ("x", "my/dao/X.java", "repository", "none"), ("x", "a/OrderServiceTest", "service", "none"),
        ("mockStatic(", "a/X.java", "util", "mock-static"), ("assertThat Clock", "a/X.java", "util", "mock-time"), ("assertThat", "a/X.java", "util", "pure"), ("x", "a/X.java", "other", "other"),
    ]
    files = spark.createDataFrame(cases, "text string, path string, layer string, family string")
    layer = groups.layer(F.col("text"), F.col("path"))
    got = files.select("text", "path", layer.alias("layer"), groups.family(layer, F.col("text")).alias("family")).collect()
    assert [tuple(r) for r in got] == cases


def test_signals_gates_and_defaults(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(X.endpoints(F.lit("GET /a/b then /api/x, 9/api/y, v/api/z, GET /api/x"))) == ["GET /a/b", "GET /api/x", "/api/y"]
    assert readers.DEFAULT_MUTATORS == ("CONDITIONALS_BOUNDARY", "INCREMENTS", "INVERT_NEGS", "MATH", "NEGATE_CONDITIONALS", "RETURN_VALS", "VOID_METHOD_CALLS")
    rows = [(0.39, "src/a.java"), (0.40, "src/a.java"), (0.9, "src/__tests__/a.java"), (0.9, "spec/a.java"), (0.9, "x/EXAMPLE/a.java")]
    found = spark.createDataFrame([("a:1", "b:2", c, f) for c, f in rows], "source_ref string, sink_ref string, confidence double, file string")
    assert [r.dropped_reason for r in gates.gated(found).collect()] == ["low confidence", None, "noise path", None, "noise path"]


SOURCE_FILES = [
    ("a/A.java", "java", "package a;\nimport x.Y;\nimport static x.Z.*;\n@Secured\npublic class A {\n  @Valid\n  public List<String> load(int a)\n      throws E {\n    save(a); mask(1);\n  }\n  void ab() { }\n}\ninterface B { }"),
    ("b/b.py", "python", "from os import path\nimport sys\n\n\nclass Q:\n    def load(self):\n        return save(1)\n\n    def save(self): pass\n# sanitize_all"),
    ("c/c.js", "js", "import x from './m'\nrequire('k')\nfunction save(a) { load(a) }\nclass R {}\nconst f = (a) => a"),
    ("d/d.go", "go", 'import "fmt"\ntype T struct {}\nfunc (t T) save(a int) { Cipher() }'),
    ("e/e.rb", "ruby", "require 'z'\nmodule M\n def load\n end\nend"),
    ("f/f.zz", "other", "int main(void) { return save(); }"),
]


def test_the_source_index_equals_regular_expressions(spark):
    files = spark.createDataFrame(SOURCE_FILES, "path string, lang string, text string")
    nodes, defs, called, hits = set(), {}, {}, []
    for path, lang, text in SOURCE_FILES:
        for kind, pattern, least in (("class", R.CLASS_PATTERNS.get(lang), 1), ("method", R.DEFINITION_PATTERNS.get(lang, R.DEFINITION_PATTERNS["c"]), 3)):
            seen = set()
            for m in re.finditer(pattern, text) if pattern else ():
                line = text.count("\n", 0, m.start()) + 1
                if m[1] and len(m[1]) >= least:
                    if kind == "method":
                        defs.setdefault(m[1], set()).add(path)
                    if line not in seen:
                        nodes.add((path, kind, line, m[1]))
                    seen.add(line)
        called[path] = {m[1] for m in re.finditer(R.CALL_PATTERNS.get(lang, R.CALL_PATTERNS["c"]), text) if len(m[1]) > 2}
        for category, patterns in R.CATEGORY_PATTERNS.items():
            for p in patterns:
                for m in re.finditer(p, text):
                    line = text.count("\n", 0, m.start()) + 1
                    own = lambda kind: max(((n, x) for q, k, n, x in nodes if (q, k) == (path, kind) and n <= line), default=(0, None))[1]  # noqa: E731, B023
                    hits.append((path, category, line, m[0], own("class"), own("method"), text.split("\n")[line - 1].strip()[:160]))
    scanned = source_index.scan(files)
    assert {tuple(r) for r in source_index.node_index(scanned).collect()} == nodes
    edges = {(c, d): n for c in called for d in {x for names in defs.values() for x in names} if c != d and (n := sum(d in defs.get(name, ()) for name in called[c]))}
    graph = source_index.call_graph(scanned)
    assert {(r.caller, r.callee): r.weight for r in graph.collect()} == edges
    got = source_index.candidates(scanned, graph).collect()
    assert sorted(((r.path, r.category, r.line, r.pattern, r["class"], r.method, r.snippet) for r in got), key=repr) == sorted(hits, key=repr) and hits
    assert all(r.entry_points == sorted(c for c, d in edges if d == r.path)[:8] for r in got)
    made = {r.path: r for r in source_index.skeleton(scanned, graph).collect()}
    assert made["a/A.java"].imports == ["x.Y", "x.Z.*"] and made["b/b.py"].imports == ["os", "sys"] and made["c/c.js"].imports == ["./m", "k"]
    assert all(made[p].fan_in == sum(d == p for _, d in edges) for p in made)


def test_paths_into_json(spark):
    body = '{"a": {"b": [1, {"c": "x"}]}, "3": 4}'
    value = describe.parsed(F.lit(body))
    kinds = {"a": "dict", "a.b": "list", "a.b.0": "int", "a.b.1.c": "str", "a.b.2": None, "a.b.-1": None, "3": "int", "x": None, "a.b.c": None}
    row = spark.range(1).select(*[describe.kind(describe.navigate(value, k)).alias(str(i)) for i, k in enumerate(kinds)]).first()
    assert list(row) == list(kinds.values())


def test_overlaps_of_entry_points_and_files(spark):
    controls = spark.createDataFrame([(1, ["src/A.java"]), (2, ["B"]), (3, ["zz"]), (4, []), (5, None)], "id int, points array<string>")
    files = spark.createDataFrame([("A.java",), ("x/B/c",), ("",)], "file string")
    assert {r.id: r.file_overlap for r in gates.overlapping(controls, "id", "points", files, "file").collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
