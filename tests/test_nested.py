"""Nested audits, parse errors and the call graph of changing files against plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, describe, graph_store, source_index

GOOD = {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "x"}}, "invocations": [{}], "results": [{"ruleId": "r", "locations": [1]}]}]}


def report(**changes):
    own = json.loads(json.dumps(GOOD))
    for path, value in changes.items():
        at, *rest = path.split("__")
        target = own
        keys = [int(k) if k.isdigit() else k for k in (at, *rest)]
        for k in keys[:-1]:
            target = target[k]
        if value is None:
            del target[keys[-1]]
        else:
            target[keys[-1]] = value
    return json.dumps(own)


REPORTS = [
    (report(), set()),
    (report(version="2.0"), {("$.version", "wrong version")}),
    (report(version=2.1), {("$.version", "wrong version")}),
    (report(runs=[]), {("$.runs", "runs missing or empty")}),
    (report(runs=None), {("$.runs", "runs missing or empty")}),
    (report(runs={"a": 1}), {("$.runs", "runs missing or empty")}),
    (report(runs__0__tool__driver__name="  "), {("$.runs[0].tool.driver.name", "missing tool.driver.name")}),
    (report(runs__0__tool=None), {("$.runs[0].tool.driver.name", "missing tool.driver.name")}),
    (report(runs__0__invocations=[]), {("$.runs[0].invocations", "missing invocations[]")}),
    (report(runs__0__results=[{"ruleId": "a", "locations": [1]}, 5, {"ruleId": "", "locations": []}]), {("$.runs[0].results[1]", "not an object"), ("$.runs[0].results[2].ruleId", "missing ruleId"), ("$.runs[0].results[2].locations", "missing locations")}),
    (report(runs=[GOOD["runs"][0], {}]), {("$.runs[1].tool.driver.name", "missing tool.driver.name"), ("$.runs[1].invocations", "missing invocations[]")}),
    (report(runs=[7]), {("$.runs[0]", "not an object")}),
    (None, {("$", "no text")}), ("", {("$", "malformed JSON")}), ("{", {("$", "malformed JSON")}), (report() + "}", {("$", "malformed JSON")}), ("[1]", {("$", "not an object")}), ("null", {("$", "not an object")}),
]


def test_reports(spark):
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(REPORTS)], "id int, body string").repartition(3)
    found = {}
    for r in audit.violations(docs, "id", "body", audit.REPORT_RULES).collect():
        found.setdefault(r.id, set()).add((r.place, r.issue))
    assert [found.get(i, set()) for i in range(len(REPORTS))] == [want for _, want in REPORTS]
    assert audit.violations(docs.limit(0), "id", "body", audit.REPORT_RULES).count() == 0


def test_candidates(spark):
    good = {"source": "scout", "file": "a.java", "line": 3, "category": "crypto"}
    rows = [good, {**good, "source": "regex"}, {**good, "line": 0, "file": ""}, {**good, "category": "nonsense"}, {**good, "category": ""}, "text", {k: v for k, v in good.items() if k != "category"}]
    docs = spark.createDataFrame([(1, json.dumps({"candidates": rows})), (2, json.dumps([good])), (3, json.dumps({"other": 1})), (4, json.dumps({"candidates": []}))], "id int, body string")
    got = {(r.id, r.place, r.issue) for r in audit.violations(docs, "id", "body", audit.CANDIDATE_RULES).collect()}
    at = "$.candidates[{}]{}".format
    assert got == {(1, at(1, ".source"), "source must be 'scout'"), (1, at(2, ".file"), "missing file"), (1, at(2, ".line"), "missing line"), (1, at(3, ".category"), "category not in the registry"), (1, at(4, ".category"), "missing category"), (1, at(5, ""), "not an object"), (1, at(6, ".category"), "missing category"), (2, "$", "not an object"), (3, "$.candidates", "not a wrapper")}


@pytest.mark.parametrize("text", ["1]", "1}", "1 2", "1, 2", "[1]]", '{"a": 1}}', "{}{}", "", "tru", "1]}", "1}]", '"a', "[1,", '{"a"}'])
def test_what_follows_a_value_is_no_json(spark, text):
    with pytest.raises(ValueError):
        json.loads(text)
    row = spark.createDataFrame([(text,)], "t string").select(describe.parsed_whole(F.col("t")).isNull().alias("bad")).first()
    assert row.bad


def test_parse_errors_tell_line_and_column(spark):
    texts = ['{"a": 1}', '{\n  "a": 1,\n  "b" 2\n}', "", "[1, 2", '{"a": 1}}', None, "x" * 200, "[" * 100_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, body string")
    got = {r.id: (r.line, r.col, r.message, r.nearby) for r in audit.parse_errors(docs, "id", "body").collect()}
    want = {}
    for i, text in enumerate(texts[:-1]):
        try:
            json.loads(text or "{}")
        except json.JSONDecodeError as x:
            want[i] = (x.lineno, x.colno, x.msg, text[max(0, x.pos - 40) : x.pos + 40].replace("\n", "\\n"))
    if "" in texts:
        want[2] = (1, 1, "Expecting value", "")
    deep = got.pop(7)
    assert got == want and deep[2] in ("nested too deeply", "Expecting value")


def graph_of(files):
    return {(c, d): n for c, (_, called) in files.items() for d, (defined, _) in files.items() if c != d and (n := len(defined & called))}


def as_files(spark, files):
    rows = [(p, "python", "".join(f"def {n}(): pass\n" for n in sorted(defined)) + "".join(f"x = {n}(1)\n" for n in sorted(called))) for p, (defined, called) in files.items()]
    df = spark.createDataFrame(rows, "path string, lang string, text string")
    return df, df.select("path", F.xxhash64("text").alias("modified"), F.octet_length("text").cast("long").alias("bytes"))


def test_the_call_graph_follows_its_files(spark, tmp_path):
    versions = [
        {"a": ({"foo", "bar"}, {"baz"}), "b": ({"baz"}, {"foo"}), "c": (set(), {"foo", "bar", "baz"})},
        {"a": ({"foo"}, {"baz", "qux"}), "b": ({"baz"}, {"foo"}), "d": ({"qux", "foo"}, {"baz"})},  # a changed, c went, d came
        {"a": ({"foo"}, {"baz", "qux"}), "b": ({"baz"}, {"foo"}), "d": ({"qux", "foo"}, {"baz"})},  # nothing
        {"b": ({"baz"}, {"foo"})},
        {},
    ]
    changes = [{"a": "added", "b": "added", "c": "added"}, {"a": "changed", "c": "gone", "d": "added"}, None, {"a": "gone", "d": "gone"}, {"b": "gone"}]
    for files, change in zip(versions, changes, strict=True):
        # a file calls its own definitions too, since these read as calls
        own = {p: (defined, defined | called) for p, (defined, called) in files.items()}
        frame, snap = as_files(spark, files)
        for again in (False, True):
            got = graph_store.refresh(spark, f"{tmp_path}/store", frame, snap)
            assert {(r.caller, r.callee): r.weight for r in got.edges.collect()} == graph_of(own)
            delta = None if got.delta is None else {r.path: r.change for r in got.delta.collect()}
            assert delta == (None if again else change)
    assert got.version == 3


def test_only_changed_files_are_read(spark, tmp_path, monkeypatch):
    files = {f"f{i}": ({f"name{i}"}, {f"name{(i * 7) % 40}"}) for i in range(40)}
    frame, snap = as_files(spark, files)
    graph_store.refresh(spark, f"{tmp_path}/store", frame, snap)
    files["f3"] = ({"name3", "name4"}, {"name9"})
    frame, snap = as_files(spark, files)
    read = []
    scan = source_index.scan
    monkeypatch.setattr(source_index, "scan", lambda df: read.extend(r.path for r in df.collect()) or scan(df))
    got = graph_store.refresh(spark, f"{tmp_path}/store", frame, snap)
    assert read == ["f3"]
    assert {(r.caller, r.callee): r.weight for r in got.edges.collect()} == graph_of({p: (d, d | c) for p, (d, c) in files.items()})


def test_a_version_without_its_snapshot_does_not_count(spark, tmp_path):
    frame, snap = as_files(spark, {"a": ({"foo"}, set()), "b": (set(), {"foo"})})
    graph_store.refresh(spark, f"{tmp_path}/store", frame, snap)
    (tmp_path / "store" / "v1" / "edges").mkdir(parents=True)
    assert graph_store.refresh(spark, f"{tmp_path}/store", frame, snap).version == 0
    frame, snap = as_files(spark, {"a": ({"foo"}, set()), "b": (set(), set())})
    got = graph_store.refresh(spark, f"{tmp_path}/store", frame, snap)
    assert got.version == 1 and got.edges.count() == 0
