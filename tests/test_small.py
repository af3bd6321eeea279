"""Readers and small helpers with literal expectations."""

from pyspark.sql import functions as F

from tessera.functions import registry as R
from tessera.functions import text as T
from tessera.operators import catalog, dedup
from tessera.sources import readers


def column(spark, value, build):
    return spark.createDataFrame([(value,)], "t string").select(build(F.col("t")).alias("x")).first().x


def test_requirement_files_of_every_text_kind(spark, tmp_path):
    for name, text in {"a.md": "# A", "b.txt": "b", "c.csv": "x,y", "d.json": '{"k": 1}', "e.markdown": "no", "F.JSON": "[2]"}.items():
        (tmp_path / name).write_text(text)
    docs = readers.requirement_documents(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.text for r in docs.collect()} == {"a.md": "# A", "b.txt": "b", "c.csv": "x,y", "d.json": '{"k": 1}', "F.JSON": "[2]"}
    joined = readers.joined_documents(docs.where("path LIKE '%.md' OR path LIKE '%.csv'")).first().text
    assert joined == "===== a.md =====\n# A\n\n===== c.csv =====\nx,y"


def test_scopes_come_as_list_object_or_lines(spark):
    assert column(spark, '["a/b", "c"]', readers.scope_list) == ["a/b", "c"]
    assert column(spark, ' {"in_scope": ["x"], "other": 1}', readers.scope_list) == ["x"]
    assert column(spark, "a\n\n  b/c \n", readers.scope_list) == ["a", "b/c"]


def test_answers_come_as_object_or_list(spark):
    rows = lambda value: [tuple(a) for a in column(spark, value, readers.answers)]
    assert rows('{"k1": "v", "k2": "w"}') == [("k1", "v"), ("k2", "w")]
    assert rows('[{"fact_key": "k", "value": "v"}]') == [("k", "v")]


def test_inline_text_goes_before_documents_and_input(spark):
    df = spark.createDataFrame([("a", "b", "c"), ("", "b", "c"), (None, "b", ""), ("", "", "")], "t string, stdin string, doc string")
    assert [r.x for r in df.select(readers.inline_or(F.col("t"), F.col("stdin"), F.col("doc")).alias("x")).collect()] == ["a", "c", "b", None]


def test_specs_and_tasks(spark, tmp_path):
    for cap, text in {"pay": "# pay", "login": "# login"}.items():
        (tmp_path / cap).mkdir()
        (tmp_path / cap / "spec.md").write_text(text)
    assert sorted((r.capability, r.text) for r in readers.specs(spark, str(tmp_path)).collect()) == [("login", "# login"), ("pay", "# pay")]
    got = column(spark, "intro\n- [ ] one\n  * [X] two \n-[ ] no\n- [x]three", readers.tasks)
    assert [(x.done, x.task) for x in got] == [(False, "one"), (True, "two"), (True, "three")]


def test_packages_and_scope_conditions(spark):
    paths = spark.createDataFrame([("src/main/java/com/bank/A.java",), ("lib/com/Bank/B.java",), ("src/com/bank/deep/C.java",), ("com/other/D.java",)], "path string")
    assert {(r.dir, r["rank"]) for r in readers.package_dirs(paths, "com.bank").collect()} == {("src/main/java/com/bank", 0), ("lib/com/Bank", 1)}
    rel = paths.withColumnRenamed("path", "rel")
    hit = lambda scope: sorted(r.rel for r in rel.where(readers.scope_condition(scope)).collect())
    assert hit("path:lib") == ["lib/com/Bank/B.java"]
    assert hit("package:com.bank") == ["lib/com/Bank/B.java", "src/com/bank/deep/C.java", "src/main/java/com/bank/A.java"]
    assert hit("file:src/**/*.java") == ["src/com/bank/deep/C.java", "src/main/java/com/bank/A.java"]


def test_findings_by_confidence_and_what_would_merge(spark):
    rows = [("a", "f.java", "CWE-1", 10, 0.2), ("b", "F.java", "cwe-1 ", 12, 0.9), ("c", "f.java", "CWE-1", 40, None)]
    df = spark.createDataFrame(rows, "id string, file string, cwe string, line_start int, confidence double")
    assert [r.id for r in dedup.by_confidence(df, ["id"]).collect()] == ["b", "a", "c"]
    assert [r.n for r in dedup.would_merge(df, ["id"]).collect()] == [2]
    assert dedup.would_merge(df.where("id <> 'a'"), ["id"]).count() == 0


def test_absolute_paths_beside_what_they_were(spark):
    got = spark.createDataFrame([(["a/b", "/c"],)], "p array<string>").select(T.absolute_all(F.col("p"), F.lit("/root/")).alias("x")).first().x
    assert [tuple(x) for x in got] == [("/root/a/b", "a/b"), ("/c", "/c")]


def test_directives_and_policies(spark):
    df = spark.createDataFrame([(["audit", "secrets"],), (None,)], "d array<string>")
    assert [r.x for r in df.select(catalog.directive(F.col("d")).alias("x")).collect()] == ["Review only: audit, secrets.", None]
    policy = spark.createDataFrame([({"financial/card": ("Card", "partial", "last four")},)], "p map<string,struct<label:string,mask:string,rule:string>>")
    assert [tuple(x) for x in policy.select(catalog.policy_rows(F.col("p")).alias("x")).first().x] == [("financial/card", "financial", "Card", "partial", "last four")]


def test_kinds_and_categories_are_brought_to_their_names(spark):
    for alias, kind in list(R.KIND_ALIASES.items())[:6]:
        assert column(spark, f" {alias.upper()} ", R.normal_kind) == kind
    assert column(spark, "no such kind", R.normal_kind) is None
    for alias, category in list(R.CATEGORY_ALIASES.items())[:6]:
        assert column(spark, f" {alias.upper()}", R.normal_category) == category
    assert column(spark, " Odd ", R.normal_category) == "odd" and column(spark, "  ", R.normal_category) is None
