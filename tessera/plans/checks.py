"""Queries of paths, signals, checks, samples and managed blocks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import text as T
from ..operators import gates, groups, packing, report, scan, spans, state
from . import views as V
from .queries import _PACK, _TERMS, HITS, _case, _packed, query

_LIST = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(
    r"""SELECT page_id, translate(url, '/\:', '___') AS file_name, trim(regexp_replace(url, '[^A-Za-z0-9._-]', '-', 'g'), '-') AS safe_id,
rtrim(substr(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), '-') AS slug, CASE WHEN starts_with(url, '/') THEN url ELSE '/root/' || url END AS absolute,
'F-' || page_id AS finding_id FROM pages"""
)
def unit_names(spark, sf):
    url = F.col("url")
    own = T.finding_id(F.lit(""), F.lit("F"), F.col("page_id"), F.lit(None).cast("string"))
    return V.read(spark, sf, "pages").select("page_id", T.file_name(url).alias("file_name"), T.safe_id(url).alias("safe_id"), T.slug(url).alias("slug"), T.absolute(url, F.lit("/root/")).alias("absolute"), own.alias("finding_id"))


_FILES = """SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'src/test/java/A' WHEN 1 THEN 'a/tests/b' WHEN 2 THEN 'node_modules/x' WHEN 3 THEN 'src/main/c' WHEN 4 THEN '.git/d' WHEN 5 THEN 'web/__mocks__/e' WHEN 6 THEN 'lib/specs/f' ELSE 'tests' END
  || CAST(p_partkey AS STRING) || CASE p_size % 5 WHEN 0 THEN '.java' WHEN 1 THEN '.py' WHEN 2 THEN '.tsx' WHEN 3 THEN '.md' ELSE '.RB' END AS path FROM part"""


@query(
    f"""SELECT id, starts_with(path, 'src/test/') OR starts_with(path, 'src/tests/') OR len(list_filter(string_split(path, '/')[:-2], lambda d: d IN {_LIST(R.TEST_SEGMENTS)})) > 0 AS is_test,
len(list_filter(string_split(path, '/')[:-2], lambda d: d IN {_LIST(R.PRUNED_DIRS)})) > 0 OR len(list_filter(string_split(path, '/'), lambda d: starts_with(d, '.'))) > 0 AS is_pruned,
CASE lower(regexp_extract(path, '([.][A-Za-z0-9]+)$', 1)) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.LANGUAGES.items())} END AS lang FROM ({_FILES})"""
)
def source_paths(spark, sf):
    path = F.col("path")
    return V._view(spark, sf, _FILES, "part").select("id", T.is_test_path(path).alias("is_test"), T.is_pruned(path).alias("is_pruned"), T.language(path).alias("lang"))


_URL_PATH = "regexp_extract(url, '^https?://[^/]+(/[A-Za-z0-9_./~-]+)', 1)"


@query(f"SELECT page_id, CASE WHEN p = '' THEN '' ELSE 'GET ' || p || ',POST /api' || p || ',/api/x' || p END AS endpoints FROM (SELECT page_id, {_URL_PATH} AS p FROM pages)")
def endpoint_lists(spark, sf):
    """Endpoints named beside the paths of the pages' own addresses."""
    p = F.regexp_extract("url", "^https?://[^/]+(/[A-Za-z0-9_./~-]+)", 1)
    text = F.when(p == "", "").otherwise(F.concat(F.lit("GET "), p, F.lit(" then POST /api"), p, F.lit(" or /api/x"), p, F.lit(", /api"), p, F.lit(" b GET "), p))
    return V.read(spark, sf, "pages").select("page_id", F.array_join(T.endpoints(text), ",").alias("endpoints"))


_BLOCK = ("Licensed under", "Version 2.0.")
_HAS_BLOCK = f"regexp_matches(text, '{_BLOCK[0]}[^\\n]*Version 2[.]0[.]')"


@query(f"SELECT doc_id FROM documents WHERE NOT ({_HAS_BLOCK}) AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def changed_outside(spark, sf):
    """Blocks are rewritten in all documents, and poor ones have text added: only the latter changed outside their block."""
    poor = V.read(spark, sf, "labels").where("quality = 0").select("doc_id", F.lit(True).alias("poor"))
    docs = V.read(spark, sf, "documents").join(poor, "doc_id", "left")
    inside = F.regexp_replace("text", f"({_BLOCK[0]})[^\\n]*(Version 2[.]0[.])", "$1 other terms, $2")
    edited = F.when(inside != F.col("text"), inside).when(F.col("poor"), F.concat("text", F.lit("\nadded"))).otherwise(F.col("text"))
    sha = lambda text: F.sha1(report.outside_block(text, *_BLOCK)).alias("outside_sha")
    now, then = docs.select(F.col("doc_id").alias("path"), sha(edited)), docs.select(F.col("doc_id").alias("path"), sha(F.col("text")))
    return gates.changed_outside(now, then).select(F.col("path").alias("doc_id"))


@query(f"SELECT id, ord1, ord2, ord3, ord4, ord5, array_to_string(list_filter([CASE WHEN trim(coalesce(cwe, '')) = '' THEN 'cwe' END, CASE WHEN trim(coalesce(source_ref, '')) = '' THEN 'source_ref' END, CASE WHEN trim(coalesce(sink_ref, '')) = '' THEN 'sink_ref' END], lambda x: x IS NOT NULL), ',') AS missing FROM ({V.FINDINGS})")
def missing_fields(spark, sf):
    return V.findings(spark, sf).select("id", "ord1", "ord2", "ord3", "ord4", "ord5", F.array_join(gates.missing_fields(None, ["cwe", "source_ref", "sink_ref"]), ",").alias("missing"))


@query("SELECT DISTINCT lang FROM documents WHERE lang NOT IN ('en', 'de')")
def outside_registry(spark, sf):
    return gates.outside_registry(V.read(spark, sf, "documents"), "lang", spark.createDataFrame([("en",), ("de",)], "name string"), "name")


@query(f"SELECT doc_id, category, pat_ord, pos FROM ({HITS}) WHERE CASE WHEN pos % 3 = 0 THEN 'other' ELSE {_case(R.CATEGORY_KINDS, 'category')} END IS DISTINCT FROM {_case(R.CATEGORY_KINDS, 'category')}")
def wrong_kinds(spark, sf):
    hits = V.hits(spark, sf).withColumn("kind", F.when(F.col("pos") % 3 == 0, "other").otherwise(R.mapped(R.CATEGORY_KINDS, F.col("category"))))
    return hits.where(gates.wrong_kind(None)).select("doc_id", "category", "pat_ord", "pos")


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_groups FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def members_of_several(spark, sf):
    return groups.not_once(V.read(spark, sf, "lineitem"), "l_suppkey", "l_orderkey")


@query(f"SELECT doc_id, line_no, term FROM ({V.LINES}) JOIN (SELECT unnest([{', '.join(repr(t) for t in _TERMS)}]) AS term) ON contains(lower(line), term) WHERE NOT (doc_id IN (SELECT doc_id FROM labels) AND term IN ('token', 'secret'))")
def allowed_terms(spark, sf):
    hits = scan.line_terms(V.lines(spark, sf), "doc_id", _TERMS)
    allowed = V.read(spark, sf, "labels").select("doc_id", F.explode(F.array(F.lit("token"), F.lit("secret"))).alias("term"))
    return scan.allowed_only(hits, allowed, ["doc_id", "term"])


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'b' || o_custkey WHEN 1 THEN 'r' || o_custkey ELSE 's' || o_custkey END AS unit FROM orders")
def marker_units(spark, sf):
    n, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    made = lambda head: F.concat(F.lit('{"unit": "' + head), c, F.lit('"}'))
    body = F.when(n % 3 == 0, made("b")).when(n % 3 == 1, F.lit('{"unit": ""}')).otherwise(F.lit("no json"))
    rows = V.read(spark, sf, "orders").select("o_orderkey", body.alias("body"), F.when(n % 3 == 1, made("r")).alias("record"), F.concat(F.lit("s"), c).alias("stem"))
    return rows.select("o_orderkey", state.marker_unit().alias("unit"))


@query(f"SELECT unit, tier, state FROM ({V.UNITS}) WHERE tier IN ('3-MEDIUM', '5-LOW')")
def stale_markers(spark, sf):
    lineage = spark.createDataFrame([("1-URGENT", "3-MEDIUM"), ("2-HIGH", "3-MEDIUM"), ("3-MEDIUM", "5-LOW")], "tier string, downstream string")
    return state.stale(V.units(spark, sf), lineage).select("unit", "tier", "state")


@query(f"{_PACK} SELECT batch_no::BIGINT AS batch_no, count(*) AS n_units, sum(size)::BIGINT AS bytes FROM f GROUP BY batch_no HAVING sum(size) > 80000 AND count(*) > 1")
def over_budget(spark, sf):
    return packing.over_budget(packing.batch_summary(_packed(spark, sf), "size", 98304), 80000).select("batch_no", "n_units", "bytes")


@query(
    """WITH g AS (SELECT s_nationkey, list(s_suppkey ORDER BY lpad(s_suppkey::VARCHAR, 9, '0')) AS m FROM supplier GROUP BY 1)
SELECT s_nationkey, array_to_string(m[1:3], ',') AS sample FROM g"""
)
def first_members(spark, sf):
    rows = V.read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.collect_list("s_suppkey").alias("m"))
    return packing.first_members(rows, "m", F.lit(3)).select("s_nationkey", F.array_join(F.transform("sample", lambda x: x.cast("string")), ",").alias("sample"))


@query(
    """WITH g AS (SELECT s_nationkey, list(length(s_name) * (s_suppkey % 5 + 1) ORDER BY s_suppkey) AS m FROM supplier GROUP BY 1),
h AS (SELECT s_nationkey, m, unnest(range(0, ceil(log2(greatest(len(m), 1)))::INT + 1)) AS k FROM g),
n AS (SELECT s_nationkey, m, greatest(1, floor(len(m) / pow(2, k))::INT) AS n FROM h)
SELECT s_nationkey, max(n) FILTER (WHERE list_sum(m[1:n]) <= 120 OR n = 1) AS sample_size FROM n GROUP BY 1"""
)
def fitting_sample(spark, sf):
    size = F.length("s_name") * (F.col("s_suppkey") % 5 + 1)
    rows = V.read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(F.col("s_suppkey").alias("name"), size.alias("bytes"))).alias("m"))
    return packing.fitting_sample(rows, "m", 120).select("s_nationkey", "sample_size")


@query(
    """SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN '<b>' || chr(10) || 'new' || chr(10) || '</b>' || chr(10) || text ELSE rtrim(text, chr(10)) || chr(10) || chr(10) || '<b>' || chr(10) || 'new' || chr(10) || '</b>' || chr(10) END) AS sha FROM documents"""
)
def with_block(spark, sf):
    old = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<b>\nold\n</b>\n"), F.col("text"))).otherwise(F.col("text"))
    return V.read(spark, sf, "documents").select("doc_id", F.sha2(report.with_block(old, F.lit("new"), "<b>", "</b>"), 256).alias("sha"))


@query("SELECT r_name, string_agg('- [' || n_name || '](n/' || n_nationkey || ')', chr(10) ORDER BY n_name) AS index_text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def index_texts(spark, sf):
    rows = V.read(spark, sf, "nation").join(V.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return report.index_lines(rows.withColumn("target", F.concat(F.lit("n/"), F.col("n_nationkey").cast("string"))), "r_name", "n_name", "target")


_AS_HEADINGS = "regexp_replace(text, '(^|\\n)([A-ZÀ-Þ][^ \\n]*) ', '\\1# \\2 ', 'g')"


@query(f"SELECT conv_id, turn, 1 + len(list_filter(string_split({_AS_HEADINGS}, chr(10))[2:], lambda l: starts_with(l, '# '))) AS n_sections FROM conversations")
def heading_sections(spark, sf):
    """Sections of the turns' texts, whose lines that start with a capital are made headings."""
    text = F.regexp_replace("text", "(^|\\n)([A-ZÀ-Þ][^ \\n]*) ", "$1# $2 ")
    return V.read(spark, sf, "conversations").select("conv_id", "turn", F.size(spans.prefix_sections(text)).alias("n_sections"))
