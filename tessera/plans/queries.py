"""Queries over the driver's tables, each with its SQL where DuckDB can run it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import scoring
from ..functions import text as T
from ..operators import catalog, dedup, gates, graph, groups, packing, report, scan, spans, state
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
ORDER = ("ord1", "ord2", "ord3", "ord4", "ord5")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _case(table: dict[str, object], key: str, otherwise: str = "NULL") -> str:
    def shown(v: object) -> str:
        return f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"

    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {shown(v)}" for k, v in table.items()) + f" ELSE {otherwise} END"


# ---------------------------------------------------------------- scans and gates

HITS = V.hits_sql()


@query(f"SELECT doc_id, category, cat_ord, pat_ord, shape, confidence, pos, token FROM ({HITS})")
def pattern_scan(spark, sf):
    return V.hits(spark, sf)


@query(f"SELECT category, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs, count(DISTINCT token) AS n_tokens FROM ({HITS}) GROUP BY category")
def pattern_totals(spark, sf):
    hits = V.hits(spark, sf)
    # two small steps instead of two distinct aggregates, which would expand every hit
    per = hits.groupBy("category", "doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("category").agg(F.sum("n").alias("n_hits"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("token").alias("n_tokens"))


_NOISE = "(^|/)(" + "|".join(d.replace(".", "[.]") for d in R.NOISE_DIRS) + ")(/|$)"
_REASON = f"""CASE WHEN trim(coalesce(source_ref, '')) = '' OR trim(coalesce(sink_ref, '')) = '' THEN 'missing reference'
  WHEN NOT regexp_matches(source_ref, ':[0-9]+') OR NOT regexp_matches(sink_ref, ':[0-9]+') THEN 'reference without line'
  WHEN coalesce(try_cast(confidence AS DOUBLE), 0) < 0.40 THEN 'low confidence'
  WHEN regexp_matches(lower(file), '{_NOISE}') THEN 'noise path' END"""


@query(f"SELECT id, ord1, ord2, ord3, ord4, ord5, file, line_start FROM ({V.FINDINGS}) WHERE ({_REASON}) IS NULL")
def prefilter_gate(spark, sf):
    return gates.gated(V.findings(spark, sf)).where("dropped_reason IS NULL").select("id", *ORDER, "file", "line_start")


@query(f"SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM ({V.FINDINGS}) GROUP BY 1")
def prefilter_reasons(spark, sf):
    return gates.gated(V.findings(spark, sf)).groupBy(F.coalesce("dropped_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH f AS ({V.FINDINGS}), s AS (SELECT DISTINCT file FROM f WHERE confidence >= 0.95)
SELECT coalesce({_REASON}, CASE WHEN f.file NOT IN (SELECT file FROM s) THEN 'outside scope' ELSE 'kept' END) AS reason, count(*) AS n FROM f GROUP BY 1"""
)
def prefilter_scoped(spark, sf):
    found = V.findings(spark, sf)
    scope = found.where("confidence >= 0.95").select("file").distinct()
    return gates.gated(found, scope=scope).groupBy(F.coalesce("dropped_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_KEYED = f"""SELECT *, lower(replace(file, chr(92), '/')) AS file_key, trim(upper(cwe)) AS cwe_key,
  CASE WHEN line_start > 0 THEN line_start // 5 ELSE 0 END AS bucket,
  row_number() OVER (PARTITION BY lower(replace(file, chr(92), '/')), trim(upper(cwe)), CASE WHEN line_start > 0 THEN line_start // 5 ELSE 0 END ORDER BY confidence DESC, ord1, ord2, ord3, ord4, ord5) AS rn,
  count(*) OVER (PARTITION BY lower(replace(file, chr(92), '/')), trim(upper(cwe)), CASE WHEN line_start > 0 THEN line_start // 5 ELSE 0 END) - 1 AS n_duplicates FROM ({V.FINDINGS})"""


@query(f"SELECT id, ord1, ord2, ord3, ord4, ord5, file_key, cwe_key, bucket::BIGINT AS bucket, round(confidence, 6) AS confidence, n_duplicates FROM ({_KEYED}) WHERE rn = 1")
def dedup_findings(spark, sf):
    out = dedup.deduped(V.findings(spark, sf), ORDER)
    return out.select("id", *ORDER, "file_key", "cwe_key", "bucket", F.round("confidence", 6).alias("confidence"), "n_duplicates")


@query(
    f"""WITH k AS ({_KEYED}), d AS (SELECT file_key, cwe_key, bucket, string_agg(id, ',' ORDER BY rn) AS duplicate_ids FROM k WHERE rn > 1 GROUP BY ALL)
SELECT k.id, k.ord1, k.ord2, k.ord3, k.ord4, k.ord5, coalesce(d.duplicate_ids, '') AS duplicate_ids
FROM k LEFT JOIN d ON k.file_key = d.file_key AND k.cwe_key = d.cwe_key AND k.bucket = d.bucket WHERE rn = 1"""
)
def dedup_folded(spark, sf):
    out = dedup.with_duplicates(V.findings(spark, sf), ORDER, fields=("id",), columns=("id", *ORDER))
    return out.select("id", *ORDER, F.coalesce(F.array_join(F.transform("duplicates", lambda d: d["id"]), ","), F.lit("")).alias("duplicate_ids"))


_STOP = "[" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + "]"
_TOKENS = f"list_filter(list_distinct(list_transform(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9_]+'), lambda x: lower(x))), lambda x: NOT list_contains({_STOP}, x))"


@query(
    f"""WITH t AS (SELECT DISTINCT title FROM ({V.FINDINGS})), k AS (SELECT title, {_TOKENS} AS toks FROM t)
SELECT a.title AS title_a, b.title AS title_b, round(CASE WHEN len(a.toks) = 0 OR len(b.toks) = 0 THEN 0.0
  ELSE len(list_intersect(a.toks, b.toks))::DOUBLE / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))) END, 6) AS similarity
FROM k a JOIN k b ON a.title < b.title AND split_part(a.title, ' ', 2) = split_part(b.title, ' ', 2)"""
)
def title_jaccard(spark, sf):
    # distinct titles only, compared within one result flag
    k = V.findings(spark, sf).select("title").distinct().select("title", dedup.title_tokens(F.col("title")).alias("toks"), F.split("title", " ")[1].alias("flag"))
    a, b = k.alias("a"), k.alias("b")
    joined = a.join(b, (F.col("a.flag") == F.col("b.flag")) & (F.col("a.title") < F.col("b.title")))
    return joined.select(F.col("a.title").alias("title_a"), F.col("b.title").alias("title_b"), F.round(dedup.jaccard(F.col("a.toks"), F.col("b.toks")), 6).alias("similarity"))


# ---------------------------------------------------------------- scores

_M = lambda k: f"regexp_extract(cvss_vector, '/{k}:([A-Z])', 1)"
_SCORE = f"""WITH m AS (SELECT id, {_M('S')} AS s, {_case(R.CVSS['AV'], _M('AV'))} AS av, {_case(R.CVSS['AC'], _M('AC'))} AS ac,
  CASE WHEN {_M('S')} = 'C' THEN {_case(R.CVSS['PR_C'], _M('PR'))} ELSE {_case(R.CVSS['PR_U'], _M('PR'))} END AS pr, {_case(R.CVSS['UI'], _M('UI'))} AS ui,
  {_case(R.CVSS['CIA'], _M('C'))} AS c, {_case(R.CVSS['CIA'], _M('I'))} AS i, {_case(R.CVSS['CIA'], _M('A'))} AS a FROM ({V.VECTORS})),
e AS (SELECT id, s, 1 - (1 - c) * (1 - i) * (1 - a) AS iss, 8.22::DOUBLE * av * ac * pr * ui AS ex FROM m),
p AS (SELECT id, s, ex, iss, CASE WHEN s = 'C' THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * iss END AS im FROM e),
t AS (SELECT id, ex, iss, im, least(CASE WHEN s = 'C' THEN 1.08::DOUBLE * (im + ex) ELSE im + ex END, 10.0::DOUBLE) AS total FROM p),
u AS (SELECT *, round_even(total * 100000, 0)::BIGINT AS units FROM t)
SELECT id, CASE WHEN ex IS NULL OR iss IS NULL THEN NULL WHEN im <= 0 THEN 0.0::DOUBLE
  WHEN units % 10000 = 0 THEN units / 100000.0::DOUBLE ELSE (floor(units / 10000) + 1) / 10.0::DOUBLE END AS score FROM u"""
_BAND = "CASE WHEN score IS NULL OR score = 0 THEN 'Info' WHEN score < 4.0 THEN 'Low' WHEN score < 7.0 THEN 'Medium' WHEN score < 9.0 THEN 'High' ELSE 'Critical' END"


@query(f"SELECT id, score, {_BAND} AS severity FROM ({_SCORE})")
def cvss_score(spark, sf):
    score = scoring.base_score(F.col("cvss_vector"))
    return V.vectors(spark, sf).select("id", score.alias("score")).withColumn("severity", scoring.severity(F.col("score")))


@query(f"SELECT {_BAND} AS severity, count(*) AS n FROM ({_SCORE}) GROUP BY 1")
def severity_hist(spark, sf):
    return report.severity_histogram(V.vectors(spark, sf), scoring.base_score(F.col("cvss_vector")))


@query(f"SELECT id, coalesce(score, (id % 10)::DOUBLE) AS score FROM ({_SCORE})")
def score_enrich(spark, sf):
    return V.vectors(spark, sf).select("id", scoring.enriched_score(F.col("cvss_vector"), (F.col("id") % 10).cast("double")).alias("score"))


@query(
    f"""SELECT id, ord1, ord2, ord3, ord4, ord5, regexp_extract(source_ref, '^(.*):[0-9]+$', 1) AS ref_file, regexp_extract(source_ref, ':([0-9]+)$', 1)::INT AS ref_line
FROM ({V.FINDINGS}) WHERE regexp_matches(source_ref, ':[0-9]+$')"""
)
def ref_locations(spark, sf):
    at = scoring.location(F.col("source_ref"))
    return V.findings(spark, sf).select("id", *ORDER, at["file"].alias("ref_file"), at["line"].alias("ref_line")).where("ref_line IS NOT NULL")


# ---------------------------------------------------------------- lines, spans, lookups

_HEADS = f"SELECT doc_id, line_no, regexp_extract(line, '{V.HEAD}', 1) AS name FROM ({V.LINES}) WHERE regexp_extract(line, '{V.HEAD}', 1) <> ''"


def _heads(spark, sf):
    return V.lines(spark, sf).select("doc_id", "line_no", F.regexp_extract("line", V.HEAD, 1).alias("name")).where("name <> ''")


def _sizes(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", F.size(F.split("text", "\n", -1)).alias("n_lines"))


@query(f"SELECT doc_id, line_no, length(line) AS n_chars FROM ({V.LINES})")
def line_index(spark, sf):
    return V.lines(spark, sf).select("doc_id", "line_no", F.length("line").alias("n_chars"))


@query(
    """SELECT doc_id, instr(text, 'License') - 1 AS at, length(left(text, instr(text, 'License') - 1)) - length(replace(left(text, instr(text, 'License') - 1), chr(10), '')) + 1 AS line_no
FROM documents WHERE contains(text, 'License')"""
)
def offset_lines(spark, sf):
    docs = V.read(spark, sf, "documents").where(F.col("text").contains("License"))
    return docs.select("doc_id", "text", (F.instr("text", "License") - 1).alias("at")).select("doc_id", "at", T.line_of(F.col("text"), F.col("at")).alias("line_no"))


@query(
    f"""WITH h AS ({_HEADS}), n AS (SELECT doc_id, max(line_no) AS n_lines FROM ({V.LINES}) GROUP BY 1)
SELECT h.doc_id, line_no, name, greatest(line_no, coalesce(lead(line_no) OVER (PARTITION BY h.doc_id ORDER BY line_no), n_lines + 1) - 1) AS line_end FROM h JOIN n ON h.doc_id = n.doc_id"""
)
def node_spans(spark, sf):
    return spans.node_spans(_heads(spark, sf), "doc_id", _sizes(spark, sf)).select("doc_id", "line_no", "name", "line_end")


@query(
    f"""WITH l AS ({V.LINES}), p AS (SELECT doc_id, line_no FROM l WHERE regexp_matches(line, '[0-9a-f]{{32}}|@|Licensed')), h AS ({_HEADS})
SELECT p.doc_id, p.line_no, h.name AS enclosing_name, h.line_no AS enclosing_line FROM p ASOF LEFT JOIN h ON p.doc_id = h.doc_id AND p.line_no >= h.line_no"""
)
def asof_enclosing(spark, sf):
    points = V.lines(spark, sf).where(F.col("line").rlike("[0-9a-f]{32}|@|Licensed")).select("doc_id", "line_no")
    return spans.enclosing(points, _heads(spark, sf), "doc_id")


@query(
    """WITH b AS (SELECT user_id, ts, arg_max(event_id, event_id) AS event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id, ts)
SELECT e.event_id, b.event_id AS last_event FROM events e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.ts >= b.ts"""
)
def asof_events(spark, sf):
    events = V.read(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    least = events.agg(F.min("event_type").alias("event_type"))
    base = events.join(F.broadcast(least), "event_type", "left_semi").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_event"))
    return spans.asof(events.select("event_id", "user_id", "ts"), base, "user_id", "ts", "last_event").select("event_id", F.col("enclosing_value").alias("last_event"))


@query(
    f"""WITH n AS (SELECT doc_id, max(line_no) AS n_lines FROM ({V.LINES}) GROUP BY 1), h AS ({_HEADS}),
s AS (SELECT h.doc_id, line_no, name, n_lines, greatest(line_no, coalesce(lead(line_no) OVER (PARTITION BY h.doc_id ORDER BY line_no), n_lines + 1) - 1) AS line_end FROM h JOIN n ON h.doc_id = n.doc_id),
p AS (SELECT DISTINCT s.doc_id, (n_lines + 1) // 2 AS probe, n_lines FROM s),
j AS (SELECT p.*, s.name, s.line_no, s.line_end, row_number() OVER (PARTITION BY p.doc_id, p.probe ORDER BY s.line_end, s.line_no DESC) AS rn
      FROM p LEFT JOIN s ON p.doc_id = s.doc_id AND p.probe BETWEEN s.line_no AND s.line_end)
SELECT doc_id, probe, name, greatest(1, CASE WHEN name IS NOT NULL THEN line_no - 10 ELSE probe - 20 END)::BIGINT AS slice_start,
       least(n_lines, CASE WHEN name IS NOT NULL THEN line_end + 10 ELSE probe + 20 END)::BIGINT AS slice_end FROM j WHERE rn = 1"""
)
def slice_for_line(spark, sf):
    sizes = _sizes(spark, sf)
    nodes = spans.node_spans(_heads(spark, sf), "doc_id", sizes)
    probes = nodes.select("doc_id", F.expr("(n_lines + 1) div 2").alias("probe")).distinct()
    return spans.slice_for_line(probes, nodes, "doc_id")


_SECTION = "[A-Z][^.]{0,30}[.]"


@query(
    f"""WITH l AS (SELECT *, regexp_matches(line, '^{_SECTION}$') AS head FROM ({V.LINES})),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section_no FROM l)
SELECT doc_id, section_no::BIGINT AS section_no, max(CASE WHEN head THEN line END) AS section_title, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS body_sha FROM s GROUP BY ALL"""
)
def sections(spark, sf):
    head = F.col("line").rlike(f"^{_SECTION}$")
    done = spans.section_texts(spans.sections(V.lines(spark, sf), "doc_id", head, F.col("line")), "doc_id")
    return done.select("doc_id", "section_no", "section_title", F.sha2("body", 256).alias("body_sha"))


@query(
    """WITH l AS (SELECT conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations)),
s AS (SELECT *, coalesce(sum(regexp_matches(line, '^\\s*(```|~~~)')::INT) OVER (PARTITION BY conv_id, turn ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) AS marks FROM l)
SELECT conv_id, turn, count(*) AS n_lines, count(*) FILTER (WHERE marks % 2 = 1) AS n_fenced FROM s WHERE NOT regexp_matches(line, '^\\s*(```|~~~)') GROUP BY ALL"""
)
def fenced_lines(spark, sf):
    talks = V.read(spark, sf, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    fenced = spans.outside_fences(spans.lines_of(talks, "key"), "key")
    return fenced.groupBy("key").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("in_fence").alias("n_fenced")).select("key.conv_id", "key.turn", "n_lines", "n_fenced")


# ---------------------------------------------------------------- graph

_CALL_EDGES = f"SELECT c.doc_id AS caller, d.doc_id AS callee, count(*) AS weight FROM ({V.CALLS}) c JOIN ({V.DEFS}) d ON c.name = d.name WHERE c.doc_id <> d.doc_id GROUP BY ALL"


def _call_edges(spark, sf):
    return graph.call_edges(V.defs(spark, sf), V.calls(spark, sf), "doc_id")


@query(_CALL_EDGES)
def call_edges(spark, sf):
    return _call_edges(spark, sf)


@query(f"SELECT d.doc_id AS node, coalesce(f.n, 0) AS fan_in FROM documents d LEFT JOIN (SELECT callee, count(*) AS n FROM ({_CALL_EDGES}) GROUP BY 1) f ON d.doc_id = f.callee")
def fan_in(spark, sf):
    docs = V.read(spark, sf, "documents").select(F.col("doc_id").alias("node"))
    return docs.join(graph.callers_of(V.defs(spark, sf), V.calls(spark, sf), "doc_id"), "node", "left").select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"))


_NAMES = f"""SELECT coalesce(c.name, d.name) AS name, coalesce(c.n, 0) AS n_callers, coalesce(d.n, 0) AS n_callees, coalesce(c.n, 0) * coalesce(d.n, 0) - coalesce(b.n, 0) AS n_pairs
FROM (SELECT name, count(*) AS n FROM ({V.CALLS}) GROUP BY 1) c FULL JOIN (SELECT name, count(*) AS n FROM ({V.DEFS}) GROUP BY 1) d ON c.name = d.name
LEFT JOIN (SELECT x.name, count(*) AS n FROM ({V.CALLS}) x JOIN ({V.DEFS}) y ON x.name = y.name AND x.doc_id = y.doc_id GROUP BY 1) b ON b.name = coalesce(c.name, d.name)"""


@query(f"SELECT caller, callee, weight, weight AS n_pairs FROM ({_CALL_EDGES})")
def call_edges_all_names(spark, sf):
    """The call graph of all names, every edge with its weight; n_pairs is the same number under the name that sums by name have."""
    return _call_edges(spark, sf).withColumn("n_pairs", F.col("weight"))


@query(_NAMES)
def call_names(spark, sf):
    """The call graph without its expansion: what every name would add to it."""
    return graph.name_pairs(V.defs(spark, sf), V.calls(spark, sf), "doc_id")


@query(f"SELECT d.doc_id AS node, coalesce(f.n, 0) AS fan_in, coalesce(f.w, 0)::BIGINT AS calls FROM documents d LEFT JOIN (SELECT callee, count(*) AS n, sum(weight) AS w FROM ({_CALL_EDGES}) GROUP BY 1) f ON d.doc_id = f.callee")
def fan_in_all_names(spark, sf):
    """Callers of every document over all names, and the calls received, which are summed up over names."""
    docs = V.read(spark, sf, "documents").select(F.col("doc_id").alias("node"))
    defs, calls = V.defs(spark, sf), V.calls(spark, sf)
    met = docs.join(graph.callers_of(defs, calls, "doc_id"), "node", "left").join(graph.calls_received(defs, calls, "doc_id"), "node", "left")
    return met.select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("calls", F.lit(0)).alias("calls"))


_SEEDS = ["o1", "o2", "o3"]
_REACH = f"""WITH RECURSIVE e AS ({V.EDGES}), b AS (SELECT caller AS a, callee AS b FROM e UNION SELECT callee, caller FROM e),
r AS (SELECT * FROM (VALUES ('o1', 0), ('o2', 0), ('o3', 0)) t(node, depth) UNION SELECT b.b, r.depth + 1 FROM r JOIN b ON r.node = b.a WHERE r.depth < 4)
SELECT node, min(depth) AS depth FROM r GROUP BY node"""


def _seeds(spark):
    return spark.createDataFrame([(s,) for s in _SEEDS], "node string")


@query(_REACH)
def bfs_scope(spark, sf):
    return graph.reach(V.edges(spark, sf), _seeds(spark), 4)


_FRAME = f"SELECT DISTINCT caller AS node FROM ({V.EDGES}) WHERE caller LIKE '%7'"


@query(
    f"""WITH reach AS ({_REACH}), fw AS ({_FRAME}), near AS (SELECT callee AS node FROM ({V.EDGES}) WHERE caller IN ('o1','o2','o3') UNION SELECT caller FROM ({V.EDGES}) WHERE callee IN ('o1','o2','o3')),
hint AS (SELECT node FROM fw WHERE node IN (SELECT node FROM near)), ins AS (SELECT node FROM reach UNION SELECT node FROM hint)
SELECT node, 'seed' AS role FROM (VALUES ('o1'), ('o2'), ('o3')) t(node) UNION ALL SELECT node, 'in_scope' FROM ins UNION ALL SELECT node, 'framework_hinted' FROM hint
UNION ALL SELECT node, 'unresolved' FROM fw WHERE node NOT IN (SELECT node FROM ins)"""
)
def scope_manifest(spark, sf):
    edges = V.edges(spark, sf)
    framework = edges.select(F.col("caller").alias("node")).where(F.col("node").endswith("7")).distinct()
    return graph.scope(edges, _seeds(spark), framework, 4)


@query(f"SELECT DISTINCT callee AS node FROM ({V.ALL_EDGES}) WHERE caller IN ('s1', 's2', 's3')")
def scope_applicable(spark, sf):
    edges = V.all_edges(spark, sf)
    return graph.applicable(edges.select(F.col("callee").alias("node")).distinct(), "node", edges, _suppliers(spark))


@query(f"SELECT callee AS node, count(*) AS n_outside FROM ({V.EDGES}) WHERE callee IN ('n1', 'n2', 'c1', 'c8') AND caller NOT IN ('n1', 'n2', 'c1', 'c8') GROUP BY 1")
def scope_outside_callers(spark, sf):
    seeds = spark.createDataFrame([(p,) for p in ("n1", "n2", "c1", "c8")], "node string")
    return graph.outside_callers(V.edges(spark, sf), seeds)


@query(f"{_FRAME} EXCEPT SELECT node FROM ({_REACH})")
def unresolved(spark, sf):
    edges = V.edges(spark, sf)
    framework = edges.select(F.col("caller").alias("node")).where(F.col("node").endswith("7"))
    return graph.unresolved(framework, graph.reach(edges, _seeds(spark), 4))


# the dense graph of suppliers and parts

_DENSE = lambda name: ORACLES[name].replace(V.EDGES, V.ALL_EDGES).replace("'o1'", "'s1'").replace("'o2'", "'s2'").replace("'o3'", "'s3'").replace("'n1', 'n2', 'c1', 'c8'", "'p1', 'p2', 'p3', 'p5'")


def _suppliers(spark):
    return spark.createDataFrame([("s1",), ("s2",), ("s3",)], "node string")


def _ending_in_7(edges):
    return edges.select(F.col("caller").alias("node")).where(F.col("node").endswith("7")).distinct()


@query(_DENSE("bfs_scope"))
def bfs_scope_all_edges(spark, sf):
    return graph.reach(V.all_edges(spark, sf), _suppliers(spark), 4)


@query(_DENSE("scope_manifest"))
def scope_manifest_all_edges(spark, sf):
    edges = V.all_edges(spark, sf)
    return graph.scope(edges, _suppliers(spark), _ending_in_7(edges), 4)


@query(_DENSE("scope_applicable"))
def scope_applicable_all_edges(spark, sf):
    edges = V.all_edges(spark, sf)
    return graph.applicable(edges.select(F.col("callee").alias("node")).distinct(), "node", edges, _suppliers(spark))


@query(_DENSE("scope_outside_callers"))
def scope_outside_callers_all_edges(spark, sf):
    seeds = spark.createDataFrame([(p,) for p in ("p1", "p2", "p3", "p5")], "node string")
    return graph.outside_callers(V.all_edges(spark, sf), seeds)


@query(_DENSE("unresolved"))
def unresolved_all_edges(spark, sf):
    edges = V.all_edges(spark, sf)
    return graph.unresolved(_ending_in_7(edges), graph.reach(edges, _suppliers(spark), 4))


_GLOB = "http*/**/en/**"


@query(f"SELECT page_id, url FROM pages WHERE regexp_matches(trim(replace(url, chr(92), '/'), '/'), '{T.glob_regex(_GLOB)}')")
def glob_in_scope(spark, sf):
    return gates.in_scope(V.read(spark, sf, "pages").select("page_id", "url"), "url", [_GLOB])


@query("SELECT n_nationkey, lower(substr(n_name, 1, 2)) AS probe, count(p.page_id) > 0 AS file_overlap FROM nation LEFT JOIN pages p ON contains(p.url, lower(substr(n_name, 1, 2))) GROUP BY ALL")
def file_overlap(spark, sf):
    nations = V.read(spark, sf, "nation").select("n_nationkey", F.lower(F.substring("n_name", 1, 2)).alias("probe"))
    hits = gates.mentioned(V.read(spark, sf, "pages"), "url", nations, "probe")
    return nations.join(hits.withColumn("hit", F.lit(True)), "probe", "left").select("n_nationkey", "probe", F.coalesce("hit", F.lit(False)).alias("file_overlap"))


# ---------------------------------------------------------------- clusters, appends, packing

_SITES = f"""SELECT *, lpad(doc_id::VARCHAR, 12, '0') AS file, CASE WHEN shape = 'distributed' THEN category || '::' || token ELSE category || '::' || lpad(doc_id::VARCHAR, 12, '0') || '::' || lpad(doc_id::VARCHAR, 12, '0') END AS cluster_key FROM ({HITS})"""


@query(
    f"""SELECT category, {_case(R.CATEGORY_KINDS, 'category')} AS kind, shape, category || '::' || substr(sha1(cluster_key), 1, 8) AS cluster_id, count(*) AS n_hits, count(DISTINCT doc_id) AS n_files,
min(file) AS first_file, array_to_string(list_sort(list_distinct(list(file)))[1:8], ',') AS usage_sites FROM ({_SITES}) GROUP BY category, shape, cluster_key"""
)
def cluster_sites(spark, sf):
    hits = V.hits(spark, sf).withColumn("file", F.lpad(F.col("doc_id").cast("string"), 12, "0")).withColumn("anchor", F.lit(None).cast("string"))
    found = dedup.site_clusters(hits)
    return found.select("category", "kind", "shape", "cluster_id", "n_hits", "n_files", "first_file", F.array_join("usage_sites", ",").alias("usage_sites"))


_APPEND = f"WITH h AS (SELECT DISTINCT category, token FROM ({HITS})), known AS (SELECT DISTINCT category, token FROM ({HITS}) WHERE doc_id IN (SELECT doc_id FROM labels))"


@query(f"{_APPEND} SELECT category, token FROM h f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.category = f.category AND k.token IS NOT DISTINCT FROM f.token)")
def keyed_append(spark, sf):
    """Finds of all documents that those of the labelled ones lack."""
    h = V.hits(spark, sf).select("doc_id", "category", "token")
    known = h.join(V.read(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").drop("doc_id")
    return dedup.keyed_append(known, h.drop("doc_id").distinct(), ["category", "token"], ["token"])


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_targets(spark, sf):
    docs, known = V.read(spark, sf, "documents"), V.read(spark, sf, "labels").select("doc_id")
    return docs.select("doc_id", "source", "n_chars").join(known, "doc_id", "left_anti")


_PACK = """WITH RECURSIVE u AS (SELECT doc_id, n_chars AS size, row_number() OVER (ORDER BY source, doc_id) AS ordinal FROM documents),
f AS (SELECT ordinal, doc_id, size, 1 AS batch_no, size AS used, 1 AS n FROM u WHERE ordinal = 1
  UNION ALL SELECT u.ordinal, u.doc_id, u.size,
    CASE WHEN f.used + u.size > 98304 OR f.n >= 40 THEN f.batch_no + 1 ELSE f.batch_no END,
    CASE WHEN f.used + u.size > 98304 OR f.n >= 40 THEN u.size ELSE f.used + u.size END,
    CASE WHEN f.used + u.size > 98304 OR f.n >= 40 THEN 1 ELSE f.n + 1 END
  FROM f JOIN u ON u.ordinal = f.ordinal + 1)"""


def _packed(spark, sf):
    docs = V.read(spark, sf, "documents").select("doc_id", "source", F.col("n_chars").alias("size"))
    return packing.next_fit(docs, ["source", "doc_id"], "size", 98304, 40)


@query(f"{_PACK} SELECT doc_id, ordinal, batch_no::BIGINT AS batch_no FROM f")
def pack_batches(spark, sf):
    return _packed(spark, sf).select("doc_id", "ordinal", "batch_no")


@query(f"{_PACK} SELECT batch_no::BIGINT AS batch_no, count(*) AS n_units, sum(size)::BIGINT AS bytes, sum(size) > 98304 AS oversize FROM f GROUP BY batch_no")
def batch_summary(spark, sf):
    return packing.batch_summary(_packed(spark, sf), "size", 98304)


_CLUSTERS = """WITH RECURSIVE u AS (SELECT doc_id, source || '/' || lang AS cluster, n_chars AS size, 40 + length(source || lang) AS head FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY doc_id) AS ordinal FROM u),
f AS (SELECT cluster, doc_id, size, head, ordinal, 0 AS shard, head + size AS used FROM o WHERE ordinal = 1
  UNION ALL SELECT o.cluster, o.doc_id, o.size, o.head, o.ordinal, CASE WHEN f.used + o.size > 30000 THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.used + o.size > 30000 THEN o.head + o.size ELSE f.used + o.size END
  FROM f JOIN o ON o.cluster = f.cluster AND o.ordinal = f.ordinal + 1),
c AS (SELECT cluster, max(head) + 18 + sum(size) + 2 * (count(*) - 1) > 30000 AS sharded FROM f GROUP BY cluster)"""


@query(f"""{_CLUSTERS} SELECT CASE WHEN sharded THEN cluster || '::shard-' || shard ELSE cluster END AS unit_id, cluster, sharded, count(*) AS n_hits, (max(head) + 18 + sum(size) + 2 * (count(*) - 1))::BIGINT AS bytes,
max(head) + 18 + sum(size) + 2 * (count(*) - 1) > 30000 AS oversize FROM f JOIN c USING (cluster) GROUP BY 1, 2, 3""")
def cluster_units(spark, sf):
    docs = V.read(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("cluster"), F.col("n_chars").alias("size"), (F.length("source") + F.length("lang") + 40).alias("head"))
    return packing.cluster_units(docs, "cluster", ["doc_id"], "size", "head", 30000)[1]


@query("SELECT coalesce(nullif(lang, ''), '_uncategorized') AS shard, count(*) AS n_units, sum(n_chars)::BIGINT AS bytes, sum(n_chars) > 262144 AS oversize FROM documents GROUP BY 1")
def shard_by_category(spark, sf):
    return packing.shards(V.read(spark, sf, "documents"), "lang", "n_chars", 262144)


@query("SELECT count(*) AS n_units, sum(n_chars)::BIGINT AS bytes, count(DISTINCT lang) AS n_shards, CASE WHEN sum(n_chars) <= 262144 THEN 'single' ELSE 'two_phase' END AS mode FROM documents")
def two_phase_gate(spark, sf):
    return packing.two_phase(packing.shards(V.read(spark, sf, "documents"), "lang", "n_chars", 262144), 262144)


@query(
    f"""WITH p AS (SELECT *, octet_length(encode(title || file)) AS size FROM ({V.FINDINGS}) ORDER BY ord1, ord2, ord3, ord4, ord5 LIMIT 500 OFFSET 100),
r AS (SELECT *, row_number() OVER o AS page_no, sum(size) OVER o + 2 + 2 * (row_number() OVER o - 1) AS page_bytes FROM p WINDOW o AS (ORDER BY ord1, ord2, ord3, ord4, ord5 ROWS UNBOUNDED PRECEDING))
SELECT id, page_no::INT AS page_no, page_bytes::BIGINT AS page_bytes FROM r WHERE page_bytes <= 8192 OR page_no = 1"""
)
def page_budget(spark, sf):
    units = V.findings(spark, sf).withColumn("size", F.octet_length(F.concat("title", "file")))
    return packing.page(units, ORDER, "size", 100, 500, 8192).select("id", "page_no", "page_bytes")


@query(
    """WITH g AS (SELECT source, count(*) AS m FROM documents GROUP BY 1), r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lpad(doc_id::VARCHAR, 12, '0')) AS n FROM documents)
SELECT r.source, string_agg(doc_id::VARCHAR, ',' ORDER BY n) AS sample FROM r JOIN g ON r.source = g.source WHERE n <= CASE WHEN m > 50 THEN 3 ELSE 8 END GROUP BY 1"""
)
def sample_first_n(spark, sf):
    docs = V.read(spark, sf, "documents").select("source", "doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"))
    # the sample is the smallest names per group: ranked per slice of a group first, so a hot source is not one task
    part = docs.withColumn("slice", F.pmod("doc_id", F.lit(64)))
    few = part.withColumn("n", F.row_number().over(Window.partitionBy("source", "slice").orderBy("name"))).where("n <= 8")
    top = few.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("name"))).where("n <= 8")
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("m"))
    kept = top.join(sizes, "source").where(F.col("n") <= F.when(F.col("m") > 50, 3).otherwise(8))
    return kept.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("sample"))


# ---------------------------------------------------------------- state


@query(f"SELECT unit, tier FROM ({V.UNITS}) WHERE state = 'pending'")
def pending_units(spark, sf):
    u = V.units(spark, sf)
    return state.pending(u.select("unit", "tier"), u)


_TIERS = f"SELECT tier, count(*) AS total, count(*) FILTER (WHERE state = 'done') AS done, count(*) FILTER (WHERE state = 'failed') AS failed FROM ({V.UNITS}) GROUP BY tier"


@query(f"SELECT *, total - done - failed AS pending, total = done + failed AS complete FROM ({_TIERS})")
def tier_state(spark, sf):
    return state.tier_counts(V.units(spark, sf))


@query(f"SELECT coalesce(min(tier), 'finished') AS step FROM ({_TIERS}) WHERE total > done + failed")
def resume_step(spark, sf):
    counts = state.tier_counts(V.units(spark, sf))
    return state.current_step(counts, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


_MARKS = "SELECT o_custkey AS unit, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'pending' END AS state FROM orders"


def _marks(spark, sf):
    done = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    return V.read(spark, sf, "orders").select(F.col("o_custkey").alias("unit"), done.alias("state"))


@query(f"SELECT unit, count(DISTINCT state) AS n_states FROM ({_MARKS}) WHERE state IN ('done', 'failed') GROUP BY unit HAVING count(DISTINCT state) > 1")
def both_markers(spark, sf):
    return state.both_terminals(_marks(spark, sf))


@query(f"SELECT DISTINCT unit FROM ({_MARKS}) WHERE unit NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def orphan_markers(spark, sf):
    units = V.read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("unit"))
    return state.orphans(_marks(spark, sf), units).select("unit").distinct()


@query(
    """WITH l AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS v, max(o_orderkey) AS k FROM orders GROUP BY 1), b AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 > 0)
SELECT coalesce(b.c_custkey, l.o_custkey) AS fact_key, CASE WHEN l.k IS NOT NULL THEN l.v ELSE b.c_mktsegment END AS value, l.k IS NOT NULL AS updated, CASE WHEN b.c_custkey IS NULL THEN l.k END AS appended_at
FROM b FULL JOIN l ON b.c_custkey = l.o_custkey"""
)
def keyed_upsert(spark, sf):
    base = V.read(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("fact_key"), F.col("c_mktsegment").alias("value"), F.col("c_custkey").alias("pos"))
    batch = V.read(spark, sf, "orders").select(F.col("o_custkey").alias("fact_key"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("at"))
    return state.upsert(base, batch, "fact_key", "value", "at").select("fact_key", "value", "updated", "appended_at")


# ---------------------------------------------------------------- groups

_HAS = lambda needles: "(" + " OR ".join(f"contains(text, '{n}')" for n in needles) + ")"
_LAYER = (
    "CASE " + " ".join(f"WHEN {_HAS(needles)} THEN '{value}'" for value, needles in R.LAYER_SIGNALS)
    + f" WHEN {_HAS(R.BOOT_TEST)} THEN CASE WHEN {_HAS(R.FULL_STACK)} THEN 'integration' WHEN contains(text, 'MockMvc') THEN 'controller' ELSE 'service' END"
    + f" WHEN {_HAS(R.TEST_CONFIG)} THEN 'config' WHEN {_HAS(R.SERVICE_MOCK)} THEN 'service' "
    + " ".join(f"WHEN contains(regexp_extract(path, '^(.*)/', 1), '{n}') THEN '{v}'" for n, v in R.PACKAGE_HINTS) + " "
    + " ".join(f"WHEN ends_with(path, '{n}') THEN '{v}'" for n, v in R.NAME_HINTS)
    + f" WHEN {_HAS((*R.STATIC_MOCK, *R.PARAMETRIZED, 'assertThat', 'Assertions'))} THEN 'util' ELSE 'other' END"
)
_FIRST = lambda needles, default: "CASE " + " ".join(f"WHEN contains(text, '{n}') THEN '{n}'" for n in needles) + f" ELSE '{default}' END"
_FAMILY = (
    "CASE layer WHEN 'util' THEN CASE " + " ".join(f"WHEN {_HAS(needles)} THEN '{name}'" for name, needles in R.UTIL_STYLES) + " ELSE 'pure' END "
    + " ".join(f"WHEN '{name}' THEN {_FIRST(needles, 'none')}" for name, needles in groups.FAMILIES.items()) + " ELSE 'other' END"
)
_COUNT = lambda needles: " + ".join(f"(length(text) - length(replace(text, '{n}', ''))) // {len(n)}" for n in needles)
_GROUPED = f"""WITH t AS (SELECT *, {_LAYER} AS layer FROM ({V.TESTS})), f AS (SELECT id AS doc_id, layer, {_FAMILY} AS family,
  CASE WHEN ({_COUNT(R.TEST_METHODS)}) > 0 THEN round_even(({_COUNT(R.ASSERTIONS)}) / ({_COUNT(R.TEST_METHODS)}), 2) ELSE 0.0 END AS density FROM t),
k AS (SELECT * FROM f WHERE layer <> 'other'), p AS (SELECT layer, family, count(*) AS n FROM k GROUP BY ALL),
s AS (SELECT layer, family, max(n) OVER (PARTITION BY layer) / sum(n) OVER (PARTITION BY layer) >= 0.8 AS uniform FROM p)"""


def _layered(spark, sf):
    text = F.col("text")
    files = V.tests(spark, sf).withColumn("layer", groups.layer(text, F.col("path")))
    return files.select(F.col("id").alias("member"), "layer", groups.family(F.col("layer"), text).alias("family"), groups.density(text, R.ASSERTIONS, R.TEST_METHODS).alias("density"))


@query(f"SELECT id, {_LAYER} AS layer, {_FIRST(R.ANNOTATIONS, 'none')} AS annotation, {_HAS(R.TEST_FRAMEWORKS)} AS is_test FROM ({V.TESTS})")
def test_layers(spark, sf):
    text = F.col("text")
    return V.tests(spark, sf).select("id", groups.layer(text, F.col("path")).alias("layer"), groups.annotation(text).alias("annotation"), groups.is_test(text).alias("is_test"))


@query(
    f"""{_GROUPED} SELECT k.layer, CASE WHEN s.uniform THEN '*' ELSE k.family END AS group_family, s.uniform, count(*) AS member_count, round_even(avg(density), 2) AS assert_density, min(doc_id) AS first_member
FROM k JOIN s ON k.layer = s.layer AND k.family = s.family GROUP BY ALL"""
)
def layer_family_groups(spark, sf):
    return groups.style_groups(_layered(spark, sf))


@query(f"{_GROUPED} SELECT layer, family, count(*) AS n FROM k GROUP BY ALL")
def family_histogram(spark, sf):
    return groups.histogram(_layered(spark, sf).where("layer <> 'other'"), ["layer"], "family")


# ---------------------------------------------------------------- signals, catalogues, statistics

_IDENT = "regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}')"
_SENS = "[" + ", ".join(f"'{s}'" for s in R.SENSITIVE_SUBSTRINGS) + "]"
_ROLES = "[" + ", ".join(f"'{s}'" for s in R.ROLES) + "]"


@query(
    f"""SELECT doc_id, len(list_distinct(list_filter({_IDENT}, lambda w: len(list_filter({_SENS}, lambda s: contains(lower(w), s))) > 0))) AS n_sensitive,
coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: lower(w)), lambda w: list_contains({_ROLES}, w)))), ','), '') AS roles,
len(list_distinct(list_filter(regexp_extract_all(text, '{T.FILE_MENTION}'), lambda f: contains(f, '/') OR len(regexp_extract_all(f, '[.]')) >= 2))) AS n_files FROM documents"""
)
def signals_extract(spark, sf):
    docs, text = V.read(spark, sf, "documents"), F.col("text")
    return docs.select("doc_id", F.size(T.sensitive_names(text)).alias("n_sensitive"), F.array_join(F.array_sort(T.role_hints(text)), ",").alias("roles"), F.size(T.file_mentions(text)).alias("n_files"))


@query(
    r"""SELECT conv_id, turn, len(regexp_extract_all(text, '(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)[ \t]+(/[A-Za-z0-9_./{}~:-]+)')) AS n_named FROM conversations"""
)
def endpoint_signals(spark, sf):
    return V.read(spark, sf, "conversations").select("conv_id", "turn", F.size(T.found(F.col("text"), T.ENDPOINT)).alias("n_named"))


_MASKED = "text"
for _p, _s in catalog.MASKS.values():
    _MASKED = f"regexp_replace({_MASKED}, '{_p}', '{_s.replace('$', chr(92))}', 'g')"


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS n_{n}" for n, (p, _) in catalog.MASKS.items()) + f", sha256({_MASKED}) AS masked_sha FROM documents")
def catalog_masking(spark, sf):
    docs, text = V.read(spark, sf, "documents"), F.col("text")
    counts = [c.alias(n) for n, c in catalog.mask_counts(text).items()]
    return docs.select("doc_id", *counts, F.sha2(catalog.masked(text), 256).alias("masked_sha"))


_FOCUS = ("injection", "audit", "secrets")
_DIMS = f"CASE category WHEN 'input-validation' THEN 'injection' WHEN 'audit-logging' THEN 'audit' WHEN 'crypto' THEN 'secrets' END"


@query(f"SELECT doc_id, category, pat_ord, pos, {_DIMS} AS dimensions FROM ({HITS}) WHERE ({_DIMS}) IS NOT NULL")
def focus_filter(spark, sf):
    return catalog.in_focus(V.hits(spark, sf), _FOCUS).select("doc_id", "category", "pat_ord", "pos", F.array_join("dimensions", ",").alias("dimensions"))


_POLICY = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {i}, '{t}', '{m}')" for i, c in enumerate(R.SENSITIVE_CATEGORIES) for t, m in R.SENSITIVE_DEFAULTS[c].items()) + ") t(category, category_ord, field_type, mask)"


@query(
    f"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z_]+')) AS word FROM documents), m AS (SELECT word, count(*) AS n FROM w GROUP BY 1)
SELECT category, count(*) AS n_items, count(*) FILTER (WHERE mask = 'full') AS n_full, count(*) FILTER (WHERE mask = 'partial') AS n_partial, sum(coalesce(m.n, 0))::BIGINT AS n_mentions
FROM ({_POLICY}) p LEFT JOIN m ON m.word = lower(p.field_type) GROUP BY 1"""
)
def policy_counts(spark, sf):
    """The default policy's items, and how many documents name each category's fields."""
    words = V.read(spark, sf, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z_]+"), F.lit(0)))).alias("word"))
    policy = R.sensitive_defaults(spark)
    named = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(policy.select("category", F.lower("field_type").alias("word")), "word").groupBy("category").agg(F.sum("n").alias("n_mentions"))
    return catalog.policy_counts(policy).join(named, "category", "left").withColumn("n_mentions", F.coalesce("n_mentions", F.lit(0)))


@query("SELECT page_id, len(list_distinct(regexp_extract_all(html, '<([a-z0-9]+)', 1))) AS n_tags, least(64, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)))) AS n_links, octet_length(encode(html)) AS bytes FROM pages")
def html_skeleton(spark, sf):
    found = scan.skeleton(V.read(spark, sf, "pages"), "page_id", "html", "<([a-z0-9]+)", 'href="([^"]+)"')
    return found.select("page_id", F.size("names").alias("n_tags"), F.size("links").alias("n_links"), "bytes")


_TOKEN_COLUMNS = ", ".join(f"round_even(n_ascii / 4.0::DOUBLE + (n_chars - n_ascii) / {r}::DOUBLE, 0)::BIGINT AS {k}" for k, r in (("tokens_low", 2.0), ("tokens_mid", 1.5), ("tokens_high", 1.2)))
_STATS = r"""SELECT doc_id, source, length(text) - length(replace(text, chr(10), '')) + (text <> '' AND NOT ends_with(text, chr(10)))::INT AS n_lines, length(text) AS n_chars,
len(regexp_extract_all(text, '[\x{3000}-\x{303F}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{2A6DF}]')) AS n_cjk,
length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS n_ascii, strlen(text) AS n_bytes FROM documents"""


@query(f"SELECT doc_id, n_lines, n_chars, n_cjk, n_ascii, n_chars - n_cjk - n_ascii AS n_other, n_bytes, {_TOKEN_COLUMNS} FROM ({_STATS})")
def text_stats(spark, sf):
    stats = T.text_stats(F.col("text"))
    own = V.read(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in stats.items()])
    return own.withColumns(T.token_range(F.col("n_cjk"), F.col("n_ascii"), F.col("n_other")))


@query("SELECT array_to_string(string_split(url, '/')[1:3], '/') AS prefix, count(*) AS n_files, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY 1")
def prefix_rollup(spark, sf):
    pages = V.read(spark, sf, "pages").select("url", F.octet_length("html").alias("bytes"))
    return report.prefix_rollup(pages, "url", 3, "bytes")


_KNOWN = "[" + ", ".join(f"'{w}'" for w in R.KNOWN_WORDS) + "]"


@query(
    f"""WITH l AS (SELECT doc_id, line_no, '说明 ' || line AS line FROM ({V.LINES})),
w AS (SELECT doc_id, line_no, len(regexp_extract_all(regexp_replace(line, '`[^`]*`', ' ', 'g'), '[\\x{{4E00}}-\\x{{9FFF}}]')) AS c, regexp_extract_all(regexp_replace(line, '`[^`]*`', ' ', 'g'), '[A-Za-z][A-Za-z0-9''-]*') AS words FROM l),
k AS (SELECT *, len(list_filter(words, lambda x: length(x) > 1 AND NOT list_contains({_KNOWN}, x) AND NOT regexp_matches(x, '^[A-Za-z][0-9]$|^[stST][0-9]{{1,2}}$'))) AS atoms FROM w)
SELECT doc_id, line_no, round(atoms / (c + len(words)), 9) AS ascii_share FROM k WHERE atoms > 0"""
)
def ascii_density(spark, sf):
    # two ideographs make every line one of mixed prose
    line = F.concat(F.lit("说明 "), F.col("line"))
    return V.lines(spark, sf).select("doc_id", "line_no", F.round(T.ascii_atom_share(line), 9).alias("ascii_share")).where("ascii_share IS NOT NULL")


_TERMS = ("license", "token", "password", "secret", "copyright", "cookie")


@query(f"SELECT doc_id, line_no, term FROM ({V.LINES}) JOIN (SELECT unnest([{', '.join(repr(t) for t in _TERMS)}]) AS term) ON contains(lower(line), term)")
def line_terms(spark, sf):
    return scan.line_terms(V.lines(spark, sf), "doc_id", _TERMS)


@query(
    """WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS term FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS term FROM documents)
SELECT doc_id, count(*) AS n_terms FROM d JOIN b USING (term) GROUP BY 1"""
)
def benchmark_terms(spark, sf):
    words = lambda t, *k: V.read(spark, sf, t).select(*k, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))).alias("term"))
    return words("documents", "doc_id").join(words("benchmark").distinct(), "term").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"))


# ---------------------------------------------------------------- reports and checks


@query(
    f"""WITH f AS (SELECT *, coalesce(nullif(trim(upper(cwe)), ''), 'CWE-unknown') AS rule_id, lpad(ord1::VARCHAR, 12, '0') AS o FROM ({V.FINDINGS}))
SELECT rule_id, min(o) AS first_seen, coalesce({_case(R.CWE_NAMES, 'rule_id')}, 'Security finding') AS name FROM f GROUP BY rule_id"""
)
def sarif_rules(spark, sf):
    return report.sarif_rules(V.findings(spark, sf).withColumn("o", F.lpad(F.col("ord1").cast("string"), 12, "0")), "o")


_RULE = "coalesce(nullif(trim(upper(cwe)), ''), 'CWE-unknown')"
_LEVEL = "CASE WHEN confidence >= 7 THEN 'error' WHEN confidence >= 4 THEN 'warning' ELSE 'note' END"


@query(
    f"""SELECT id, {_RULE} AS rule_id, {_LEVEL} AS level, '{{"ruleId":"' || {_RULE} || '","level":"' || {_LEVEL} || '","message":{{"text":"' || title || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file || '"}},"region":{{"startLine":' || line_start || '}}}}}}],"partialFingerprints":{{"primary":"' || sha1({_RULE} || '|' || file || '|' || line_start) || '"}},"properties":{{"severity":"' || CASE WHEN confidence >= 9 THEN 'Critical' WHEN confidence >= 7 THEN 'High' WHEN confidence >= 4 THEN 'Medium' WHEN confidence > 0 THEN 'Low' ELSE 'Info' END || '","confidence":' || confidence || '}}}}' AS result
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(file), trim(upper(cwe)), CASE WHEN line_start > 0 THEN line_start // 5 ELSE 0 END ORDER BY confidence DESC, ord1, ord2, ord3, ord4, ord5) AS rn FROM ({V.FINDINGS}) WHERE ({_REASON}) IS NULL) WHERE rn = 1)"""
)
def sarif_results(spark, sf):
    kept = dedup.deduped(gates.gated(V.findings(spark, sf)).where("dropped_reason IS NULL").drop("dropped_reason"), ORDER)
    found = report.sarif_results(kept.withColumn("severity", scoring.severity(F.col("confidence"))))
    return found


@query(
    f"""SELECT id, ord1, ord2, ord3, ord4, ord5, unnest(list_filter([CASE WHEN NOT coalesce(trim(cwe) <> '', false) THEN 'cwe' END, CASE WHEN NOT coalesce(line_start > 5, false) THEN 'line_start' END, CASE WHEN NOT coalesce(sink_ref <> '', false) THEN 'sink_ref' END], lambda x: x IS NOT NULL)) AS rule FROM ({V.FINDINGS})"""
)
def validate_rows(spark, sf):
    rules = {"cwe": F.trim("cwe") != "", "line_start": F.col("line_start") > 5, "sink_ref": F.col("sink_ref") != ""}
    return gates.violations(V.findings(spark, sf), ["id", *ORDER], rules)


@query("SELECT source, count(DISTINCT lang) AS n_values FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def fd_check(spark, sf):
    return gates.broken_dependency(V.read(spark, sf, "documents"), "source", "lang")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark, sf):
    return gates.repeated_keys(V.read(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT event_id, json_extract_string(props, '$.' || (json_keys(props))[1]) AS first_value, json_type(props) AS kind, len(json_keys(props)) AS n_keys FROM events")
def json_navigate(spark, sf):
    events = V.read(spark, sf, "events").select("event_id", "props", F.json_object_keys("props").alias("ks"))
    return events.select("event_id", F.element_at(F.from_json("props", "map<string,string>"), F.get("ks", F.lit(0))).alias("first_value"), F.regexp_extract(F.schema_of_variant(F.try_parse_json("props")), "^([A-Z]+)", 1).alias("kind"), F.size("ks").alias("n_keys"))


_GAPS = f"SELECT CASE trim(upper(cwe)) WHEN 'CWE-79' THEN 'injection' WHEN 'CWE-89' THEN 'injection' WHEN 'CWE-22' THEN 'integrity' WHEN 'CWE-862' THEN 'horizontal-authz' ELSE '' END AS dimension, file AS control, confidence >= 0.5 AS confirmed FROM ({V.FINDINGS})"


@query(
    f"""SELECT coalesce(nullif(dimension, ''), 'other') AS dimension, count(*) AS n_gaps, count(*) FILTER (WHERE confirmed) AS n_confirmed, count(*) FILTER (WHERE NOT confirmed) AS n_residual,
count(DISTINCT control) AS n_controls, CASE WHEN dimension = '' THEN '1other' ELSE '0' || dimension END AS place FROM ({_GAPS}) GROUP BY dimension"""
)
def gap_report(spark, sf):
    table = {"CWE-79": "injection", "CWE-89": "injection", "CWE-22": "integrity", "CWE-862": "horizontal-authz"}
    gaps = V.findings(spark, sf).select(F.coalesce(R.mapped(table, F.trim(F.upper("cwe"))), F.lit("")).alias("dimension"), F.col("file").alias("control"), (F.col("confidence") >= 0.5).alias("confirmed"))
    return report.gap_rollup(gaps)


@query("SELECT count(*) AS n_unconfirmed FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unconfirmed_count(spark, sf):
    asked = V.read(spark, sf, "documents").select(F.col("doc_id").alias("fact_key"))
    return report.unconfirmed(asked, V.read(spark, sf, "labels").select(F.col("doc_id").alias("fact_key")))


@query(
    f"""SELECT doc_id, source || '-' || lang AS base, CASE WHEN n = 1 THEN source || '-' || lang ELSE source || '-' || lang || '-' || n END AS unit_id
FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)"""
)
def unit_ids(spark, sf):
    docs = V.read(spark, sf, "documents").select("doc_id", F.concat_ws("-", "source", "lang").alias("base"))
    return dedup.suffixed_ids(docs, "base", ["doc_id"]).select("doc_id", "base", "unit_id")


_BEGIN, _END = "Licensed under", "Version 2.0."


@query(
    f"""SELECT doc_id, sha256(CASE WHEN a > 0 AND b > 0 THEN left(text, a - 1) || substr(text, a + b + {len(_END)} - 1) ELSE text END) AS outside_sha
FROM (SELECT *, instr(text, '{_BEGIN}') AS a, instr(substr(text, instr(text, '{_BEGIN}')), '{_END}') AS b FROM documents)"""
)
def outside_block(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", F.sha2(report.outside_block(F.col("text"), _BEGIN, _END), 256).alias("outside_sha"))


@query(f"SELECT doc_id, category, pat_ord, pos, token FROM ({HITS})")
def incremental_scan(spark, sf):
    """The scan as a stream that takes what is there and stops: equal to the batch scan."""
    from ..sources.staging import scratch_path
    from ..streaming.incremental import scan_new_files

    out = scratch_path(spark, "incremental")
    scan_new_files(spark, _folder(spark, sf), f"{out}/hits", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/hits").select("doc_id", "category", "pat_ord", "pos", "token")


def _folder(spark, sf: str) -> str:
    """A pattern, since a stream's own path must be a folder and the table may be one file."""
    return f"{sf}/documents.parquet*"


from . import audits, checks, structure, workflow  # noqa: E402, F401  add their queries to QUERIES
