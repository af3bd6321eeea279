"""Queries of run states, worklists and managed blocks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, runs
from . import views as V
from .queries import query

# ---------------------------------------------------------------- worklists

_MARKERS = """SELECT 'g' || c_custkey AS unit, CASE WHEN c_mktsegment = 'BUILDING' THEN 'done' ELSE 'failed' END AS state FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0
UNION ALL SELECT 'o' || o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'failed' END FROM orders WHERE o_orderstatus IN ('F', 'P')"""
_PENDING = f"SELECT 'g' || o_custkey AS g, 'o' || o_orderkey AS u, o_totalprice FROM orders WHERE 'g' || o_custkey NOT IN (SELECT unit FROM ({_MARKERS})) AND 'o' || o_orderkey NOT IN (SELECT unit FROM ({_MARKERS}))"


def _worklist(spark, sf):
    named = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    customers, orders = V.read(spark, sf, "customer"), V.read(spark, sf, "orders")
    of_groups = customers.where("c_mktsegment = 'BUILDING' OR c_acctbal < 0").select(named("g", "c_custkey").alias("unit"), F.when(F.col("c_mktsegment") == "BUILDING", "done").otherwise("failed").alias("state"))
    of_units = orders.where("o_orderstatus IN ('F', 'P')").select(named("o", "o_orderkey").alias("unit"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("failed").alias("state"))
    markers = of_groups.unionByName(of_units)
    units = orders.select(named("g", "o_custkey").alias("g"), named("o", "o_orderkey").alias("u"), "o_totalprice")
    return customers.select(named("g", "c_custkey").alias("g")), runs.pending_units(units, "g", "u", markers), markers


@query(
    f"""WITH m AS ({_MARKERS}), p AS (SELECT g, count(*) AS n FROM ({_PENDING}) GROUP BY 1), s AS (SELECT 'g' || c_custkey AS g FROM customer),
c AS (SELECT count(*) AS total, count(*) FILTER (WHERE g IN (SELECT unit FROM m WHERE state = 'failed') AND g NOT IN (SELECT unit FROM m WHERE state = 'done')) AS failed, count(n) AS pending, coalesce(sum(n), 0)::BIGINT AS pending_units FROM s LEFT JOIN p USING (g))
SELECT total, total - failed - pending AS done, failed, pending, pending_units FROM c"""
)
def worklist_totals(spark, sf):
    groups, pending, markers = _worklist(spark, sf)
    return runs.group_totals(groups, "g", pending, markers)


@query(
    f"""WITH p AS (SELECT u, length(u) * 400 AS size, row_number() OVER (ORDER BY o_totalprice, u) AS n FROM ({_PENDING})), w AS (SELECT *, row_number() OVER (ORDER BY n) AS k, sum(size) OVER (ORDER BY n) + 2 + 2 * (row_number() OVER (ORDER BY n) - 1) AS b FROM p WHERE n > 20 AND n <= 220)
SELECT 20 AS offset, 200 AS limit, count(*) FILTER (WHERE b <= 65536 OR k = 1) AS effective_limit, count(*) FILTER (WHERE b <= 65536 OR k = 1) < count(*) AS shrunk FROM w""".replace("AS offset", 'AS "offset"').replace("AS limit", 'AS "limit"')
)
def worklist_page(spark, sf):
    _, pending, _ = _worklist(spark, sf)
    return runs.pending_page(pending.withColumn("size", F.length("u") * 400), ["o_totalprice", "u"], "size", 20, 200, 65536)[1]


# ---------------------------------------------------------------- run states

#: Artifacts of a run by its customer's columns, in the order of the stages.
_ARTIFACTS = {
    "candidates": "c_custkey % 11 <> 0", "clusters": "c_custkey % 13 <> 0", "scan_progress": "c_custkey % 2 = 0", "scout_plan": "c_custkey % 5 <> 0", "scout_candidates": "c_nationkey % 3 <> 0", "scout_merge": "c_nationkey % 4 <> 0",
    "scout_merged": "c_nationkey % 5 <> 0", "t2_done": "c_acctbal > -500", "inventory": "c_acctbal > 500", "t4_done": "c_acctbal > 3000", "manifest": "c_acctbal > 6000",
}
_RUNS = "SELECT c_custkey AS run, CASE WHEN c_custkey % 19 = 0 THEN 'merge' ELSE 'normal' END AS mode, c_custkey % 3 = 0 AS no_scout, c_custkey % 7 = 0 AS skip_consistency, * FROM customer"
_SPLIT = "CASE WHEN o_orderkey % 9 = 0 THEN 'scout' WHEN o_orderkey % 9 < 7 THEN 't1' ELSE 't3' END"


@query(
    f"""WITH u AS (SELECT o_custkey AS run, {_SPLIT} AS tier, count(*) AS total, count(*) FILTER (WHERE o_orderstatus <> 'O' OR o_orderkey % 4 > 0) AS terminal FROM orders GROUP BY ALL),
r AS (SELECT r.*, {", ".join(f"{cond} AS has_{name}" for name, cond in _ARTIFACTS.items())}, {", ".join(f"coalesce((SELECT total FROM u WHERE u.run = r.run AND tier = '{t}'), 0) AS n_{t}, coalesce((SELECT terminal < total FROM u WHERE u.run = r.run AND tier = '{t}'), false) AS p_{t}" for t in ("scout", "t1", "t3"))} FROM ({_RUNS}) r)
SELECT run, CASE WHEN mode = 'merge' THEN 'merge: merge partial inventories' WHEN NOT (has_candidates AND has_clusters) AND has_scan_progress THEN 'discover: resume the scan' WHEN NOT (has_candidates AND has_clusters) THEN 'discover: scan'
WHEN NOT no_scout AND NOT has_scout_plan THEN 'scout: plan batches' WHEN NOT no_scout AND p_scout THEN 'scout: read batches' WHEN NOT no_scout AND n_scout > 0 AND NOT (has_scout_candidates AND has_scout_merge) THEN 'scout: merge batches'
WHEN NOT no_scout AND n_scout > 0 AND NOT has_scout_merged THEN 'scout: fold in' WHEN p_t1 THEN 't1: read clusters' WHEN NOT has_t2_done OR NOT has_inventory THEN 't2: synthesise' WHEN p_t3 THEN 't3: write rules'
WHEN NOT skip_consistency AND NOT has_t4_done THEN 'assemble: assemble rules' WHEN has_manifest THEN 'done: none' ELSE 'done: write the manifest' END AS stage FROM r"""
)
def resume_cases(spark, sf):
    """The stage of every customer's run, whose units are the orders."""
    held = V._view(spark, sf, _RUNS, "customer")
    artifacts = held.select("run", F.explode(F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in _ARTIFACTS.items()]))).alias("name"))
    units = V.read(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.expr(_SPLIT).alias("tier"), F.col("o_orderkey").alias("unit"), "o_orderstatus")
    totals = units.groupBy("run", "tier").agg(F.count(F.lit(1)).alias("total"))
    state = F.when(F.col("o_orderstatus") == "P", "failed").otherwise("done")
    markers = units.where("o_orderstatus <> 'O' OR unit % 4 > 0").withColumn("state", state)
    facts = runs.run_facts(held.select("run", "mode", "no_scout", "skip_consistency"), artifacts, totals, markers)
    return runs.resume(facts, runs.control_stages()).select("run", F.concat_ws(": ", "step", "action").alias("stage"))


# ---------------------------------------------------------------- managed blocks

_BEGIN, _END = "<!-- block -->", "<!-- /block -->"


def _drafts(spark, sf):
    """A draft for each customer: its segment as dimension, two requirements, and tasks."""
    c = V.read(spark, sf, "customer")
    req = lambda head, body: F.struct(head.alias("heading"), body.alias("body"))
    draft = F.struct(
        F.col("c_name").alias("capability"),
        F.array(F.struct(F.lower("c_mktsegment").alias("dimension")), F.struct(F.lit("audit").alias("dimension")), F.struct(F.lit("").alias("dimension"))).alias("gaps"),
        F.array(req(F.concat(F.lit(" Keep "), "c_name"), F.lit(" first\nsecond ")), req(F.lit(None).cast("string"), F.lit(""))).alias("security_requirements"),
        F.array(F.concat(F.lit(" check "), "c_name"), F.lit("  "), F.concat(F.lit("- see "), "c_mktsegment")).alias("security_tasks"),
    )
    return blocks.parsed_drafts(c.select("c_custkey", "c_nationkey", "c_name", F.to_json(draft).alias("text")))


_NL = "chr(10)"


@query(
    f"""SELECT c_custkey, sha256('# ' || c_name || {_NL} || {_NL} || '## ADDED Requirements' || {_NL} || {_NL} || '{_BEGIN}' || {_NL} || '<!-- dimensions: ' || array_to_string(list_sort(['audit', lower(c_mktsegment)]), ', ') || ' -->' || {_NL} || {_NL}
|| '### Requirement: Keep ' || c_name || {_NL} || 'first' || {_NL} || 'second' || {_NL} || {_NL} || '### Requirement: Security requirement' || {_NL} || '{_END}' || {_NL} || 'end') AS sha FROM customer"""
)
def requirement_blocks(spark, sf):
    """Blocks of requirements, placed twice into the customers' texts."""
    own = _drafts(spark, sf)
    block = blocks.requirements_block(F.col("draft"), _BEGIN, _END)
    text = F.concat(F.lit("# "), "c_name", F.lit("\n\n## ADDED Requirements\n\nend"))
    once = own.select("c_custkey", block.alias("b"), blocks.placed(text, block, _BEGIN, _END, blocks.SECTION).alias("t"))
    return once.select("c_custkey", F.sha2(blocks.placed(F.col("t"), F.col("b"), _BEGIN, _END, blocks.SECTION), 256).alias("sha"))


@query(
    f"""SELECT c_nationkey, 2 * count(*) AS n_tasks, sha256('{_BEGIN}' || {_NL} || string_agg('- check ' || c_name || {_NL} || '- see ' || c_mktsegment, {_NL} ORDER BY c_custkey) || {_NL} || '{_END}' || {_NL}) AS sha FROM customer GROUP BY 1"""
)
def task_blocks(spark, sf):
    found = blocks.tasks_blocks(_drafts(spark, sf), "c_nationkey", "c_custkey", _BEGIN, _END)
    return found.select("c_nationkey", "n_tasks", F.sha2("block", 256).alias("sha"))
