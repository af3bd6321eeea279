"""The driver's tables in the shapes the operators take, for Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan, spans

FINDINGS = """SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id,
       l_orderkey AS ord1, l_linenumber AS ord2, l_partkey AS ord3, l_suppkey AS ord4, l_extendedprice AS ord5,
       'src/' || CASE WHEN l_suppkey % 10 = 0 THEN 'test/' ELSE 'main/' END
              || 'F' || CAST(l_partkey % 997 AS STRING) || '.java' AS file,
       CASE l_suppkey % 5 WHEN 0 THEN 'CWE-79' WHEN 1 THEN 'cwe-89' WHEN 2 THEN 'CWE-22 '
                          WHEN 3 THEN 'CWE-862' ELSE '' END AS cwe,
       CAST(l_quantity AS INT) AS line_start,
       'issue ' || l_returnflag || ' ' || l_linestatus || ' part ' || CAST(l_partkey % 13 AS STRING) AS title,
       abs(l_discount) * 10 AS confidence,
       CASE WHEN l_linenumber % 7 = 0 THEN '' WHEN l_linenumber % 5 = 0 THEN 'src/main/In.java'
            ELSE 'src/main/In.java:' || CAST(l_linenumber AS STRING) END AS source_ref,
       CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE 'src/main/Out.java:' || CAST(l_partkey % 50 AS STRING) END AS sink_ref
FROM lineitem"""
VECTORS = """SELECT p_partkey AS id,
       'CVSS:3.1/AV:' || CASE p_partkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'A' WHEN 2 THEN 'L' ELSE 'P' END
       || '/AC:' || CASE p_size % 2 WHEN 0 THEN 'L' ELSE 'H' END
       || '/PR:' || CASE p_partkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'L' ELSE 'H' END
       || CASE WHEN p_partkey % 17 = 0 THEN '' ELSE '/UI:' || CASE p_size % 3 WHEN 0 THEN 'R' ELSE 'N' END END
       || '/S:' || CASE p_size % 5 WHEN 0 THEN 'C' ELSE 'U' END
       || '/C:' || CASE p_partkey % 5 WHEN 0 THEN 'N' WHEN 1 THEN 'L' ELSE 'H' END
       || '/I:' || CASE p_partkey % 7 WHEN 0 THEN 'N' WHEN 1 THEN 'L' ELSE 'H' END
       || '/A:' || CASE p_partkey % 2 WHEN 0 THEN 'N' ELSE 'H' END AS cvss_vector
FROM part"""
#: Orders point to customers and those to nations: sparse, three layers deep, and far from connected within a few steps.
EDGES = """SELECT 'o' || CAST(o_orderkey AS STRING) AS caller, 'c' || CAST(o_custkey AS STRING) AS callee FROM orders
UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'n' || CAST(c_nationkey AS STRING) FROM customer"""
#: Suppliers point to the parts they deliver: dense, every key as it stands.
ALL_EDGES = "SELECT DISTINCT 's' || CAST(l_suppkey AS STRING) AS caller, 'p' || CAST(l_partkey AS STRING) AS callee FROM lineitem"
#: Test-like files: two signals each, a path and some assertions.
SIGNALS = ("WebMvcTest", "SpringBootTest MockMvc", "SpringBootTest LocalServerPort", "DataJpaTest", "Testcontainers", "TestConfiguration", "InjectMocks", "mockStatic", "ParameterizedTest", "assertThat", "Clock", "WebFluxTest", "nothing")
TESTS = """SELECT p_partkey AS id, '@' || SIGNAL || ' class P @Test void a() assertThat(x).isEqualTo(1); ' || CASE WHEN p_size % 3 = 0 THEN 'assertTrue(y);' ELSE '' END AS text,
       'src/t/' || CASE p_size % 5 WHEN 0 THEN 'service' WHEN 1 THEN 'dao' ELSE 'x' END || '/P' || CAST(p_partkey AS STRING) || CASE p_size % 7 WHEN 0 THEN 'UtilTest' ELSE 'Test' END AS path
FROM part""".replace("SIGNAL", "CASE p_partkey % 13 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(SIGNALS)) + " END")
UNITS = """SELECT o_orderkey AS unit, o_orderpriority AS tier,
       CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'pending' END AS state FROM orders"""
LINES = """SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no
FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", "FROM {source}"), source=read(spark, sf_dir, table))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, FINDINGS, "lineitem")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, VECTORS, "part")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    ordered = read(spark, sf_dir, "orders").select(named("o", "o_orderkey").alias("caller"), named("c", "o_custkey").alias("callee"))
    return ordered.unionAll(read(spark, sf_dir, "customer").select(named("c", "c_custkey"), named("n", "c_nationkey")))


def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ALL_EDGES, "lineitem")


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, TESTS, "part")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, UNITS, "orders")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.lines_of(read(spark, sf_dir, "documents"), "doc_id")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.pattern_hits(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def hits_sql() -> str:
    """v_hits for DuckDB: each pattern as a branch."""
    from ..functions import registry as R

    def branch(row: tuple) -> str:
        category, i, j, pattern, shape, confidence = row
        return (
            f"SELECT doc_id, '{category}' AS category, {i} AS cat_ord, {j} AS pat_ord, '{shape}' AS shape, {confidence}::DOUBLE AS confidence, "
            f"generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS token FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m FROM documents)"
        )

    return " UNION ALL ".join(branch(r) for r in R.pattern_rows())


#: A capitalised ASCII word at the head of a line is a definition; all of them are calls.
HEAD = r"^([A-Z][A-Za-z]{2,})"
WORD = r"[A-Z][A-Za-z]{2,}"


def defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", F.regexp_extract("line", HEAD, 1).alias("name")).where("name <> ''").distinct()


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("name"))


DEFS = f"SELECT DISTINCT doc_id, regexp_extract(line, '{HEAD}', 1) AS name FROM ({LINES}) WHERE regexp_extract(line, '{HEAD}', 1) <> ''"
CALLS = f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{WORD}')) AS name FROM documents"
