"""Every query of the library's own operators against its SQL, on the smallest tables."""

import re
from collections import Counter

import pytest
from compare import difference, duck

from tessera.plans import views as V
from tessera.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ours = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert difference(ours, con.execute(ORACLES[name]).df()) == ""
    else:
        assert len(ours) > 0


def test_graph_queries_over_all_names_and_edges(spark):
    # plain Python over the whole table, so that no filter shared by a query and its SQL hides
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    heads = {(m[1], r.doc_id) for r in docs for line in r.text.split("\n") if (m := re.match("([A-Z][A-Za-z]{2,})", line))}
    definers, weights = {}, Counter()
    for name, doc in heads:
        definers.setdefault(name, []).append(doc)
    for r in docs:
        for name in set(re.findall("[A-Z][A-Za-z]{2,}", r.text)):
            weights.update((r.doc_id, d) for d in definers.get(name, ()) if d != r.doc_id)
    assert {(r.caller, r.callee): r.weight for r in QUERIES["call_edges"](spark, SF).collect()} == weights
    assert sum(r.n_pairs for r in QUERIES["call_edges_all_names"](spark, SF).collect()) == sum(weights.values())
    received = Counter()
    for (_, callee), n in weights.items():
        received[callee] += n
    assert {r.node: r.calls for r in QUERIES["fan_in_all_names"](spark, SF).collect()} == {r.doc_id: received[r.doc_id] for r in docs}
    called = Counter(callee for _, callee in weights)
    assert {r.node: r.fan_in for r in QUERIES["fan_in"](spark, SF).collect()} == {r.doc_id: called[r.doc_id] for r in docs}
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey").collect()
    want = {(f"s{r.l_suppkey}", f"p{r.l_partkey}") for r in lines}
    assert {(r.caller, r.callee) for r in V.all_edges(spark, SF).collect()} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["severity", "n", "n_folded"]
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
