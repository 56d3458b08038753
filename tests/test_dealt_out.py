"""Explorations compare triples in tasks of bounded size, whatever one file holds."""

import duckdb

from weftline import queries
from weftline.operators import explore as E
from weftline.operators import graphs as G
from weftline.operators import storage

DATA = "/root/testdata/sf0.001"


def test_no_task_holds_all_triples_of_a_file(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 100, raising=False)
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return storage.cut(df)

    monkeypatch.setattr(E, "cut", noted)
    got = queries.QUERIES["explore_customers"](spark, DATA)
    read = plans[0].rsplit("Exchange", 1)[1]  # what is done as the table is read
    assert "customer" in read and "Aggregate" not in read
    # a hundred or so triples a part: five for each of 150 customers
    assert "REPARTITION_BY_NUM" in plans[0] and ", 8), REPARTITION_BY_NUM" in plans[0]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS FROM '{DATA}/customer.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['explore_customers']})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 100


def test_a_set_needs_no_second_comparison(spark):
    rows = [("g", "iri", f"urn:s:{i % 7}", "urn:p", "lit", str(i), "", "") for i in range(30)] + [("h", "iri", "urn:s:1", "urn:p", "iri", "urn:o", "", "")]
    triples = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in G.KEY))
    assert sorted(G.fingerprints(triples, False, sets=True).collect()) == sorted(G.fingerprints(triples.unionByName(triples), False).collect())
