"""Parsing, graph operators and settings, and a few registered queries against their SQL."""

import itertools
import os
import random

import pytest

import __spark_entry__ as entry
from weftline.functions.terms import BNODE, IRI, LITERAL, TRIPLE
from weftline.model import DEFAULTS, Group, Settings, label
from weftline.operators import graphs as G
from weftline.operators.prune import prune
from weftline.queries import QUERIES
from weftline.sources import rdf, turtle

DATA = "/root/testdata/sf0.001"
KEY = "graph_id string, " + ", ".join(f"{c} string" for c in TRIPLE)


def frame(spark, rows):
    return spark.createDataFrame(rows, KEY)


def test_turtle_forms():
    rows = turtle.parse("""@prefix a: <urn:a:> .
        a:s a a:C ; a:p "x"@en , 'y' , 1 , true ; .
        @prefix b: <urn:b:> .
        b:s a:q [ a:r "\\u00e9" ] ; a:l ( a:one "two" ) .""")
    assert ("iri", "urn:a:s", "urn:a:p", "lit", "x", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "en")[:5] in [r[:5] for r in rows]
    assert any(r[3] == LITERAL and r[4] == "é" for r in rows) and any(r[3] == LITERAL and r[4] == "two" for r in rows)
    assert sum(r[0] == BNODE for r in rows) == 5 and all(r[0] in (IRI, BNODE) for r in rows)


@pytest.mark.parametrize("bad", ["<urn:s> <urn:p> .", "x:s <urn:p> <urn:o> .", "<urn:s> <urn:p> <urn:o>", '<urn:s> <urn:p> "open .'])
def test_turtle_errors(bad):
    with pytest.raises(turtle.RdfError):
        turtle.parse(bad)


def test_ntriples_round_trip(spark):
    rows = [("g", IRI, "urn:s", "urn:p", LITERAL, 'a "quoted" \\ line\nbreak\té', "", ""), ("g", BNODE, "x", "urn:p", LITERAL, "t", "", "cs"), ("g", IRI, "urn:s", "urn:p", BNODE, "x", "", "")]
    back = rdf.ntriples_rows(rdf.lines(frame(spark, rows)).withColumnRenamed("line", "value"))
    assert {tuple(r[c] for c in TRIPLE[:5]) for r in back.collect()} == {r[1:6] for r in rows}


def test_update_sees_the_state_before(spark):
    rows = [(g, IRI, "urn:s", "urn:p", LITERAL, v, "", "") for g, v in (("1", "a"), ("1", "b"), ("2", "c"))]
    got = G.update(frame(spark, rows), "DELETE { ?s <urn:p> ?o } INSERT { ?s <urn:q> ?o } WHERE { ?s <urn:p> ?o }").collect()
    assert {(r.graph_id, r.p, r.o) for r in got} == {("1", "urn:q", "a"), ("1", "urn:q", "b"), ("2", "urn:q", "c")}


def test_isomorphism_classes_agree_with_all_mappings(spark):
    rng = random.Random(4)
    graphs = {}
    for i in range(8):
        nodes = [f"n{j}" for j in range(4)]
        graphs[f"g{i}"] = {(BNODE, rng.choice(nodes), "urn:p", BNODE, rng.choice(nodes), "", "") for _ in range(3)}
    for i in range(8):
        to = dict(zip([f"n{j}" for j in range(4)], rng.sample(["a", "b", "c", "d"], 4), strict=True))
        graphs[f"h{i}"] = {(r[0], to[r[1]], r[2], r[3], to[r[4]], "", "") for r in graphs[f"g{i}"]}
    got = {r.graph_id: r.cls for r in G.isomorphism_classes(frame(spark, [(k, *r) for k, v in graphs.items() for r in v])).collect()}
    assert got.keys() == graphs.keys()
    for a, b in itertools.combinations(graphs, 2):
        assert (got[a] == got[b]) == G.isomorphic(sorted(graphs[a]), sorted(graphs[b]))


def test_strong_groups(spark):
    groups = [Group.of("urn:g", ["urn:t1", "urn:t2"]), Group.of("urn:h", ["urn:t3", "urn:t4"])]
    rows = [("r", "p", "urn:t1", t, i) for i, t in enumerate(["urn:t1", "urn:t2", "urn:t3", "urn:x"])] + [("r", "q", None, t, i) for i, t in enumerate(["urn:t2", "urn:t1", "urn:t3", "urn:x"])]
    got = {(r.parent_id, r.transformer): r.pruned for r in prune(spark.createDataFrame(rows, "run_id string, parent_id string, parent_transformer string, transformer string, transformer_idx int"), groups).collect()}
    assert [t for (p, t), pruned in got.items() if p == "p" and not pruned] == ["urn:t1"]
    assert sorted(t for (p, t), pruned in got.items() if p == "q" and not pruned) == ["urn:t1", "urn:t3", "urn:x"]


def test_labels_and_settings():
    assert label({"en": "a", "cs": "b"}) == "b" and label({"fr": "c", "de": "d"}) == "d" and label({}) == ""
    merged = Settings(output="/o", level_limit=0).merged(Settings(output="/p", filter="none")).merged(DEFAULTS)
    assert (merged.output, merged.level_limit, merged.filter) == ("/o", 0, "none")


def value(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["bgp_star", "optional_filter_lang", "minus", "filter_not_exists", "sub_select", "path_sequence", "update_unbound_skip", "diff_size", "graph_fingerprint", "dictionary_encode"])
def test_queries_agree_with_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert sorted(tuple(value(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(value(r[i]) for i in place) for r in want.fetchall())
