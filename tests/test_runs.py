"""Definitions, explorations, resumed runs, exports, experiments and the command line, from newly written documents."""

import json

import pytest
from pyspark.sql import functions as F

from weftline import cli
from weftline.model import DEFAULTS, Dataset, Settings, Vocabulary, application, transformer
from weftline.operators import explore as E
from weftline.operators.export import load_statistics
from weftline.operators.storage import SampleStore
from weftline.sources import turtle
from weftline.sources.definitions import Document, dataset_from_directory, load_definition, load_experiment
from weftline.sources.rdf import UrlCache
from weftline.streaming import match_stream, stream_ntriples

P = "PREFIX ex: <http://example.org/p#> "
NAME = transformer("http://example.org/t/name", P + "ASK { ?s ex:name ?n }", P + "DELETE { ?s ex:name ?n } INSERT { ?s ex:label ?n } WHERE { ?s ex:name ?n }", "Name")
PLACE = transformer(
    "http://example.org/t/place",
    P + "ASK { ?s ex:north ?a ; ex:east ?b }",
    P + 'DELETE { ?s ex:north ?a ; ex:east ?b } INSERT { ?s ex:at ?g . ?g ex:y ?a ; ex:x ?b ; ex:called ?t } WHERE { ?s ex:north ?a ; ex:east ?b BIND(IRI(CONCAT(STR(?s), "/at")) AS ?g) OPTIONAL { ?s ex:label ?t FILTER(LANG(?t) = "en") } }',
    "Place",
)
PLAIN = '@prefix ex: <http://example.org/p#> . <http://example.org/thing> ex:name "" ; ex:north "" ; ex:east "" ; .'
TAGGED = '@prefix ex: <http://example.org/p#> . <http://example.org/other> ex:name "A thing"@en ; ex:north "1" ; ex:east "2" .'


def counts(nodes):
    rows = nodes.groupBy("run_id").agg(F.count_if("expanded").alias("expanded"), F.count_if("redundant").alias("redundant"), F.count_if(~F.col("redundant")).alias("kept")).collect()
    return {r.run_id: (r.expanded, r.redundant) for r in rows}


def roots(spark, *texts):
    return E.root_graphs(spark, [Dataset(f"http://example.org/d{i}", rows=tuple(turtle.parse(x))) for i, x in enumerate(texts)])


def test_two_orders_of_two_rules_meet_unless_the_order_shows(spark):
    done = E.explore(roots(spark, PLAIN, TAGGED), [], [NAME, PLACE])
    assert counts(done.nodes) == {"000": (5, 1), "001": (5, 0)} and done.reason == "done"
    assert {r.node_id for r in done.nodes.where("redundant").collect()} == {"1_2"}
    assert set(done.timers) == {"update", "filter", "ask-applications", "store", "ask-transformers"}


def test_applications_of_a_root_and_of_its_child(spark):
    sample = '@prefix ex: <http://example.org/p#> . <http://example.org/set> ex:title "Jména"@cs ; ex:issued "2020-01-01" ; ex:keyword "a"@cs , "b"@cs .'
    titled = application("http://example.org/a/titled", P + "ASK { [] ex:title [] }")
    dated = application("http://example.org/a/dated", P + "ASK { ?thing ex:date ?date }")
    date = transformer("http://example.org/t/date", P + "ASK { ?s ex:issued ?d }", P + "DELETE { ?s ex:issued ?d } INSERT { ?s ex:date ?d } WHERE { ?s ex:issued ?d }")
    nodes = {r.node_id: r for r in E.explore(roots(spark, sample), [titled, dated], [date]).nodes.collect()}
    assert {k: [x.rsplit("/", 1)[1] for x in r.applications] for k, r in nodes.items()} == {"root": ["titled"], "0_1": ["titled", "dated"]}


def test_limits_end_a_run(spark):
    class Counting(E.Listener):
        calls: list = []

        def nodes_will_expand(self, level, nodes):
            self.calls.append(("will", level, nodes.count()))

        def nodes_did_expand(self, level, nodes):
            self.calls.append(("did", level, nodes.count()))

        def clean_up(self):
            self.calls.append(("clean", 0, 0))

    hooks = Counting()
    result = E.explore(roots(spark, PLAIN), [], [NAME, PLACE], listeners=[E.NodeTimeLimit(0), hooks], blank=False)
    assert result.reason == "node-time-limit" and result.nodes.where("level > 1 and expanded").count() == 0
    assert hooks.calls == [("will", 1, 2), ("did", 1, 2), ("clean", 0, 0)]


@pytest.mark.parametrize("kind", ["memory", "disk", "memory-disk", "files"])
def test_stores_hold_the_same(spark, kind):
    store = SampleStore(spark, kind)
    rows = roots(spark, PLAIN, TAGGED).withColumnRenamed("run_id", "graph_id")
    store.add(rows, "ROOT")
    store.add(rows.where("graph_id = '001'").withColumn("graph_id", F.lit("x")), "NODE")
    assert {(r.grp, r.graph_id): r.n for r in store.sizes().collect()} == {("ROOT", "000"): 3, ("ROOT", "001"): 3, ("NODE", "x"): 3}
    assert store.load("x").count() == 3
    store.remove_all("ROOT")
    assert store.sizes().count() == 1
    with pytest.raises(ValueError):
        SampleStore(spark, "tape")


TERMS = {
    "dataset": "Dataset", "application": "Application", "transformer": "Transformer", "input": "Input", "has_template": "template", "imports": "include", "has_group": "group",
    "has_transformer": "member", "has_definition": "part", "sample": "sample", "configuration": "configuration", "input_port": "in", "output_port": "out", "feature": "feature",
    "executor": "runs", "configuration_query": "setup", "descriptor": "test", "query": "query", "applies_to": "port", "service": "service", "definition": "settings",
    "title": "http://purl.org/dc/terms/title", "description": "http://purl.org/dc/terms/description", "endpoint": "endpoint",
}


@pytest.fixture(scope="module")
def documents(tmp_path_factory):
    """A vocabulary file, a definition that imports another, its templates, and an experiment; as paths."""
    at = tmp_path_factory.mktemp("definitions")
    url = lambda name: (at / name).as_uri()
    head = "@prefix v: <http://example.org/v#> . @prefix d: <http://purl.org/dc/terms/> .\n"
    (at / "vocabulary.json").write_text(json.dumps({"base": "http://example.org/v#", "terms": TERMS, "settings": {"level_limit": "levels", "filter": "filter", "use_strong_groups": "strong"}}))
    for name, text in (("plain", PLAIN), ("tagged", TAGGED)):
        (at / f"{name}-sample.ttl").write_text(text)
        (at / f"{name}.ttl").write_text(head + f'<{url(name + ".ttl")}> a v:Dataset ; d:title "{name}"@en ; v:out [ v:sample <{url(name + "-sample.ttl")}> ] ; v:configuration [ d:title "c" ; v:service [ v:endpoint <http://example.org/sparql> ] ] .')
    for x in (NAME, PLACE):
        file = x.label.lower() + ".ttl"
        text = f'<{url(file)}> a v:Transformer ; d:title "{x.label}"@en , "Jinak"@cs ; v:configuration [ v:query """{x.rule}""" ] ; v:in [ d:title "p" ] ; v:feature [ v:test [ v:query """{x.guards[0]}""" ] ] .'
        (at / file).write_text(head + text)
    (at / "labels.ttl").write_text(head + f'<{url("labels.ttl")}> a v:Application ; d:title "Labels"@en ; v:runs <http://example.org/run> ; v:feature [ v:test [ v:query """{P}ASK {{ ?s ex:label ?l }}""" ; v:port <http://example.org/port> ] ] .')
    (at / "odd.ttl").write_text(head + f'<{url("odd.ttl")}> a v:Nothing .')
    (at / "more.ttl").write_text(head + f'<http://example.org/more> a v:Input ; v:template <{url("place.ttl")}> , <{url("tagged.ttl")}> , <{url("odd.ttl")}> ; v:include <{url("main.ttl")}> .')
    (at / "main.ttl").write_text(head + f'<http://example.org/main> a v:Input ; v:include <{url("more.ttl")}> ; v:template <{url("plain.ttl")}> , <{url("name.ttl")}> , <{url("labels.ttl")}> ; v:group <http://example.org/g> ; v:settings [ v:filter "diff" ; v:strong "false" ] . <http://example.org/g> v:member <{url("place.ttl")}> , <{url("name.ttl")}> .')
    (at / "experiment.ttl").write_text(head + f'<http://example.org/e> v:part ( <{url("main.ttl")}> <{url("main.ttl")}> ) .')
    return at


def test_definitions_are_read(documents):
    vocabulary = Vocabulary.read(str(documents / "vocabulary.json"))
    found = load_definition(str(documents / "main.ttl"), vocabulary)
    assert [x.label for x in found.datasets] == ["plain", "tagged"] and [x.label for x in found.transformers] == ["Jinak", "Jinak"]
    assert found.datasets[0].endpoint() == "http://example.org/sparql" and len(found.datasets[0].rows) == 3
    assert found.applications[0].executor == "http://example.org/run" and found.applications[0].features[0].descriptors[0].applies_to.iri == "http://example.org/port"
    assert found.settings == Settings(filter="diff", use_strong_groups=False) and [x.split(": ")[1] for x in found.issues] == ["no known type"]
    assert [x.rsplit("/", 1)[1] for x in found.groups[0].transformers] == ["name.ttl", "place.ttl"]
    assert load_experiment(str(documents / "experiment.ttl"), vocabulary).definitions == [(documents / "main.ttl").as_uri()] * 2
    with pytest.raises(ValueError):
        Vocabulary({"dataset": "x"})
    (documents / "folder").mkdir()
    (documents / "folder" / "sample.ttl").write_text(PLAIN)
    assert len(dataset_from_directory("urn:d", "D", documents / "folder").rows) == 3
    d = Document(turtle.parse("@prefix v: <http://example.org/v#> . v:a a v:C . v:b a v:C . v:a v:l ( v:a 1 ) ."))
    assert [x[1][-1] for x in d.by_class("http://example.org/v#C")] == ["a", "b"]
    assert [x[1] for x in d.items(d.objects("http://example.org/v#a", "http://example.org/v#l")[0])] == ["http://example.org/v#a", "1"]
    with pytest.raises(turtle.RdfError):
        d.one_by_class("http://example.org/v#C")


def test_cache_fetches_once(tmp_path):
    asked = []
    cache = UrlCache(tmp_path, lambda url: asked.append(url) or b"text")
    assert [cache.open("http://x/1"), UrlCache(tmp_path, cache.opener).open("http://x/1"), UrlCache(None, cache.opener).open("http://x/1")] == [b"text"] * 3 and asked == ["http://x/1"] * 2


def test_runs_from_the_command_line(spark, documents, tmp_path):
    vocabulary = Vocabulary.read(str(documents / "vocabulary.json"))
    args = cli.parser().parse_args(["-d", str(documents / "main.ttl"), "-v", "x", "-o", str(tmp_path), "--level-limit", "1", "--store", "disk", "--node-time-limit", "900", "--url-cache", str(tmp_path / "cache")])
    first = cli.settings_from(args)
    assert first == Settings(level_limit=1, output=str(tmp_path), store="disk", node_time_limit_seconds=900, url_cache=str(tmp_path / "cache")) and DEFAULTS.node_time_limit_seconds == -1
    out = cli.run_definition(spark, args.definition, vocabulary, first)
    assert counts(out["nodes"]) == {"000": (3, 0), "001": (3, 0)}
    for _ in range(2):  # goes on, and then finds the finished run
        out = cli.run_definition(spark, args.definition, vocabulary, Settings(output=str(tmp_path), resume=True))
        assert counts(out["nodes"]) == {"000": (5, 1), "001": (5, 0)}
    edges = spark.read.option("header", True).option("escape", "\\").csv(f"{tmp_path}/gephi-edges.csv")
    assert {(r.run_id, r.source, r.target) for r in edges.where("run_id = 1").collect()} == {(1, "root", "0_1"), (1, "root", "0_2"), (1, "0_1", "1_1"), (1, "0_2", "1_2")}
    vertices = spark.read.option("header", True).csv(f"{tmp_path}/gephi-vertices.csv")
    assert {(r.run_id, r.id): r.Labels for r in vertices.collect()}[0, "0_1"] == "1"
    assert sorted(p.name for p in (tmp_path / "pipelines.json").iterdir() if p.is_dir()) == ["run_id=000", "run_id=001"]
    read = {(r.run_id, r.level): r for r in load_statistics(spark, f"{tmp_path}/statistics.json").collect()}
    assert read["001", 2].expanded == 2 and read["001", 2].new_nodes == 2 and read["000", 1].duration > 0
    assert "no known type" in (tmp_path / "builder-report.txt").read_text()
    total = out["total"].first().total_ms
    spent = [r.duration_ms for r in out["runs"].collect()]
    assert len(spent) == 2 and all(x > 0 for x in spent) and total > 0
    # an experiment over the finished run's definition, twice
    made = cli.run_experiment(spark, str(documents / "experiment.ttl"), vocabulary, Settings(output=str(tmp_path / "all"), level_limit=0))
    assert {r.definition for r in made["definition"].collect()} == {(documents / "main.ttl").as_uri()}
    row = made["definition"].first()
    assert (row.datasets, row.applications, row.transformers, row.pipelines) == (2, 1, 2, 0)
    assert (tmp_path / "all" / "definition-dataset.csv").is_dir() and (tmp_path / "all" / "001" / "nodes.json").is_dir()


def test_guards_over_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text('<http://example.org/a> <http://example.org/p#name> "x" .\n')
    (tmp_path / "in" / "b.nt").write_text('<http://example.org/b> <http://example.org/p#other> "y" .\nnot a statement\n')
    seen = {}
    query = match_stream(stream_ntriples(spark, str(tmp_path / "in")), [NAME], lambda rows, number: seen.__setitem__(number, rows.collect()), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert [r.graph_id.rsplit("/", 1)[1] for rows in seen.values() for r in rows] == ["a.nt"]
