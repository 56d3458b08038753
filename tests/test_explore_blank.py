"""Explorations whose rules lead to graphs that share colours but are not isomorphic."""

import pytest

from weftline.functions.terms import IRI, LITERAL, TRIPLE
from weftline.operators import explore as E
from weftline.queries import transformer


def rings(size, count, name):
    links = [(f"{name}{c}x{i}", f"{name}{c}x{(i + 1) % size}") for c in range(count) for i in range(size)]
    return " . ".join(f"_:{x} <urn:p:next> _:{y}" for x, y in links)


def to(iri, kind, insert):
    return transformer(iri, f"ASK {{ ?s <{kind}> ?k }}", f"DELETE {{ ?s <{kind}> ?k }} INSERT {{ {insert} }} WHERE {{ ?s <{kind}> ?k }}", iri)


@pytest.mark.parametrize("filter", ["diff", "isomorphic"])
def test_states_that_share_colours_are_told_apart(spark, filter):
    rules = [
        to("urn:t:six", "urn:p:kind", rings(6, 1, "a")),
        to("urn:t:threes", "urn:p:kind", rings(3, 2, "b")),
        to("urn:t:eight", "urn:p:kind", rings(8, 1, "c")),
        to("urn:t:wait", "urn:p:kind", "?s <urn:p:waits> ?k"),
        to("urn:t:fours", "urn:p:waits", rings(4, 2, "d")),
        to("urn:t:six_later", "urn:p:waits", rings(6, 1, "e")),
    ]
    roots = spark.createDataFrame([("000", IRI, "urn:s", "urn:p:kind", LITERAL, "x", "", "")], "run_id string, " + ", ".join(f"{c} string" for c in TRIPLE))
    found = E.explore(roots, [], rules, filter=filter)
    got = {r.transformer: r.redundant for r in found.nodes.where("transformer is not null").collect()}
    assert found.reason == "done"
    assert got == {"urn:t:six": False, "urn:t:threes": False, "urn:t:eight": False, "urn:t:wait": False, "urn:t:fours": False, "urn:t:six_later": True}
