"""Whole-graph operators: updates, differences, fingerprints and isomorphism, for many graphs at once."""

from __future__ import annotations

import itertools
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import terms as t
from weftline.functions.terms import BNODE, TRIPLE
from weftline.plans import sparql as q
from weftline.plans.compiler import Compiler

from .storage import cut, distinct

KEY = ["graph_id", *TRIPLE]


def update(triples: DataFrame, operations: str | list[q.Modify], graphs: DataFrame | None = None, salt: str = "u", size: int = 0) -> DataFrame:
    """Every graph after the update. WHERE sees the state before; deletes come before inserts; the result is a set. size: about how many triples there are."""
    if isinstance(operations, str):
        operations = q.parse_update(operations)
    now = triples
    for i, op in enumerate(operations):
        c = Compiler(now, graphs)
        if op.clear:
            now = now.limit(0)
            continue
        found = c.group(op.where) if op.where is not None else c.unit()
        deleted = c.instantiate(found, op.delete, f"{salt}{i}")
        inserted = c.instantiate(found, op.insert, f"{salt}{i}")
        if op.delete:
            now = now.join(deleted.select(*KEY).distinct(), KEY, "left_anti")
        if op.insert:
            now = now.unionByName(inserted)
    return distinct(now.select(*KEY), size)


def added(samples: DataFrame, root: DataFrame) -> DataFrame:
    """Triples of each graph that the root (whatever its graph_id) lacks."""
    return samples.join(root.select(*TRIPLE).distinct(), TRIPLE, "left_anti").select(*KEY).distinct()


def removed(samples: DataFrame, root: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """Triples of the root that each graph lacks."""
    ids = graphs if graphs is not None else samples.select("graph_id").distinct()
    every = ids.select("graph_id").crossJoin(root.select(*TRIPLE).distinct())  # the root's triples for each graph: what a difference to it can hold
    return every.join(samples.select(*KEY), KEY, "left_anti")


def diff_sizes(samples: DataFrame, root: DataFrame) -> DataFrame:
    """graph_id, added, removed, diff_size. The removed count needs no triple of the root by graph: it is what the graph has in common short of the root's size."""
    ids = samples.select("graph_id").distinct()
    base = root.select(*TRIPLE).distinct()
    size = base.agg(F.count(F.lit(1)).alias("root_size"))
    new = added(samples, root).groupBy("graph_id").agg(F.count(F.lit(1)).alias("added"))
    common = samples.select(*KEY).distinct().join(base, TRIPLE, "left_semi").groupBy("graph_id").agg(F.count(F.lit(1)).alias("common"))
    rows = ids.join(new, "graph_id", "left").join(common, "graph_id", "left").crossJoin(size).na.fill(0, ["added", "common"])
    rows = rows.select("graph_id", "added", (F.col("root_size") - F.col("common")).alias("removed"))
    return rows.withColumn("diff_size", F.col("added") + F.col("removed"))


def _encoded(s, o):
    """A triple as text, with the given subject and object."""
    return F.concat_ws(" ", s, F.concat(F.lit("<"), F.col("p"), F.lit(">")), o)


def _s():
    return t.ntriples(F.col("s_kind"), F.col("s"), F.lit(""), F.lit(""))


def _o():
    return t.ntriples(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))


def _total(h: str) -> Column:
    """The sum of md5 hashes, in two parts of 60 bits, as text: the same in any order, and added up before a shuffle."""
    part = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return F.concat_ws("|", part(1), part(16), F.count(F.lit(1)).cast("string"))


def ground_fingerprints(triples: DataFrame, by: list[str] = ["graph_id"], sets: bool = False) -> DataFrame:  # noqa: B006
    """graph_id, fp, n: equal for equal sets of triples. sets: no graph has a triple twice."""
    one = triples.select(*by, F.md5(_encoded(_s(), _o())).alias("h"))
    one = one if sets else one.distinct()
    return one.groupBy(*by).agg(F.md5(_total("h")).alias("fp"), F.count(F.lit(1)).alias("n"))


def coloured(triples: DataFrame, rounds: int = 4) -> DataFrame:
    """The triples with s_key and o_key: a term's text, or for a blank node its colour after so many rounds of refinement."""
    rows = triples.select(*KEY).distinct()
    nodes = (
        rows.where(F.col("s_kind") == BNODE).select("graph_id", F.col("s").alias("node")).unionByName(rows.where(F.col("o_kind") == BNODE).select("graph_id", F.col("o").alias("node"))).distinct()
    )
    colours = nodes.withColumn("colour", F.lit("_"))
    for i in range(rounds):
        keyed_ = _with_colours(rows, colours)
        out = keyed_.where(F.col("s_kind") == BNODE).select("graph_id", F.col("s").alias("node"), F.concat_ws(" ", F.lit(">"), "p", "o_key").alias("x"))
        into = keyed_.where(F.col("o_kind") == BNODE).select("graph_id", F.col("o").alias("node"), F.concat_ws(" ", F.lit("<"), "p", "s_key").alias("x"))
        seen = out.unionByName(into).withColumn("h", F.md5("x")).groupBy("graph_id", "node").agg(_total("h").alias("x"))
        # each round reads the colours three times, so an uncut plan would grow threefold with it
        colours = cut(colours.join(seen, ["graph_id", "node"]).select("graph_id", "node", F.md5(F.concat_ws("|", "colour", "x")).alias("colour")))
    return _with_colours(rows, colours)


def _with_colours(rows: DataFrame, colours: DataFrame) -> DataFrame:
    s = colours.select("graph_id", F.col("node").alias("s"), F.lit(BNODE).alias("s_kind"), F.col("colour").alias("s_colour"))
    o = colours.select("graph_id", F.col("node").alias("o"), F.lit(BNODE).alias("o_kind"), F.col("colour").alias("o_colour"))
    joined = rows.join(s, ["graph_id", "s_kind", "s"], "left").join(o, ["graph_id", "o_kind", "o"], "left")
    mark = lambda c: F.concat(F.lit("_:"), F.col(c))
    return joined.select(*KEY, F.coalesce(mark("s_colour"), _s()).alias("s_key"), F.coalesce(mark("o_colour"), _o()).alias("o_key"))


def fingerprints(triples: DataFrame, blank: bool = True, rounds: int = 4, sets: bool = False) -> DataFrame:
    """graph_id, fp, n: equal for isomorphic graphs. Different graphs with blank nodes may share one; ``isomorphism_classes`` settles those."""
    if not blank:
        return ground_fingerprints(triples, sets=sets)
    return _of_keys(coloured(triples, rounds))


def _of_keys(keyed: DataFrame) -> DataFrame:
    rows = keyed.select("graph_id", F.md5(_encoded(F.col("s_key"), F.col("o_key"))).alias("h"))
    return rows.groupBy("graph_id").agg(F.md5(_total("h")).alias("fp"), F.count(F.lit(1)).alias("n"))


def _match(a: list[tuple], b: list[tuple]) -> bool:
    """Whether two sets of (s_kind, s, p, o_kind, o, dt, lang, s_key, o_key) are isomorphic, by backtracking within colours."""

    def nodes(rows):
        found = defaultdict(set)
        for r in rows:
            if r[0] == BNODE:
                found[r[7]].add(r[1])
            if r[3] == BNODE:
                found[r[8]].add(r[4])
        return found

    x, y = nodes(a), nodes(b)
    if len(a) != len(b) or {k: len(v) for k, v in x.items()} != {k: len(v) for k, v in y.items()}:
        return False
    target = {r[:7] for r in b}
    touching = defaultdict(list)
    for r in a:
        for kind, node in ((r[0], r[1]), (r[3], r[4])):
            if kind == BNODE:
                touching[node].append(r)
    order = [n for k in sorted(x, key=lambda k: (len(x[k]), k)) for n in sorted(x[k])]
    colour = {n: k for k, v in x.items() for n in v}
    now: dict[str, str] = {}
    used: set[str] = set()

    def fits(node: str) -> bool:
        for r in touching[node]:
            s = now.get(r[1]) if r[0] == BNODE else r[1]
            o = now.get(r[4]) if r[3] == BNODE else r[4]
            if s is not None and o is not None and (r[0], s, r[2], r[3], o, r[5], r[6]) not in target:
                return False
        return True

    def go(i: int) -> bool:
        if i == len(order):
            return all((r[0], now.get(r[1], r[1]) if r[0] == BNODE else r[1], r[2], r[3], now.get(r[4], r[4]) if r[3] == BNODE else r[4], r[5], r[6]) in target for r in a)
        for candidate in sorted(y[colour[order[i]]] - used):
            now[order[i]] = candidate
            used.add(candidate)
            if fits(order[i]) and go(i + 1):
                return True
            used.discard(candidate)
            del now[order[i]]
        return False

    return go(0)


def isomorphism_classes(triples: DataFrame, rounds: int = 4) -> DataFrame:
    """graph_id, cls: the least graph_id among isomorphic graphs.

    Graphs whose fingerprint is theirs alone, and those without blank nodes, are settled by it; only
    graphs with blank nodes that share a fingerprint are compared exactly, one fingerprint a group.
    """
    keyed = cut(coloured(triples, rounds))
    fp = _of_keys(keyed)
    blank = triples.where((F.col("s_kind") == BNODE) | (F.col("o_kind") == BNODE)).select("graph_id").distinct().withColumn("blank", F.lit(True))
    rows = fp.join(blank, "graph_id", "left")
    shared = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("k"), F.min("graph_id").alias("least"))
    rows = rows.join(shared, "fp")
    easy = rows.where("blank is null or k = 1").select("graph_id", F.col("least").alias("cls"))
    hard = rows.where("blank and k > 1").select("graph_id", "fp")
    detail = keyed.join(hard, "graph_id")

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[str, list[tuple]]] = []
        out = []
        for name, g in sorted(pdf.groupby("graph_id"), key=lambda x: x[0]):
            mine = list(g[[*TRIPLE, "s_key", "o_key"]].itertuples(index=False, name=None))
            for cls, theirs in found:
                if _match(mine, theirs):
                    out.append((name, cls))
                    break
            else:
                found.append((name, mine))
                out.append((name, name))
        return pd.DataFrame(out, columns=["graph_id", "cls"])

    return easy.unionByName(detail.groupBy("fp").applyInPandas(split, "graph_id string, cls string"))


def isomorphic(a: list[tuple], b: list[tuple]) -> bool:
    """Whether two small graphs (rows of parse()) are isomorphic; tries all mappings, for tests and single comparisons."""
    names = lambda rows: sorted({r[1] for r in rows if r[0] == BNODE} | {r[4 - 0] for r in rows if r[3] == BNODE})
    x, y = names(a), names(b)
    if len(x) != len(y) or len(set(a)) != len(set(b)):
        return False
    target = set(b)
    for order in itertools.permutations(y):
        to = dict(zip(x, order, strict=True))
        if {(r[0], to[r[1]] if r[0] == BNODE else r[1], r[2], r[3], to[r[4]] if r[3] == BNODE else r[4], r[5], r[6]) for r in a} == target:
            return True
    return False
