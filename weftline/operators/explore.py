"""Level-by-level exploration: from each dataset, every chain of transformers that still leads to something new.

One level of all datasets is one batch: the guards of all components are evaluated on all graphs of the
level at once, each transformer rewrites all its parents' graphs at once, and what is redundant is
found by fingerprint; graphs with blank nodes that share one are compared exactly. A child's graph depends on its parent only, and "new" is an equivalence class not
seen at a smaller position, so the result is that of expanding one node after the other.

Tables: nodes(run_id, node_id, parent_id, seq, level, transformer_idx, transformer, applications,
redundant, pruned, expanded, fp, path) and graphs (triples with graph_id = run_id|node_id). Each level's
tables are written to the shared folder, which cuts the lineage and lets a lost executor's work be
redone from there; only counts come to the driver.
"""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import terms as t
from weftline.functions.terms import TRIPLE
from weftline.model import Application, Component, Dataset, Group, Transformer
from weftline.plans import sparql as q
from weftline.plans.compiler import Compiler

from . import graphs as g
from .prune import strong_groups
from .storage import SampleStore, cut, distinct

FILTERS = ("none", "diff", "isomorphic")

NODES = (
    "run_id string, node_id string, parent_id string, seq long, level int, transformer_idx int, transformer string, applications array<string>, "
    "redundant boolean, pruned boolean, expanded boolean, fp string, path array<struct<node:string,transformer:string>>"
)
_COLUMNS = [x.split()[0] for x in NODES.split(", ")]


def matches(triples: DataFrame, components: list[Component], graph_ids: DataFrame | None = None) -> DataFrame:
    """graph_id, idx, iri of the components all of whose guards hold. Each different ASK text is evaluated once for all graphs."""
    ids = (graph_ids if graph_ids is not None else triples).select("graph_id").distinct()
    spark = triples.sparkSession
    texts = list(dict.fromkeys(x for c in components for x in c.guards))
    hits = None
    for i, text in enumerate(texts):
        query = q.parse_query(text)
        if not isinstance(query, q.Ask):
            raise q.SparqlError("a descriptor's query must be an ASK")
        one = Compiler(triples, ids).ask(query).select("graph_id", F.lit(i).alias("guard"))
        hits = one if hits is None else hits.unionByName(one)
    wanted = [(i, c.iri, len(set(c.guards))) for i, c in enumerate(components) if c.guards]
    links = [(i, texts.index(x)) for i, c in enumerate(components) for x in dict.fromkeys(c.guards)]
    always = [(i, c.iri) for i, c in enumerate(components) if not c.guards]
    out = []
    if wanted:
        need = spark.createDataFrame(wanted, "idx int, iri string, need long")
        link = spark.createDataFrame(links, "idx int, guard int")
        got = hits.join(link, "guard").groupBy("graph_id", "idx").agg(F.count(F.lit(1)).alias("got"))
        out.append(got.join(need, "idx").where("got = need").select("graph_id", "idx", "iri"))
    if always:
        out.append(ids.crossJoin(spark.createDataFrame(always, "idx int, iri string")).select("graph_id", "idx", "iri"))  # components without a guard fit each graph
    if not out:
        return spark.createDataFrame([], "graph_id string, idx int, iri string")
    return reduce(DataFrame.unionByName, out)


@dataclass
class Result:
    """nodes and graphs as tables; levels: (level, start nodes, duration ms); reason: why the run ended (done, level-limit, time-limit, node-time-limit, listener)."""

    nodes: DataFrame
    graphs: DataFrame
    levels: list[tuple[int, int, int]] = field(default_factory=list)
    reason: str = "done"
    #: Milliseconds spent on matching guards, rewriting and filtering.
    timers: dict[str, int] = field(default_factory=dict)
    #: The children that wait for a next level, empty when done.
    queue: DataFrame | None = None


class Listener:
    """Hooks of a run; a False from any of the level hooks ends the run. All are called, whatever the others say."""

    #: Why the run ended, if this listener ended it.
    reason = "listener"

    def will_run(self) -> None: ...

    def level_will_start(self, level: int, start_nodes: int) -> bool:
        return True

    def nodes_will_expand(self, level: int, nodes: DataFrame) -> None:
        """nodes: those of the level that no group pruned, before their graphs are made."""

    def nodes_did_expand(self, level: int, nodes: DataFrame) -> None:
        """nodes: those of the level, judged."""

    def level_did_end(self, level: int, nodes: DataFrame) -> bool:
        return True

    def did_run(self, result: Result) -> None: ...

    def clean_up(self) -> None:
        """Called at the end, after a failure too."""


class TimeLimit(Listener):
    """Ends the run after the level in which the time is up."""

    reason = "time-limit"

    def __init__(self, seconds: float):
        self.seconds, self.began = seconds, 0.0

    def will_run(self) -> None:
        self.began = time.monotonic()

    def level_did_end(self, level: int, nodes: DataFrame) -> bool:
        return time.monotonic() - self.began < self.seconds


class NodeTimeLimit(Listener):
    """Ends the run after a level that took more than so many seconds for each of its nodes; a level is one batch, so this is their mean."""

    reason = "node-time-limit"

    def __init__(self, seconds: float):
        self.seconds, self.began, self.nodes = seconds, 0.0, 0

    def level_will_start(self, level: int, start_nodes: int) -> bool:
        self.began, self.nodes = time.monotonic(), start_nodes
        return True

    def level_did_end(self, level: int, nodes: DataFrame) -> bool:
        return time.monotonic() - self.began <= self.seconds * self.nodes


def _ended(listeners: list[Listener], hook: str, *what) -> str | None:
    """The reason of the first listener that says so; all are asked."""
    said = [x.reason for x in listeners if not getattr(x, hook)(*what)]
    return said[0] if said else None


class Timers(dict):
    """Milliseconds by name, added up."""

    @contextmanager
    def of(self, name: str):
        began = time.monotonic()
        try:
            yield
        finally:
            self[name] = self.get(name, 0) + int(1000 * (time.monotonic() - began))


def _fingerprints(triples: DataFrame, roots: DataFrame, how: str, blank: bool) -> DataFrame:
    """graph_id, fp by the filter's notion of sameness; triples: a set; roots: triples with run_id, of each run's root."""
    if how != "diff" or not blank:  # of ground graphs, those that add the same to and lack the same of their root are equal
        return g.fingerprints(triples, blank, sets=True).select("graph_id", "fp")
    ids = triples.select("graph_id").distinct()
    found = g.fingerprints(_compared(triples, roots, how), blank).select("graph_id", "fp")
    return ids.join(found, "graph_id", "left").withColumn("fp", F.coalesce("fp", F.md5(F.lit(""))))


def _compared(triples: DataFrame, roots: DataFrame, how: str) -> DataFrame:
    """The graphs by which states are the same: whole ones, or for diff what each adds to and lacks of its root, with predicates and blank nodes of their own."""
    if how != "diff":
        return triples
    runs = triples.withColumn("run_id", F.substring_index("graph_id", "|", 1))
    base = roots.select("run_id", *TRIPLE).distinct()
    new = runs.join(base, ["run_id", *TRIPLE], "left_anti")
    # what each graph lacks: its run's root triples, less its own
    lost = runs.select("run_id", "graph_id").distinct().join(base, "run_id").join(runs, ["run_id", "graph_id", *TRIPLE], "left_anti")

    def marked(rows: DataFrame, mark: str) -> DataFrame:
        own = lambda kind, c: F.when(F.col(kind) == t.BNODE, F.concat(F.lit(mark), c)).otherwise(F.col(c)).alias(c)
        return rows.select("graph_id", "s_kind", own("s_kind", "s"), F.concat(F.lit(mark), "p").alias("p"), "o_kind", own("o_kind", "o"), "o_dt", "o_lang")

    return marked(new, "+").unionByName(marked(lost, "-"))


def _settled(judged: DataFrame, visited: DataFrame | None, triples: DataFrame, roots: DataFrame, how: str) -> DataFrame:
    """judged with again: whether a state visited or earlier in the level is isomorphic, compared exactly where fingerprints are equal."""
    every = judged.select("run_id", "node_id", "fp", "seq", F.lit(False).alias("known"))
    if visited is not None:
        every = every.unionByName(visited.select("run_id", "node_id", "fp", F.lit(-1).cast("long").alias("seq"), F.lit(True).alias("known")))
    shared = every.groupBy("run_id", "fp").agg(F.count(F.lit(1)).alias("k"), F.max(~F.col("known")).alias("fresh")).where("k > 1 and fresh").select("run_id", "fp")
    shared = cut(every.join(shared, ["run_id", "fp"]).withColumn("graph_id", F.concat_ws("|", "run_id", "node_id")))
    if not shared.limit(1).count():
        return judged.withColumn("again", F.lit(False))
    classes = g.isomorphism_classes(cut(_compared(triples.join(shared.select("graph_id"), "graph_id", "left_semi"), roots, how)))
    # a graph without triples has no class, and is like all others of its fingerprint
    in_class = Window.partitionBy("run_id", "fp", "cls").orderBy(F.col("known").desc(), "seq")
    told = shared.join(classes, "graph_id", "left").withColumn("again", F.row_number().over(in_class) > 1).where("not known").select("run_id", "node_id", "again")
    return judged.join(told, ["run_id", "node_id"], "left").withColumn("again", F.coalesce("again", F.lit(False)))


def root_graphs(spark: SparkSession, datasets: list[Dataset]) -> DataFrame:
    """run_id and the triples of the datasets' samples; runs are numbered in order of IRI."""
    rows = [(f"{i:03d}", *r) for i, d in enumerate(sorted(datasets, key=lambda d: d.iri)) for r in d.rows]
    return spark.createDataFrame(rows, "run_id string, " + ", ".join(f"{c} string" for c in TRIPLE))


def explore(
    roots: DataFrame,
    applications: list[Application],
    transformers: list[Transformer],
    filter: str = "diff",
    level_limit: int = -1,
    groups: list[Group] | None = None,
    prefix: str = "",
    blank: bool | None = None,
    runs: DataFrame | None = None,
    listeners: list[Listener] | None = None,
    resume: Result | None = None,
    include_root: bool = False,
    store: SampleStore | None = None,
) -> Result:
    """Explores from roots (run_id and triples) until nothing new is found, or through ``level_limit`` levels.

    filter: none takes every child as new (a limit is then required), diff compares what a graph adds to
    and lacks of its root, isomorphic the whole graph. blank: whether blank nodes may occur (None: looked
    up in roots and rules); without them fingerprints need no refinement. groups: strong groups to prune
    by. runs: run ids, for roots that may have no triples. resume: an unfinished result to go on from. store:
    what holds the graphs between levels; files unless given.
    """
    if filter not in FILTERS:
        raise ValueError(f"unknown filter {filter!r}")
    if filter == "none" and level_limit < 0:
        raise ValueError("without a filter an exploration may never end; give a level limit")
    spark = roots.sparkSession
    rules = [q.parse_update(x.rule) for x in transformers]
    if blank is None:
        blank = _mints_blanks(rules) or bool(roots.where((F.col("s_kind") == t.BNODE) | (F.col("o_kind") == t.BNODE)).limit(1).count())
    listeners, store, timers = listeners or [], store or SampleStore(spark), Timers(resume.timers if resume else {})
    for x in listeners:
        x.will_run()
    try:
        return _run(roots, applications, transformers, rules, filter, level_limit, groups, prefix, blank, runs, listeners, resume, include_root, store, timers)
    finally:
        for x in listeners:
            x.clean_up()


def _run(roots, applications, transformers, rules, filter, level_limit, groups, prefix, blank, runs, listeners, resume, include_root, store, timers) -> Result:
    ids = (runs if runs is not None else roots).select("run_id").distinct()
    roots = roots.select("run_id", *TRIPLE)
    roots = cut(distinct(roots, roots.count()))
    if resume is None:
        root = ids.select(
            "run_id",
            F.lit(prefix + "root").alias("node_id"),
            F.lit(None).cast("string").alias("parent_id"),
            F.lit(0).cast("long").alias("seq"),
            F.lit(0).alias("level"),
            F.lit(None).cast("int").alias("transformer_idx"),
            F.lit(None).cast("string").alias("transformer"),
        )
        first = roots.select(F.concat_ws("|", "run_id", F.lit(prefix + "root")).alias("graph_id"), *TRIPLE)
        expanded, graphs = _matched(root, first, applications, [F.array().cast(NODES.rsplit("path ", 1)[1]).alias("before")])
        done = [cut(expanded.withColumn("fp", F.lit(None).cast("string")).select(*_COLUMNS))]
        stored = [store.add(graphs, "ROOT")]
        visited = None
        if include_root and filter != "none":
            visited = cut(_fingerprints(stored[0], roots, filter, blank).select(F.substring_index("graph_id", "|", 1).alias("run_id"), F.lit(prefix + "root").alias("node_id"), "fp"))
        queue = _children(done[0], None, stored[0], transformers, groups, prefix, 0)
        level, levels, parents = 1, [], stored[0]
    else:
        done, stored, levels = [cut(resume.nodes.where("expanded"))], [resume.graphs], list(resume.levels)
        seen = resume.nodes.where("expanded and not redundant and fp is not null").select("run_id", "node_id", "fp")
        visited = cut(seen) if filter != "none" else None
        queue = cut(resume.queue)
        level, parents = queue.agg(F.max("level")).first()[0] or 0, resume.graphs
    reason = "done"
    while (start := queue.count()) > 0:
        if level_limit >= 0 and level > level_limit:
            reason = "level-limit"
            break
        if said := _ended(listeners, "level_will_start", level, start):
            reason = said
            break
        began = time.monotonic()
        work = queue.where("not pruned")
        for x in listeners:
            x.nodes_will_expand(level, work)
        with timers.of("update"):
            made = cut(_rewritten(work, parents, transformers, rules, prefix, level))
        if filter == "none":
            judged = work.withColumn("fp", F.lit(None).cast("string")).withColumn("again", F.lit(False))
        else:
            fps = _fingerprints(made, roots, filter, blank)
            judged = work.withColumn("graph_id", F.concat_ws("|", "run_id", "node_id")).join(fps, "graph_id", "left").withColumn("fp", F.coalesce("fp", F.md5(F.lit("")))).drop("graph_id")
            if blank:
                judged = _settled(cut(judged), visited, reduce(DataFrame.unionByName, stored, made), roots, filter)
            else:
                judged = judged.withColumn("again", F.row_number().over(Window.partitionBy("run_id", "fp").orderBy("seq")) > 1)
                if visited is not None:
                    known = visited.select("run_id", "fp", F.lit(True).alias("known"))
                    judged = judged.join(known, ["run_id", "fp"], "left").withColumn("again", F.col("again") | F.col("known").isNotNull()).drop("known")
        with timers.of("filter"):
            judged = cut(judged)
        for x in listeners:
            x.nodes_did_expand(level, judged)
        new = judged.where("not again")
        keep = new.select(F.concat_ws("|", "run_id", "node_id").alias("graph_id"))
        fresh = made.join(keep, "graph_id", "left_semi")
        expanded, fresh = _matched(new.drop("again"), fresh, applications, ["before"], fps=True)
        old = judged.where("again").drop("again").unionByName(queue.where("pruned").withColumn("fp", F.lit(None).cast("string")))
        old = old.withColumn("applications", F.array().cast("array<string>")).withColumn("redundant", F.lit(True)).withColumn("expanded", F.lit(True))
        with timers.of("ask-applications"):
            nodes = cut(expanded.select(*_COLUMNS).unionByName(_with_path(old).select(*_COLUMNS)))
        with timers.of("store"):
            stored.append(store.add(fresh, "NODE"))
        done.append(nodes)
        if filter != "none":
            more = nodes.where("not redundant").select("run_id", "node_id", "fp")
            visited = visited.unionByName(more) if visited is not None else more  # written tables, one a level
        with timers.of("ask-transformers"):
            queue, parents = _children(nodes.where("not redundant"), queue, stored[-1], transformers, groups, prefix, level), stored[-1]
        levels.append((level, start, int(1000 * (time.monotonic() - began))))
        if said := _ended(listeners, "level_did_end", level, nodes):
            reason = said
            break
        level += 1
    nodes = reduce(DataFrame.unionByName, done)
    waiting = _with_path(queue).withColumn("fp", F.lit(None).cast("string")).withColumn("applications", F.array().cast("array<string>")).withColumn("redundant", F.col("pruned")).withColumn("expanded", F.lit(False))
    result = Result(nodes.unionByName(waiting.select(*_COLUMNS)), reduce(DataFrame.unionByName, stored), levels, reason, dict(timers), queue)
    for x in listeners:
        x.did_run(result)
    return result


def _with_path(rows: DataFrame) -> DataFrame:
    step = F.array(F.struct(F.col("node_id").alias("node"), F.col("transformer")))
    return rows.withColumn("path", F.concat("before", step))


def _matched(rows: DataFrame, triples: DataFrame, applications: list[Application], before: list, fps: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows with the applications that fit their graphs, expanded and new."""
    if before and not isinstance(before[0], str):
        rows = rows.select("*", before[0])
    rows = rows.withColumn("graph_id", F.concat_ws("|", "run_id", "node_id"))
    apps = matches(triples, applications, rows).groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("idx", "iri"))).alias("a"))
    out = rows.join(apps, "graph_id", "left").withColumn("applications", F.coalesce(F.col("a.iri"), F.array().cast("array<string>")))
    out = out.withColumn("redundant", F.lit(False)).withColumn("expanded", F.lit(True))
    if "pruned" not in out.columns:
        out = out.withColumn("pruned", F.lit(False))
    return _with_path(out), triples


def _children(nodes: DataFrame, queue: DataFrame | None, triples: DataFrame, transformers: list[Transformer], groups: list[Group] | None, prefix: str, level: int) -> DataFrame:
    """The new nodes' children in breadth-first order, with ids and pruning; written.

    Ids are ``0_i`` below the root; deeper, ``1_i`` with one counter a run that goes on from level to
    level. seq has the level in its high part and the number in the id in its low one. queue: all nodes
    of this level, redundant ones included, whose numbers are used.
    """
    rows = nodes.withColumn("graph_id", F.concat_ws("|", "run_id", "node_id"))
    hit = matches(triples, transformers, rows).select("graph_id", F.col("idx").alias("transformer_idx"), F.col("iri").alias("transformer"))
    parents = rows.select("graph_id", "run_id", F.col("node_id").alias("parent_id"), F.col("seq").alias("parent_seq"), F.col("transformer").alias("parent_transformer"), F.col("path").alias("before"))
    kids = parents.join(hit, "graph_id").drop("graph_id")
    # one run's nodes of one level are numbered together: a node is a few names, and the samples behind them aren't touched
    kids = kids.withColumn("number", F.row_number().over(Window.partitionBy("run_id").orderBy("parent_seq", "transformer_idx")))
    if level >= 2:
        used = queue.groupBy("run_id").agg((F.max("seq") - F.lit(level << 40)).alias("used"))
        kids = kids.join(used, "run_id").withColumn("number", F.col("number") + F.col("used"))
    mark = "0_" if level == 0 else "1_"
    kids = kids.withColumn("node_id", F.concat(F.lit(prefix + mark), F.col("number").cast("string"))).withColumn("seq", F.lit((level + 1) << 40) + F.col("number")).withColumn("level", F.lit(level + 1))
    kids = kids.withColumn("pruned", strong_groups(groups) if groups else F.lit(False))
    return cut(kids.select("run_id", "node_id", "parent_id", "seq", "level", "transformer_idx", "transformer", "before", "pruned"))


def _rewritten(work: DataFrame, parents: DataFrame, transformers: list[Transformer], rules: list, prefix: str, level: int) -> DataFrame:
    """The children's graphs: each transformer's rule on all its parents' graphs."""
    out, size = [], parents.count()
    for i, operations in enumerate(rules):
        mine = work.where(F.col("transformer_idx") == i).select(F.concat_ws("|", "run_id", "parent_id").alias("graph_id"), F.concat_ws("|", "run_id", "node_id").alias("child"))
        rows = parents.join(mine, "graph_id").select(F.col("child").alias("graph_id"), *TRIPLE)
        ids = mine.select(F.col("child").alias("graph_id"))
        out.append(g.update(rows, operations, ids, salt=f"r{i}-", size=size))
    return reduce(DataFrame.unionByName, out)


def _mints_blanks(rules: list) -> bool:
    return any(isinstance(n, q.Var) and n.name.startswith("_:") for ops in rules for op in ops for x in op.insert for n in (x[0], x[2])) or any("BNODE" in str(op.where) for ops in rules for op in ops)
