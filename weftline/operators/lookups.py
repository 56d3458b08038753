"""Look-ups in graphs: subjects of a class, RDF lists, groups, and which of equal graphs came first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.terms import RDF_FIRST, RDF_NIL, RDF_REST, RDF_TYPE

from .storage import cut

#: Doublings after which every list must have been walked; lists of 2^40 cells are within them, circles never are.
LIST_ROUNDS = 40


def by_class(triples: DataFrame, cls: str) -> DataFrame:
    """graph_id, s_kind, s: each graph's subjects of the class."""
    return triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == cls)).select("graph_id", "s_kind", "s").distinct()


def one_by_class(triples: DataFrame, cls: str) -> DataFrame:
    """graph_id, s: the one subject of the class; a graph with several, or with none, is an error."""
    found = by_class(triples, cls).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s"))
    every = triples.select("graph_id").distinct().join(found, "graph_id", "left")
    message = F.concat(F.lit("expected one subject of the class, found "), F.coalesce("n", F.lit(0)).cast("string"))
    return every.select("graph_id", F.when(F.col("n") == 1, F.col("s")).otherwise(F.raise_error(message)).alias("s"))


def list_cells(triples: DataFrame) -> DataFrame:
    """graph_id, s, first, rest of the cells of RDF lists."""
    first = triples.where(F.col("p") == RDF_FIRST).select("graph_id", "s", F.col("o").alias("first"))
    rest = triples.where(F.col("p") == RDF_REST).select("graph_id", "s", F.col("o").alias("rest"))
    return first.join(rest, ["graph_id", "s"])


def walk_lists(heads: DataFrame, cells: DataFrame) -> DataFrame:
    """list, place (from 0), item. heads: list, head; cells: s, first, rest.

    Each cell looks for its head along the cells before it, twice as far each round, so a list of n cells takes
    log2(n) rounds. Lists may share a tail. A circle is an error if a head leads into it.
    """
    known = heads.select(F.col("head").alias("cell")).distinct()
    before = cells.where(F.col("rest") != RDF_NIL).select(F.col("rest").alias("cell"), F.col("s").alias("start"))
    marked = before.join(known.select(F.col("cell").alias("start"), F.lit(True).alias("done")), "start", "left")
    steps = marked.select("cell", "start", F.lit(1).cast("long").alias("place"), F.coalesce("done", F.lit(False)).alias("done"))
    now = cut(steps.unionByName(known.select("cell", F.col("cell").alias("start"), F.lit(0).cast("long").alias("place"), F.lit(True).alias("done"))))
    for _ in range(LIST_ROUNDS):
        open_ = now.where("not done")
        if not open_.limit(1).count():
            break
        further = now.select(F.col("cell").alias("start"), F.col("start").alias("from"), F.col("place").alias("more"), F.col("done").alias("there"))
        moved = open_.join(further, "start").select("cell", F.col("from").alias("start"), (F.col("place") + F.col("more")).alias("place"), F.col("there").alias("done"))
        now = cut(now.where("done").unionByName(moved).distinct())
    else:
        raise ValueError("a list runs in a circle")
    placed = now.select(F.col("start").alias("head"), F.col("cell").alias("s"), "place")
    return heads.join(placed, "head").join(cells.select("s", "first"), "s").select("list", "place", F.col("first").alias("item"))


def sorted_groups(members: DataFrame, group: str, member: str) -> DataFrame:
    """group, transformers: each group's members without regard to case, then by code point, as one array; groups are settings, a few names."""
    rows = members.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.lower(member).alias("k"), F.col(member).alias("n")))).alias("x"))
    return rows.select(F.col(group).alias("group"), F.col("x.n").alias("transformers"))


def first_wins(fingerprints: DataFrame, order: Column) -> DataFrame:
    """graph_id, redundant: whether an earlier graph has the same fingerprint. Of each only the least place is shuffled to all."""
    least = fingerprints.groupBy("fp").agg(F.min(F.struct(order.alias("at"), "graph_id")).alias("first"))
    return fingerprints.join(least, "fp").select("graph_id", (F.col("graph_id") != F.col("first.graph_id")).alias("redundant"))
