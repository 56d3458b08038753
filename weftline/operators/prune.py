"""Pruning by strong groups, and shaking of finished trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.model import Group


def group_of(transformer: Column, groups: list[Group]) -> Column:
    """The place of the first group with the transformer; null for none. Groups are settings, a few names."""
    first: dict[str, int] = {}
    for i, x in enumerate(groups):
        for iri in x.transformers:
            first.setdefault(iri, i)
    if not first:
        return F.lit(None).cast("int")
    table = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    return F.try_element_at(table, transformer)


def place_in(transformer: Column, groups: list[Group]) -> Column:
    """The transformer's place in its first group."""
    first: dict[str, int] = {}
    for x in groups:
        for i, iri in enumerate(x.transformers):
            first.setdefault(iri, i)
    if not first:
        return F.lit(None).cast("int")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in first.items() for x in pair]), transformer)


def strong_groups(groups: list[Group]) -> Column:
    """Whether a child (run_id, parent_id, parent_transformer, transformer, transformer_idx) is pruned.

    If a child is in its parent's group, only that group's first child stays. Otherwise each group's
    first child stays, and children without a group all do.
    """
    mine, theirs = group_of(F.col("transformer"), groups), group_of(F.col("parent_transformer"), groups)
    siblings = Window.partitionBy("run_id", "parent_id")
    own = F.coalesce(mine == theirs, F.lit(False))
    any_own = F.max(own.cast("int")).over(siblings) == 1
    place = F.coalesce(place_in(F.col("transformer"), groups), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("run_id", "parent_id", mine).orderBy(place, "transformer_idx"))
    first = rank == 1
    return F.when(any_own, ~(own & first)).otherwise(mine.isNotNull() & ~first)


def prune(children: DataFrame, groups: list[Group]) -> DataFrame:
    """The children with ``pruned``."""
    return children.withColumn("pruned", strong_groups(groups))


def shake_non_expanded(nodes: DataFrame) -> DataFrame:
    return nodes.where("expanded")


def shake_redundant(nodes: DataFrame) -> DataFrame:
    """A redundant node has no children, so the rows alone go."""
    return nodes.where("not redundant")
