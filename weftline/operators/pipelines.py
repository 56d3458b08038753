"""What an exploration found: pipelines, edges, vertices, statistics, as DataFrames of the nodes table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.model import Application, Component, Group

from .prune import group_of

TOTAL = -1


def titles(components: list[Component]) -> Column:
    """IRI to label; components are settings, a few names."""
    if not components:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for c in components for x in (c.iri, c.label)])


def pipelines(nodes: DataFrame) -> DataFrame:
    """run_id, node_id, seq, application, transformers (in order), steps: one row for each application that fits a node."""
    rows = nodes.where("expanded and not redundant")
    one = rows.select("run_id", "node_id", "seq", "level", "path", F.posexplode("applications").alias("application_idx", "application"))
    used = F.filter(F.col("path.transformer"), lambda x: x.isNotNull())
    return one.select("run_id", "node_id", "seq", "application_idx", "application", used.alias("transformers"), F.size(used).alias("steps"), "path")


def pipeline_json(nodes: DataFrame, components: list[Component], datasets: DataFrame) -> DataFrame:
    """run_id, seq, json: each pipeline's components from the dataset to the application. datasets: run_id, dataset, dataset_label."""
    names = titles(components)
    label = lambda iri: F.coalesce(F.try_element_at(names, iri), F.lit(""))
    found = pipelines(nodes).join(datasets, "run_id")
    part = lambda node, iri, text: F.struct(node.alias("node"), iri.alias("iri"), text.alias("label"))
    steps = F.transform("path", lambda x: part(x["node"], F.coalesce(x["transformer"], F.col("dataset")), F.when(x["transformer"].isNull(), F.col("dataset_label")).otherwise(label(x["transformer"]))))
    last = F.array(part(F.col("node_id"), F.col("application"), label(F.col("application"))))
    return found.select("run_id", "seq", "application_idx", F.to_json(F.struct(F.concat(steps, last).alias("components"))).alias("json"))


def edges(nodes: DataFrame) -> DataFrame:
    """run_id, source, target, transformer."""
    return nodes.where("parent_id is not null").select("run_id", F.col("parent_id").alias("source"), F.col("node_id").alias("target"), "transformer", "seq")


def vertices(nodes: DataFrame, applications: list[Application], groups: list[Group] | None = None) -> DataFrame:
    """run_id, id, level, redundant, group (IRI of the transformer's first group) and a 0/1 column for each application's label."""
    groups = groups or []
    names = F.array(*[F.lit(x.iri) for x in groups]) if groups else F.array().cast("array<string>")
    place = group_of(F.col("transformer"), groups)
    group = F.coalesce(F.get(names, place), F.lit("")) if groups else F.lit("")
    columns, taken = [], {"run_id", "id", "level", "redundant", "group", "seq"}
    for a in applications:
        name = a.label or a.iri
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        columns.append(F.array_contains("applications", a.iri).cast("int").alias(name))
    return nodes.select("run_id", F.col("node_id").alias("id"), "level", "redundant", group.alias("group"), *columns, "seq")


def level_statistics(nodes: DataFrame, waiting: bool = False) -> DataFrame:
    """run_id, level, start_nodes, expanded, filtered, new_nodes, next_level, applications, transformers, new_applications.

    Pruned nodes count as expanded and filtered, and their transformers as used. Only expanded nodes
    count unless ``waiting``.
    """
    rows = nodes if waiting else nodes.where("expanded")
    kids = nodes.where("parent_id is not null").groupBy("run_id", (F.col("level") - 1).alias("level")).agg(F.count(F.lit(1)).alias("next_level"))
    mine = rows.groupBy("run_id", "level").agg(
        F.count(F.lit(1)).alias("start_nodes"),
        F.count_if(F.col("expanded")).alias("expanded"),
        F.count_if(F.col("redundant")).alias("filtered"),
        F.count_if(~F.col("redundant") & (F.col("level") > 0)).alias("new_nodes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("applications")))).alias("applications"),
        F.sort_array(F.collect_set("transformer")).alias("transformers"),
    )
    first = new_applications(rows).select("run_id", "level", "new_applications")
    return mine.join(kids, ["run_id", "level"], "left").join(first, ["run_id", "level"], "left").na.fill(0, ["next_level", "new_applications"])


def new_applications(nodes: DataFrame) -> DataFrame:
    """run_id, level, new_applications: how many applications fit for the first time there (levels without any are left out)."""
    seen = nodes.where("expanded").select("run_id", "level", F.explode("applications").alias("application"))
    first = seen.groupBy("run_id", "application").agg(F.min("level").alias("level"))
    return first.groupBy("run_id", "level").agg(F.count(F.lit(1)).alias("new_applications"))


def total_statistics(levels: DataFrame) -> DataFrame:
    """One row a run over its levels: level -1, start_nodes and next_level 0."""
    return levels.groupBy("run_id").agg(
        F.lit(TOTAL).alias("level"),
        F.lit(0).cast("long").alias("start_nodes"),
        F.sum("expanded").alias("expanded"),
        F.sum("filtered").alias("filtered"),
        F.sum("new_nodes").alias("new_nodes"),
        F.lit(0).cast("long").alias("next_level"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("applications")))).alias("applications"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("transformers")))).alias("transformers"),
    )


def filter_usage(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """diff_size, states (new), matched (redundant). sizes: run_id, node_id, diff_size of every judged graph."""
    rows = nodes.where("expanded and level > 0 and not pruned").join(sizes, ["run_id", "node_id"])
    return rows.groupBy("diff_size").agg(F.count_if(~F.col("redundant")).alias("states"), F.count_if(F.col("redundant")).alias("matched")).orderBy("diff_size")


def preorder(nodes: DataFrame) -> DataFrame:
    """The nodes with ``visit``, their place (from 0) in the depth-first order of their run."""
    key = F.transform("path", lambda x: x["node"])
    seqs = nodes.select("run_id", F.col("node_id").alias("n"), F.col("seq").alias("s"))
    steps = nodes.select("run_id", "node_id", F.posexplode(key).alias("i", "n")).join(seqs, ["run_id", "n"])
    order = steps.groupBy("run_id", "node_id").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).getField("s").alias("order"))
    # a run's tree is walked as one sequence
    return nodes.join(order, ["run_id", "node_id"]).withColumn("visit", F.row_number().over(Window.partitionBy("run_id").orderBy("order")) - 1).drop("order")
