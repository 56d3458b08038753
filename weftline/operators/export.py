"""Files of a finished run: pipelines, exploration graph, samples and statistics."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.terms import line
from weftline.model import Application, Component, Group

from . import pipelines as P
from .checkpoint import filter_state
from .explore import Result


def _csv(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").partitionBy(*by).csv(path, header=True, quoteAll=True, quote='"', escape="\\")


def export_samples(result: Result, path: str) -> None:
    """N-Triples of each expanded, non-redundant node, in a folder for each run and node."""
    rows = result.graphs.withColumn("run_id", F.substring_index("graph_id", "|", 1)).withColumn("node_id", F.substring_index("graph_id", "|", -1))
    rows.select("run_id", "node_id", line().alias("value")).write.mode("overwrite").partitionBy("run_id", "node_id").text(path)


def export_run(result: Result, applications: list[Application], components: list[Component], datasets: DataFrame, output: str, groups: list[Group] | None = None) -> None:
    """pipelines.json, nodes.json, gephi-edges.csv, gephi-vertices.csv, statistics.json, filter.json and node-data-samples below ``output``.

    Each is a folder with one folder ``run_id=...`` for each dataset's run, as node ids repeat from run to run.
    """
    nodes, order = result.nodes, ["run_id", "seq"]
    P.pipeline_json(nodes, components, datasets).sort("run_id", "seq", "application_idx").select("run_id", "json").write.mode("overwrite").partitionBy("run_id").text(f"{output}/pipelines.json")
    nodes.sort(*order).write.mode("overwrite").partitionBy("run_id").json(f"{output}/nodes.json")
    _csv(P.edges(nodes).sort(*order).select("run_id", "source", "target", "transformer"), f"{output}/gephi-edges.csv", "run_id")
    _csv(P.vertices(nodes, applications, groups).sort(*order).drop("seq"), f"{output}/gephi-vertices.csv", "run_id")
    export_statistics(result, f"{output}/statistics.json")
    filter_state(nodes).write.mode("overwrite").partitionBy("run_id").json(f"{output}/filter.json")
    export_samples(result, f"{output}/node-data-samples")


def shared_time(nodes: DataFrame, levels: list[tuple[int, int, int]]) -> DataFrame:
    """run_id, level, duration: the milliseconds of each level, which all runs go through together, dealt to the runs by their nodes in it."""
    times = nodes.sparkSession.createDataFrame([(n, ms) for n, _, ms in levels] or [(-1, 0)], "level int, ms long")
    mine = nodes.where("expanded").groupBy("run_id", "level").agg(F.count(F.lit(1)).alias("n"))
    every = mine.groupBy("level").agg(F.sum("n").alias("every"))
    rows = mine.join(F.broadcast(times), "level").join(every, "level")  # a row for each level
    return rows.select("run_id", "level", F.floor(F.col("ms") * F.col("n") / F.col("every")).cast("long").alias("duration"))


def statistics_rows(result: Result) -> DataFrame:
    """Levels with their durations."""
    times = shared_time(result.nodes, result.levels)
    return P.level_statistics(result.nodes).join(times, ["run_id", "level"], "left").na.fill(0, ["duration"])


def export_statistics(result: Result, path: str) -> None:
    rows = statistics_rows(result)
    level = F.struct("level", "duration", F.col("start_nodes").alias("startNodes"), F.col("expanded").alias("expandedNodes"), F.col("filtered").alias("filteredNodes"), F.col("new_nodes").alias("newNodes"), F.col("next_level").alias("nextLevel"), F.col("applications").alias("application"), F.col("transformers").alias("transformer"))
    rows.groupBy(F.col("run_id").alias("iri")).agg(F.sort_array(F.collect_list(level)).alias("level")).write.mode("overwrite").json(path)


STATISTICS = "iri string, level array<struct<level:int,duration:long,startNodes:long,expandedNodes:long,filteredNodes:long,newNodes:long,nextLevel:long,application:array<string>,transformer:array<string>>>"


def load_statistics(spark, path: str) -> DataFrame:
    """run_id and the levels' figures, one row a level."""
    one = spark.read.schema(STATISTICS).json(path).select(F.col("iri").alias("run_id"), F.explode("level").alias("x"))
    return one.select("run_id", "x.level", "x.duration", F.col("x.startNodes").alias("start_nodes"), F.col("x.expandedNodes").alias("expanded"), F.col("x.filteredNodes").alias("filtered"), F.col("x.newNodes").alias("new_nodes"), F.col("x.nextLevel").alias("next_level"), F.col("x.application").alias("applications"), F.col("x.transformer").alias("transformers"))


def write_experiment(tables: dict[str, DataFrame], output: str) -> None:
    """The experiment's roll-ups as CSV folders named <name>.csv."""
    Path(output).mkdir(parents=True, exist_ok=True) if "://" not in output else None
    for name, rows in tables.items():
        _csv(rows, f"{output}/{name}.csv")
