"""Saving and resuming runs: parquet tables under one folder, and a marker when a run is finished."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .explore import Result
from .storage import exists, replace

FINISHED = "finished"


def save_run(result: Result, path: str) -> None:
    """nodes, graphs, queue, levels, timers and the filter's state, with ``finished`` beside them if nothing waits.

    All is written aside and then put in the place of what is there, so a run may be saved over the one it goes on from.
    """
    spark = result.nodes.sparkSession
    new = f"{path}-{uuid.uuid4().hex}"
    result.nodes.write.parquet(f"{new}/nodes")
    grp = F.when(F.col("graph_id").endswith("root"), "ROOT").otherwise("NODE")
    result.graphs.withColumn("grp", grp).write.partitionBy("grp").parquet(f"{new}/statements")
    if result.queue is not None:
        result.queue.write.parquet(f"{new}/queue")
    levels = spark.createDataFrame(result.levels or [], "level int, start_nodes long, duration_ms long")
    levels.coalesce(1).write.json(f"{new}/levels")
    spark.createDataFrame(list(result.timers.items()), "name string, ms long").coalesce(1).write.json(f"{new}/timers")
    filter_state(result.nodes).write.json(f"{new}/filter")
    spark.createDataFrame([(result.reason,)], "reason string").coalesce(1).write.json(f"{new}/{FINISHED if result.reason == 'done' else 'unfinished'}")
    replace(spark, new, path)


def filter_state(nodes: DataFrame) -> DataFrame:
    """run_id, node_id, fp: the states that a filter compares new ones with."""
    return nodes.where("expanded and not redundant and fp is not null").select("run_id", "node_id", "fp")


def is_finished(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/{FINISHED}")


def load_run(spark: SparkSession, path: str) -> Result:
    """An unfinished run to go on from, or a finished one's tables."""
    nodes = spark.read.parquet(f"{path}/nodes")
    graphs = spark.read.parquet(f"{path}/statements").drop("grp")
    queue = spark.read.parquet(f"{path}/queue") if exists(spark, f"{path}/queue") else None
    levels = [tuple(r) for r in spark.read.schema("level int, start_nodes long, duration_ms long").json(f"{path}/levels").orderBy("level").collect()]
    reason = "done" if is_finished(spark, path) else spark.read.schema("reason string").json(f"{path}/unfinished").first()[0]
    timers = {r.name: r.ms for r in spark.read.schema("name string, ms long").json(f"{path}/timers").collect()}  # a row for each phase
    return Result(nodes, graphs, levels, reason, timers, queue)


def load_finished_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The nodes only, without samples."""
    return spark.read.parquet(f"{path}/nodes")
