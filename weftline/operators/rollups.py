"""Roll-ups of many runs: what applications, datasets and definitions amount to.

Inputs are runs(definition, run_id, path, dataset, endpoint, dataset_label, duration_ms), pipelines
(definition, run_id, application, transformers), applications(definition, application,
application_label), transformers(definition, transformer) and nodes with definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = ["definition", "run_id"]


def by_application(runs: DataFrame, pipelines: DataFrame, applications: DataFrame) -> DataFrame:
    """definition, application, application_label, datasets, pipelines: all applications, those without a pipeline too."""
    used = pipelines.join(runs.select(*RUN, "dataset"), RUN).groupBy("definition", "application").agg(F.countDistinct("dataset").alias("datasets"), F.count(F.lit(1)).alias("pipelines"))
    return applications.join(used, ["definition", "application"], "left").select("definition", "application", "application_label", F.coalesce("datasets", F.lit(0)).cast("long").alias("datasets"), F.coalesce("pipelines", F.lit(0)).cast("long").alias("pipelines"))


def by_dataset_application(runs: DataFrame, pipelines: DataFrame, applications: DataFrame) -> DataFrame:
    """One row for each run and application that fits: path, dataset, endpoint, application, definition, labels, pipelines."""
    found = pipelines.groupBy(*RUN, "application").agg(F.count(F.lit(1)).alias("pipelines"))
    rows = found.join(runs, RUN).join(applications, ["definition", "application"])
    return rows.select("path", "dataset", "endpoint", "application", "definition", "dataset_label", "application_label", "pipelines")


def by_dataset(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """One row a run: path, dataset, endpoint, definition, dataset_label, pipelines, applications."""
    found = pipelines.groupBy(*RUN).agg(F.count(F.lit(1)).alias("pipelines"), F.countDistinct("application").alias("applications"))
    rows = runs.join(found, RUN, "left").na.fill(0, ["pipelines", "applications"])
    return rows.select("path", "dataset", "endpoint", "definition", "dataset_label", "pipelines", "applications")


def by_definition(runs: DataFrame, pipelines: DataFrame, applications: DataFrame, transformers: DataFrame, nodes: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """One row a definition: pipelines, durations, and available, used and used-in-pipeline counts.

    Used transformers are those of any expanded node, redundant ones too; used datasets those where
    any component fit; seconds are summed as whole ones of each run. total: definition, total_ms.
    """
    expanded = nodes.where("expanded")
    runs_ = runs.groupBy("definition").agg(F.countDistinct("dataset").alias("datasets"), F.sum(F.floor(F.col("duration_ms") / 1000)).cast("long").alias("exploration_seconds"))
    pipes = pipelines.groupBy("definition").agg(F.count(F.lit(1)).alias("pipelines"), F.countDistinct("application").alias("applications_in_pipelines"), F.countDistinct("run_id").alias("datasets_in_pipelines"))
    steps = pipelines.select("definition", F.explode("transformers").alias("t")).groupBy("definition").agg(F.countDistinct("t").alias("transformers_in_pipelines"))
    fits = expanded.groupBy("definition").agg(F.countDistinct("transformer").alias("transformers_used"), F.size(F.array_distinct(F.flatten(F.collect_set("applications")))).cast("long").alias("applications_used"))
    active = expanded.where("transformer is not null or size(applications) > 0").groupBy("definition").agg(F.countDistinct("run_id").alias("datasets_used"))
    apps = applications.groupBy("definition").agg(F.countDistinct("application").alias("applications"))
    trans = transformers.groupBy("definition").agg(F.countDistinct("transformer").alias("transformers"))
    out = runs_
    for x in (pipes, steps, fits, active, apps, trans):
        out = out.join(x, "definition", "left")
    if total is not None:
        out = out.join(total.groupBy("definition").agg(F.max("total_ms").alias("total_ms")), "definition", "left")
    else:
        out = out.withColumn("total_ms", F.lit(None).cast("long"))
    counts = ["pipelines", "applications", "applications_used", "applications_in_pipelines", "datasets", "datasets_used", "datasets_in_pipelines", "transformers", "transformers_used", "transformers_in_pipelines"]
    return out.na.fill(0, counts).select("definition", *counts, "exploration_seconds", F.floor(F.col("total_ms") / 1000).cast("long").alias("total_seconds"))
