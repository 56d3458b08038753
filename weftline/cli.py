"""Command line: explore one definition, or all of an experiment.

    python -m weftline.cli --definition FILE-OR-URL --vocabulary FILE [options]
    python -m weftline.cli --experiment FILE-OR-URL --vocabulary FILE [options]

The vocabulary is a JSON file that names the IRIs of the definitions; see weftline.model.Vocabulary.
"""

from __future__ import annotations

import argparse
import time
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.model import DEFAULTS, Settings, Vocabulary
from weftline.operators import pipelines as P
from weftline.operators import rollups
from weftline.operators.checkpoint import is_finished, load_run, save_run
from weftline.operators.explore import NodeTimeLimit, Result, TimeLimit, explore, root_graphs
from weftline.operators.export import export_run, shared_time, write_experiment
from weftline.operators.prune import shake_non_expanded, shake_redundant
from weftline.operators.storage import SampleStore, exists
from weftline.sources.definitions import load_definition, load_experiment, report_issues
from weftline.sources.rdf import UrlCache
from weftline.sources.turtle import RdfError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("-d", "--definition", help="definition to explore")
    what.add_argument("-e", "--experiment", help="experiment: a list of definitions")
    p.add_argument("-v", "--vocabulary", required=True, help="JSON file with the IRIs that the definitions use")
    p.add_argument("-o", "--output", help="output folder")
    p.add_argument("--level-limit", type=int, help="levels to explore; -1: all")
    p.add_argument("--time-limit", type=int, help="minutes; -1: none")
    p.add_argument("--node-time-limit", type=int, help="seconds that the nodes of a level may take on average; -1: any")
    p.add_argument("--filter", choices=("diff", "isomorphic", "none"))
    p.add_argument("--store", choices=("memory", "disk", "memory-disk", "files"))
    p.add_argument("--use-mapping", action="store_true", default=None, help="accepted; values need no interning here")
    p.add_argument("--resume", action="store_true", default=None, help="go on from what the output folder holds")
    p.add_argument("--strong-groups", action="store_true", default=None)
    p.add_argument("--url-cache", help="folder that keeps fetched documents")
    return p


def settings_from(args: argparse.Namespace) -> Settings:
    return Settings(args.level_limit, args.output, args.filter, args.use_mapping, args.store, args.resume, args.time_limit, args.strong_groups, args.url_cache, args.node_time_limit)


def run_definition(spark: SparkSession, url: str, vocabulary: Vocabulary, settings: Settings, output: str | None = None) -> dict[str, DataFrame]:
    """Explores all datasets of a definition in one batch, exports, and gives the tables that roll-ups want."""
    began = time.monotonic()
    definition = load_definition(url, vocabulary, UrlCache(settings.url_cache))
    s = settings.merged(definition.settings).merged(DEFAULTS)
    target = output or s.output
    report_issues(definition.issues, target)
    roots = root_graphs(spark, definition.datasets)
    ids = [(f"{i:03d}", d.iri, d.label, d.endpoint()) for i, d in enumerate(definition.datasets)]
    runs = spark.createDataFrame(ids, "run_id string, dataset string, dataset_label string, endpoint string")
    listeners = [TimeLimit(60 * s.time_limit_minutes)] if s.time_limit_minutes >= 0 else []
    listeners += [NodeTimeLimit(s.node_time_limit_seconds)] if s.node_time_limit_seconds >= 0 else []
    saved = f"{target}/resume-data"
    before = load_run(spark, saved) if s.resume and exists(spark, saved) else None
    store = SampleStore(spark, s.store)
    if before is None or not is_finished(spark, saved):
        groups = definition.groups if s.use_strong_groups else None
        save_run(explore(roots, definition.applications, definition.transformers, s.filter, s.level_limit, groups, runs=runs, listeners=listeners, resume=before, store=store), saved)
        store.remove_all()
    result = load_run(spark, saved)
    shaken = Result(shake_redundant(shake_non_expanded(result.nodes)), result.graphs, result.levels, result.reason, result.timers)
    components = [*definition.applications, *definition.transformers]
    export_run(shaken, definition.applications, components, runs.select("run_id", "dataset", "dataset_label"), target, definition.groups)
    ms = int(1000 * (time.monotonic() - began))
    named = lambda df: df.withColumn("definition", F.lit(url))
    times = shared_time(result.nodes, result.levels).groupBy("run_id").agg(F.sum("duration").alias("duration_ms"))
    return {
        "runs": named(runs.join(times, "run_id", "left").na.fill(0, ["duration_ms"])).withColumn("path", F.concat(F.lit("run_"), "run_id")),
        "pipelines": named(P.pipelines(shaken.nodes)),
        "nodes": named(result.nodes),
        "applications": named(spark.createDataFrame([(a.iri, a.label) for a in definition.applications], "application string, application_label string")),
        "transformers": named(spark.createDataFrame([(x.iri,) for x in definition.transformers], "transformer string")),
        "total": spark.createDataFrame([(url, ms)], "definition string, total_ms long"),
    }


def run_experiment(spark: SparkSession, url: str, vocabulary: Vocabulary, settings: Settings) -> dict[str, DataFrame]:
    """Every definition of an experiment, each below its own numbered folder, and the roll-ups over all."""
    experiment = load_experiment(url, vocabulary, UrlCache(settings.url_cache))
    output = settings.merged(experiment.settings).merged(DEFAULTS).output
    parts = [run_definition(spark, x, vocabulary, replace(settings, output=None), f"{output}/{i:03d}") for i, x in enumerate(experiment.definitions)]
    if not parts:
        raise RdfError(f"{url}: no definition")
    tables = {k: reduce(DataFrame.unionByName, [p[k] for p in parts]) for k in parts[0]}
    made = {
        "application-definition": rollups.by_application(tables["runs"], tables["pipelines"], tables["applications"]),
        "dataset-application-definition": rollups.by_dataset_application(tables["runs"], tables["pipelines"], tables["applications"]),
        "definition-dataset": rollups.by_dataset(tables["runs"], tables["pipelines"]),
        "definition": rollups.by_definition(tables["runs"], tables["pipelines"], tables["applications"], tables["transformers"], tables["nodes"], tables["total"]),
    }
    write_experiment(made, output)
    return made


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("weftline").getOrCreate()
    vocabulary, settings = Vocabulary.read(args.vocabulary), settings_from(args)
    if args.definition:
        run_definition(spark, args.definition, vocabulary, settings)
    else:
        run_experiment(spark, args.experiment, vocabulary, settings)


if __name__ == "__main__":
    main()
