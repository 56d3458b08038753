"""Guards over streams: a stream of N-Triples files, matched micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.model import Component
from weftline.operators.explore import matches
from weftline.sources.rdf import ntriples_rows


def stream_ntriples(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Triples of files as they arrive in the folder; graph_id is the file."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return ntriples_rows(lines.select(F.col("_metadata.file_path").alias("graph_id"), "value"), strict=False)


def match_stream(triples: DataFrame, components: list[Component], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Gives sink(graph_id and iri of the components that fit, batch number) for each batch of whole files. A batch that is redone has the same number, so a sink that overwrites by it has each result once."""

    def one(batch: DataFrame, number: int) -> None:
        sink(matches(batch, components).select("graph_id", "iri"), number)

    return triples.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
