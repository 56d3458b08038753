"""A corpus pipeline of the operators in ``weftline.llm``: quality, line deduplication, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import lines, mixing, nearcopies, packing, quality
from weftline.llm.common import Scratch


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fit on the labelled ones, doesn't reject."""
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that at least three of them share, but for the one that keeps a line."""
    kept = lines.dedup_lines(spark, docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles of Jaccard similarity 0.8 or more, over any number of links."""
    return nearcopies.drop_near_copies(spark, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take_copies(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.op1_packing(spark, docs)


STAGES = [
    ("quality", good_documents),
    ("lines", unrepeated_lines),
    ("near_copies", one_of_near_copies),
    ("mix", mixed),
    ("pack", packed),
]

#: The stages train a model and search for near copies, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of all of documents; each stage's result is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.table(docs)
    return docs
