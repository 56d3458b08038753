"""The subpackage's registered queries, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import langid, lines, media, mixing, packing, quality, simhash, sketch, suffixes, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op1_packing(spark, _table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op2_simhash(spark, _table(spark, sf_dir, "documents"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.op3_substrings(spark, _table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op4_language(_table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op5_media(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op6_quality(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.op7_lines(spark, _table(spark, sf_dir, "documents"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.op8_fingerprint(spark, _table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.op9_urls(spark, _table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op10_mixing(spark, _table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_substrings": op3_substrings,
    "op4_language": op4_language,
    "op5_media": op5_media,
    "op6_quality": op6_quality,
    "op7_lines": op7_lines,
    "op8_fingerprint": op8_fingerprint,
    "op9_urls": op9_urls,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL: dict[str, str] = {"op7_lines": lines.OP7_SQL}
