"""Where intermediate and finished tables live, and how lineage is cut between levels.

The shared folder is ``spark.checkpoint.dir``, else the warehouse. What is written there for a run goes with the
application.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of which one task may hold the different ones; parts up to which the writer of a shuffle keeps no rows in memory.
TASK_ROWS, MOST_PARTS = 250_000, 200

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/")


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def run_folder(spark: SparkSession) -> str:
    """A folder of this application below the shared one, deleted at its end."""
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = f"{shared_folder(spark)}/weftline/{key}-{uuid.uuid4().hex}"
        at, system = _system(spark, _own[key])
        system.mkdirs(at)
        system.deleteOnExit(at)
    return _own[key]


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, so that neither a long lineage nor a lost executor recomputes them."""
    path = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def distinct(rows: DataFrame, n: int) -> DataFrame:
    """The different rows of about n. Many are dealt out before they are compared: a task that reads a file has whole row groups, and would hold all that comes of them."""
    parts = min(n // TASK_ROWS + 1, MOST_PARTS)
    return (rows.repartition(parts, *rows.columns) if parts > 1 else rows).distinct()


def delete(spark: SparkSession, path: str) -> None:
    at, system = _system(spark, path)
    system.delete(at, True)


def replace(spark: SparkSession, new: str, old: str) -> None:
    """Puts the folder ``new`` in the place of ``old``."""
    delete(spark, old)
    at, system = _system(spark, new)
    if not system.rename(at, _system(spark, old)[0]):
        raise OSError(f"can't rename {new} to {old}")


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _system(spark, path)
    return system.exists(at)


class SampleStore:
    """Graphs by (grp, graph_id), grp being ROOT, FILTER or NODE; a store decides how Spark holds them.

    Every entry is written to the shared folder. files reads it from there each time; memory, disk and memory-disk
    also keep its blocks at that storage level. Spark's memory manager moves blocks between the tiers, so no
    thresholds are needed, and a lost block is read again.
    """

    LEVELS = {"memory": StorageLevel.MEMORY_ONLY, "disk": StorageLevel.DISK_ONLY, "memory-disk": StorageLevel.MEMORY_AND_DISK, "files": None}

    def __init__(self, spark: SparkSession, kind: str = "files"):
        if kind not in self.LEVELS:
            raise ValueError(f"unknown store {kind!r}")
        self.spark, self.kind = spark, kind
        self.frames: list[tuple[str, DataFrame]] = []

    def add(self, triples: DataFrame, group: str) -> DataFrame:
        """The same triples, as they are held."""
        level = self.LEVELS[self.kind]
        held = cut(triples)
        if level is not None:
            held = held.persist(level)
        self.frames.append((group, held))
        return held

    def all(self) -> DataFrame:
        """grp, graph_id and the triples of all entries."""
        out = [f.withColumn("grp", F.lit(group)) for group, f in self.frames]
        if not out:
            raise ValueError("the store is empty")
        rows = out[0]
        for f in out[1:]:
            rows = rows.unionByName(f)
        return rows

    def load(self, graph_id: str) -> DataFrame:
        return self.all().where(F.col("graph_id") == graph_id).drop("grp")

    def sizes(self) -> DataFrame:
        """grp, graph_id, n: statements stored."""
        return self.all().groupBy("grp", "graph_id").agg(F.count(F.lit(1)).alias("n"))

    def remove_all(self, group: str | None = None) -> None:
        for name, f in self.frames:
            if group in (None, name):
                f.unpersist()
        self.frames = [x for x in self.frames if group not in (None, x[0])]


def dictionary_encode(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values: id, kind, lex, dt, lang; triples: graph_id, s, p, o as ids).

    Ids are dense and in term order: ranks within hash ranges of terms, shifted by the ranges' sizes.
    """
    from weftline.functions import terms as t

    every = triples.select(t.subject().alias("x")).unionByName(triples.select(t.predicate().alias("x"))).unionByName(triples.select(t.object_().alias("x"))).distinct()
    parts = cut(every.repartitionByRange("x").withColumn("part", F.spark_partition_id()))
    from pyspark.sql import Window

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("x"))
    coded = cut(parts.join(starts, "part").select((rank + F.col("start")).cast("long").alias("id"), "x"))
    values = coded.select("id", "x.kind", "x.lex", "x.dt", "x.lang")
    out = triples.select("graph_id", t.subject().alias("s"), t.predicate().alias("p"), t.object_().alias("o"))
    for c in "spo":
        out = out.join(coded.select(F.col("x").alias(c), F.col("id").alias(c + "_id")), c).drop(c)
    return values, out.select("graph_id", F.col("s_id").alias("s"), F.col("p_id").alias("p"), F.col("o_id").alias("o"))


def dictionary_decode(values: DataFrame, coded: DataFrame) -> DataFrame:
    """The triples back from ids."""
    out = coded
    for c in "spo":
        v = values.select(F.col("id").alias(c), F.struct("kind", "lex", "dt", "lang").alias(c + "_t"))
        out = out.join(v, c)
    s, p, o = (F.col(c + "_t") for c in "spo")
    return out.select("graph_id", s.kind.alias("s_kind"), s.lex.alias("s"), p.lex.alias("p"), o.kind.alias("o_kind"), o.lex.alias("o"), o.dt.alias("o_dt"), o.lang.alias("o_lang"))
