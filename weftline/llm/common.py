"""Shared storage for intermediate tables, and helpers over UTF-8 text columns."""

from __future__ import annotations

import ctypes
import gc
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separator of every contract: space and \t to \r.
ASCII_SPACE = b" \t\n\x0b\x0c\r"

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the warehouse."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` removes one that is no longer read, the end of the application all."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/weftline/{tag}-{uuid.uuid4().hex}"
        self.n = 0
        at = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(at)
        system.deleteOnExit(at)

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def write(self, df: DataFrame, partition_by: str | None = None) -> tuple[DataFrame, str]:
        path = self.path()
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        schema = df.schema
        return self.spark.read.schema(schema).parquet(path), path

    def table(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, *paths: str) -> None:
        for path in paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def tidy(run: Callable) -> Callable:
    """The same function over batches; when a task's batches are through, the worker gives freed memory back, as it waits for other tasks beside a full executor."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


#: Slots of a slot table, and slots in each of its rows: 2^27 bits, 16 MB whatever the number of keys.
SLOT_BITS, ROW_BITS = 27, 15


def slots(keys: DataFrame, mark: str) -> DataFrame:
    """slot_row, slot_bits: which of 2^27 slots the hashes in ``mark`` fall into. Of bounded size, so it may be broadcast."""
    at = F.pmod(F.col(mark), F.lit(1 << SLOT_BITS))
    placed = keys.select(F.shiftright(at, ROW_BITS).alias("slot_row"), at.bitwiseAND((1 << ROW_BITS) - 1).alias("place"))
    return placed.distinct().repartition("slot_row").groupBy("slot_row").agg(F.bitmap_construct_agg("place").alias("slot_bits"))


def with_slot(rows: DataFrame, mark: Column, found: DataFrame, name: str) -> DataFrame:
    """The rows with ``name``: whether the hash's slot is taken. Rows whose slot is free have none of the keys, so they need no shuffle to be told apart from those that may."""
    at = F.pmod(mark, F.lit(1 << SLOT_BITS))
    row, place = F.shiftright(at, ROW_BITS), at.bitwiseAND((1 << ROW_BITS) - 1).cast("int")
    names = rows.columns
    own, bits = spare_name(names, "slot_row"), spare_name(names, "slot_bits")
    table = F.broadcast(found.select(F.col("slot_row").alias(own), F.col("slot_bits").alias(bits)))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    taken = (F.call_function("shiftright", byte, place.bitwiseAND(7)).bitwiseAND(1) == 1)
    return rows.join(table, row == F.col(own), "left").select(*[F.col(f"`{c}`") for c in names], F.coalesce(taken, F.lit(False)).alias(name))


def repeats_ids(documents: DataFrame) -> bool:
    """Whether several rows share an id, or have none."""
    return documents.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def crc_mod_py(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def text_column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The column's bytes as one array, the n + 1 offsets into it, and which rows are null (those are empty)."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64), np.ones(len(col), bool)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    null = np.asarray(col.is_null(nan_is_null=False).to_numpy(zero_copy_only=False), dtype=bool)
    if null.any():
        col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return data[lo:hi], offsets - lo, null


def spans(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows of about ``limit`` bytes together; a longer row comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def column_or_null(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def spare_name(taken: list[str], stem: str) -> str:
    """``stem``, with underscores added until no column has that name (case-blind, as Spark compares)."""
    have = {x.lower() for x in taken}
    while stem.lower() in have:
        stem += "_"
    return stem
