"""Line deduplication with levelled sorted runs of line hashes.

The runs hold 128-bit hashes of line keys, sorted and bucketed alike, so that a batch is merged with
each of them without moving them. A new batch is anti-joined with the runs to tell the lines it brings
first from those that the runs know, and becomes a run of its own on the lowest level; when a level has
``fanout`` runs they are compacted into one of the next. Batches come with descending ids, so the batch
that brings a line first also has the document that keeps it; later ones only add to its count.

A line's key is the line without ASCII white space at its ends, with A-Z lower-cased. Keys of at least
``min_chars`` code points that ``min_documents`` documents hold lose their lines in all of them but the
one of the largest id.

Defined cases: a null text stays null and counts as one empty line; rows that share an id count as one
document, and what the id keeps, all of them keep; rows without an id count as one document too, the
smallest; other columns are carried along, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, repeats_ids, shuffle_width, spare_name, tidy
from .simhash import text_mark

KEY = ["h1", "h2"]


def line_keys(lines: list[bytes], min_chars: int) -> list[bytes | None]:
    """Each line's hash, or null where its key is too short to count."""
    out = []
    for line in lines:
        k = line.strip().lower()
        long = len(k) >= min_chars and (len(k) >= 4 * min_chars or k.isascii() or len(k.decode()) >= min_chars)
        out.append(xxhash.xxh3_128_digest(k) if long else None)
    return out


def keys(documents: DataFrame, min_chars: int = 20) -> DataFrame:
    """h1, h2, doc_id, mark: the distinct keys of each row of (doc_id, mark, text)."""

    def run(batches):
        for b in batches:
            found, of = [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                if t:
                    here = {h for h in line_keys(t.encode().split(b"\n"), min_chars) if h is not None}
                    found.extend(here)
                    of.extend([i] * len(here))
            pairs = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), b.column(0).take(at), b.column(1).take(at)], names=["h1", "h2", "doc_id", "mark"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "mark", F.col("text").cast("string")).mapInArrow(tidy(run), "h1 long, h2 long, doc_id long, mark long")


class LineRuns:
    """The levels of runs: rows (h1, h2, docs, keeper), bucketed and sorted by hash, in the shared folder."""

    def __init__(self, spark: SparkSession, scratch: Scratch, fanout: int = 2, buckets: int | None = None, shared_ids: bool = False):
        """shared_ids: whether rows of a batch may have an id in common, which is a document then."""
        self.spark, self.scratch, self.fanout, self.shared_ids = spark, scratch, fanout, shared_ids
        self.buckets = buckets or shuffle_width(spark)
        self.levels: list[list[tuple[str, str]]] = [[]]

    def _save(self, rows: DataFrame) -> tuple[str, str]:
        name, path = f"weftline_run_{uuid.uuid4().hex}", self.scratch.path()
        dealt = rows.repartition(self.buckets, *KEY).sortWithinPartitions(*KEY)
        dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).option("compression", "zstd").saveAsTable(name)
        return name, path

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def ingest(self, batch: DataFrame) -> None:
        """Adds a batch of (h1, h2, doc_id), its ids below those of earlier batches."""
        docs = F.count_distinct(F.struct("doc_id")) if self.shared_ids else F.count(F.lit(1))
        own = batch.groupBy(*KEY).agg(docs.alias("docs"), F.max("doc_id").alias("keeper"))
        known = F.lit(False)
        for i, run in enumerate(self.runs()):
            own = own.join(run.select(*KEY, F.lit(True).alias(f"in{i}")), KEY, "left")
            known = known | F.col(f"in{i}").isNotNull()
        # what no run knows is new with this batch, which has its keeper; the rest only adds to the counts
        rows = own.select(*KEY, "docs", F.when(~known, F.col("keeper")).alias("keeper"), (~known).alias("first"))
        self.levels[0].append(self._save(rows))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._save(self._merged([path for _, path in old])))
            self._drop(old)
            level += 1

    def _merged(self, paths: list[str]) -> DataFrame:
        # read as plain files: a union of bucketed tables is not bucketed itself, whatever the planner makes of it
        rows = self.spark.read.schema("h1 long, h2 long, docs long, keeper long, first boolean").parquet(*paths)
        return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"), F.max("first").alias("first"))

    def _drop(self, old: list[tuple[str, str]]) -> None:
        for name, path in old:
            self.spark.sql(f"DROP TABLE {name}")
            self.scratch.drop(path)

    def repeated(self, min_documents: int) -> DataFrame:
        """h1, h2, keeper of the keys that at least so many documents hold."""
        return self._merged([path for level in self.levels for _, path in level]).where(F.col("docs") >= min_documents).select(*KEY, "keeper")

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = [[]]


def dedup_lines(spark: SparkSession, documents: DataFrame, min_chars: int = 20, min_documents: int = 3, batches: int = 3, fanout: int = 2) -> DataFrame:
    """The input's columns, ``text`` without the repeated lines, and n_lines and n_dropped (underscored where taken)."""
    scratch = Scratch(spark, "lines")
    cuts = documents.agg(F.percentile_approx(F.col("doc_id").cast("long"), F.array(*[F.lit(i / batches) for i in range(1, batches)]), 1000)).first()[0] or []
    number = F.lit(len(cuts))
    for i, c in enumerate(sorted(cuts, reverse=True)):
        number = F.when((F.col("doc_id") > c) & (number == len(cuts)), i).otherwise(number)
    twice = repeats_ids(documents)
    # a row's lines are found again by its id, and where rows share it, by the text's hash too
    mark = text_mark() if twice else F.lit(0).cast("long")
    marked = documents.select("doc_id", mark.alias("mark"), "text")
    found, found_at = scratch.write(keys(marked, min_chars).withColumn("batch", F.coalesce(number, F.lit(len(cuts))).cast("int")), partition_by="batch")
    runs = LineRuns(spark, scratch, fanout, shared_ids=twice)
    for i in range(len(cuts) + 1):
        runs.ingest(found.where(F.col("batch") == i))
    repeated, repeated_at = scratch.write(runs.repeated(min_documents))
    runs.close()
    names = documents.columns
    n_lines = spare_name(names, "n_lines")
    n_dropped = spare_name([*names, n_lines], "n_dropped")
    own, drops, of, of_mark = (spare_name(names, x) for x in ("own", "drops", "of", "of_mark"))
    # joins by sort at any size: lists that follow the input are not broadcast while they happen to be small
    hit = found.join(repeated.hint("merge"), KEY).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # a text's own lines only, so the lists are as bounded as the texts
    lists = hit.groupBy(F.col("doc_id").alias(of), F.col("mark").alias(of_mark)).agg(F.collect_set(F.struct(*KEY)).alias(drops))
    lists = scratch.table(lists)
    scratch.drop(found_at, repeated_at)
    rows = documents.withColumn("text", F.col("text").cast("string"))
    mine = F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.col(own) == F.col(of_mark))
    joined = rows.withColumn(own, mark).join(lists.hint("merge"), mine, "left").select(*names, drops)
    schema = T.StructType([*rows.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    at = names.index("text")

    def run(parts):
        for whole in parts:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                texts, lines_, dropped = b.column(at).to_pylist(), [], []
                for i, (t, drops) in enumerate(zip(texts, b.column(len(names)).to_pylist(), strict=True)):
                    n, lost = 1 + (t or "").count("\n"), 0
                    if t and drops:
                        gone = {np.array([d["h1"], d["h2"]], "<i8").tobytes() for d in drops}
                        each = t.encode().split(b"\n")
                        kept = [x for x, k in zip(each, line_keys(each, min_chars), strict=True) if k not in gone]
                        lost = n - len(kept)
                        texts[i] = b"\n".join(kept).decode()
                    lines_.append(n)
                    dropped.append(lost)
                columns = [*b.columns[: len(names)], pa.array(lines_, pa.int64()), pa.array(dropped, pa.int64())]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return joined.mapInArrow(tidy(run), schema)


def op7_lines(spark: SparkSession, documents: DataFrame) -> DataFrame:
    kept = dedup_lines(spark, documents.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 3
), marked AS (
  SELECT d.doc_id, d.i, d.line, (h.k IS NOT NULL AND d.doc_id IS DISTINCT FROM h.keeper) AS gone
  FROM keyed d LEFT JOIN hot h ON d.k = h.k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
