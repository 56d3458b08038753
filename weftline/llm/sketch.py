"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k least 64-bit hashes of a text's word shingles (five words, lower-cased A-Z; a
text of fewer words is one shingle, one without words has none). The sketch of a union is the k least
of both sketches' hashes, so parts can be sketched anywhere and merged. Two sketches estimate
resemblance (the share of the union's k least hashes that both have), each one's distinct shingles, and
containment.

Defined cases: a null text is empty; empty sketches resemble each other fully and nothing else; equal
texts have equal sketches; columns of the input are kept, and a taken name gets an underscore.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_width, spare_name, tidy
from .words import WORDS, shingle_hashes

K = 128
#: Bytes of a range of documents, and the ranges that an approximate percentile can tell apart.
RANGE, MOST_RANGES = 16 << 20, 9_000
_FULL = float(1 << 64)


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k least distinct hashes, ascending."""
    if len(hashes) > 16 * k:  # few are left that can be among them, unless most are equal
        least = np.unique(hashes[hashes <= np.partition(hashes, 8 * k)[8 * k]])
        if len(least) >= k:
            return least[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate([a, b]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = merge(a, b, k)
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """The estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / _FULL)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    if len(a) < k and len(b) < k:
        return float(np.isin(a, b).mean())
    r = resemblance(a, b, k)
    common = r * distinct(merge(a, b, k), k)
    return min(1.0, common / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(x: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(x), "<u8")


def sketch(text: str | None, k: int = K, words: int = WORDS) -> np.ndarray:
    return bottom(shingle_hashes((text or "").encode(), words), k)


def with_sketch(df: DataFrame, column: str = "text", name: str = "sketch", k: int = K, words: int = WORDS) -> DataFrame:
    """The input's columns and each text's sketch, as base64 of little-endian 64-bit hashes."""
    name = spare_name(df.columns, name)

    @F.pandas_udf(T.StringType())
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: to_text(sketch(t, k, words)))

    return df.withColumn(name, made(F.col(column).cast("string")))


def merge_sketches(df: DataFrame, keys: list[str], column: str = "sketch", k: int = K, salts: int = 64) -> DataFrame:
    """keys, sketch, distinct: each group's merged sketch; a group of any size is merged in ``salts`` parts first."""
    kinds = df.select(*keys).schema
    salt = spare_name(df.columns, "salt")

    schema = T.StructType([*kinds.fields, T.StructField("sketch", T.StringType()), T.StructField("distinct", T.DoubleType())])
    # equal sketches add nothing; the others are dealt by a hash, and each part keeps one sketch while its rows stream by
    salted = df.select(*keys, F.col(column)).distinct().withColumn(salt, F.pmod(F.xxhash64(F.col(column)), F.lit(salts)))
    first = _streamed(salted, keys, [*keys, salt], column, k)
    return _streamed(first, keys, keys, "sketch", k).withColumn("distinct", _distinct_of(k)("sketch")).select(schema.fieldNames())


def _streamed(rows: DataFrame, keys: list[str], by: list[str], column: str, k: int) -> DataFrame:
    """keys, sketch: the merged sketch of each group of equal ``by``, of which only one sketch is held at a time."""
    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("sketch", T.StringType())])
    n = len(keys)

    def run(batches):
        now, total = None, np.zeros(0, np.uint64)
        made: list[tuple] = []

        def out() -> pa.RecordBatch:
            found = [pa.array([m[i] for m in made], f.type) for i, f in enumerate(arrow)]
            made.clear()
            return pa.RecordBatch.from_arrays(found, schema=arrow)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:-1] != now:
                    if now is not None:
                        made.append((*now[:n], to_text(total)))
                    now, total = row[:-1], np.zeros(0, np.uint64)
                if row[-1] is not None:
                    total = merge(total, from_text(row[-1]), k)
            if len(made) > 500:
                yield out()
        if now is not None:
            made.append((*now[:n], to_text(total)))
        if made:
            yield out()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return rows.select(*by, column).repartition(*by).sortWithinPartitions(*by).mapInArrow(tidy(run), schema)


def _distinct_of(k: int):
    @F.pandas_udf(T.DoubleType())
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: distinct(from_text(x), k))

    return found


def _ranges(documents: DataFrame, parts: int) -> tuple[list[int], bool]:
    """Ids, all of them there, at which ranges of about equal numbers of rows begin, and whether an id is null (those come first)."""
    at = [i / parts for i in range(1, parts)]
    got = documents.agg(F.min("doc_id"), F.percentile_approx("doc_id", F.array(*map(F.lit, at)), 10_000) if at else F.lit(None), F.max(F.col("doc_id").isNull())).first()
    if got[0] is None:
        return [], bool(got[2])
    return sorted({got[0], *(got[1] or [])}), bool(got[2])


def with_next(documents: DataFrame, make: callable, schema: T.StructType) -> DataFrame:
    """Rows that ``make(doc_id, text, next text, remembered)`` gives for each document and the next one by ascending id.

    The order is global: null ids first, equal ids by text, after the last the first. The documents are
    dealt by ranges of ids in one shuffle, and a copy of each range's first document goes to the range
    before. ``remembered`` is a dict for values of a text that the next call wants again.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # about RANGE bytes of the input's files for each range, and no fewer ranges than shuffles have partitions
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # arrives as an int or as an object of the JVM
    parts = max(shuffle_width(documents.sparkSession), min(size // RANGE, MOST_RANGES) if size < 1 << 60 else 0)  # beyond: not known
    cuts, nulls = _ranges(rows, parts)
    n = max(1, len(cuts))
    starts = np.array(cuts, np.int64)

    @F.pandas_udf("array<struct<b:long,tail:boolean>>")
    def places(ids: pd.Series) -> pd.Series:
        null = ids.isna().to_numpy()
        v = ids.fillna(0).astype("int64").to_numpy()
        b = np.where(null, 0, np.maximum(np.searchsorted(starts, v, side="right") - 1, 0) if len(starts) else 0)
        first = np.where(null, True, (starts[b] == v) & ~((b == 0) & nulls) if len(starts) else False)
        return pd.Series([[{"b": int(x), "tail": False}] + ([{"b": int((x - 1) % n), "tail": True}] if f else []) for x, f in zip(b, first, strict=True)])

    dealt = rows.withColumn("at", F.explode(places("doc_id"))).select("at.b", "at.tail", "doc_id", "text")
    dealt = dealt.repartitionById(n, F.col("b").cast("int")).sortWithinPartitions("b", "tail", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        held, kept = None, {}
        for whole in batches:
            for batch in (whole.slice(i, 200) for i in range(0, whole.num_rows, 200)):
                out = []
                for b, tail, d, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held is not None and held[0] == b:
                        out.append(make(held[1], held[2], text, kept))
                    held = None if tail else (b, d, text)
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.fieldNames(), r, strict=True)) for r in out], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return dealt.mapInArrow(tidy(run), schema)


OP8 = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
        T.StructField("distinct_shingles", T.DoubleType()),
        T.StructField("contained_in_edited", T.DoubleType()),
    ]
)


def _op8_row(doc_id: int | None, text: str, following: str, kept: dict) -> tuple:
    own = kept.pop("own") if kept.get("of") is text or kept.get("of") == text else sketch(text)
    after = sketch(following)
    kept["of"], kept["own"] = following, after
    n = len(text)
    edited = text[: n - n // 4] + following[: n // 4]
    of_edited = sketch(edited)
    digest = hashlib.sha256(edited.encode()).hexdigest()
    return doc_id, n, digest, to_text(own), to_text(of_edited), resemblance(own, of_edited), resemblance(own, after), distinct(own), containment(own, of_edited)


def op8_fingerprint(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return with_next(documents, _op8_row, OP8)
