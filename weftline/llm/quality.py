"""Quality classifier: random Fourier features, ridge from partition-summed normal equations, isotonic calibration.

Each text becomes a vector of document statistics (shares of kinds of characters, word and line
shapes, repetition). Random Fourier features approximate a Gaussian kernel over the standardised
statistics. Every task adds up the normal equations of its labelled rows, so the fit gathers one small
matrix a task, summed on the executors in a tree, however many rows there are. Raw scores are calibrated by
isotonic regression over a fixed number of score bins, whose sums are gathered the same way; each labelled
row's raw score there is that of a fit without its fold, solved from the other folds' sums.

Defined cases: a null text counts as empty; an empty text gets the score its (all zero) statistics
give; without labelled rows, or with one class only, every score is the smoothed share of class 1;
a document with several labels counts once for each; null labels and ids that match none teach
nothing; repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, crc_mod, spans, spare_name, text_column, tidy

BLOCK = 1 << 20
#: Folds of the calibration, and partial sums added up at a time.
FOLDS, FAN_IN = 4, 16
#: Kinds of bytes: 0 control, 1 a-z, 2 A-Z, 3 digit, 4 blank, 5 line end, 6 full stop, 7 comma, 8 !?, 9 |, 10 other ASCII, 11 beyond ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 10
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[32, 9, 11, 12]] = 4
_KIND[[10, 13]] = 5
_KIND[46], _KIND[44], _KIND[[33, 63]], _KIND[124] = 6, 7, 8, 9
_KIND[128:] = 11
KINDS = 12
DIM = KINDS + 14


def _sums(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, KINDS + 9) counts over each row: kinds; words, squared word lengths, one-letter words, doubled marks, capital pairs, marks behind letters, letter words, lines, short lines."""
    n = len(offsets) - 1
    x, kind = data, _KIND[data]
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(n), lengths)
    out = np.zeros((n, KINDS + 9))
    out[:, :KINDS] = np.bincount(row * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS)
    if not len(x):
        return out
    first = np.zeros(len(x) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    gap = (kind == 4) | (kind == 5)
    before_gap = np.empty(len(x), bool)
    before_gap[0], before_gap[1:] = True, gap[:-1]
    before_gap |= first
    starts = np.nonzero(~gap & before_gap)[0]
    after_gap = np.empty(len(x), bool)
    after_gap[-1] = True
    after_gap[:-1] = gap[1:] | first[1:]
    ends = np.nonzero(~gap & after_gap)[0]
    size = ends - starts + 1
    of = row[starts]
    count = lambda rows, weights=None: np.bincount(rows, weights=weights, minlength=n)
    out[:, KINDS] = count(of)
    out[:, KINDS + 1] = count(of, np.minimum(size, 40).astype(float) ** 2)
    out[:, KINDS + 2] = count(of, (size <= 1).astype(float))
    same = (x[1:] == x[:-1]) & ~first[1:]
    k1, k0 = kind[1:], kind[:-1]
    mark = (k1 >= 6) & (k1 <= 10)
    out[:, KINDS + 3] = count(row[1:], (same & mark).astype(float))
    out[:, KINDS + 4] = count(row[1:], ((k1 == 2) & (k0 == 2) & ~first[1:]).astype(float))
    letter0 = (k0 == 1) | (k0 == 2) | (k0 == 11)
    out[:, KINDS + 5] = count(row[1:], (mark & (k1 != 6) & (k1 != 7) & letter0 & ~first[1:]).astype(float))
    word_letters = np.add.reduceat(((kind == 1) | (kind == 2) | (kind == 11)).astype(np.int64), starts) if len(starts) else np.zeros(0)
    out[:, KINDS + 6] = count(of, (word_letters >= size).astype(float))
    out[:, KINDS + 7] = count(row, (kind == 5).astype(float))
    line_end = np.nonzero(kind == 5)[0]
    if len(line_end):
        begin = np.maximum(np.concatenate([[0], line_end[:-1] + 1]), offsets[row[line_end]])
        out[:, KINDS + 8] = count(row[line_end], (line_end - begin < 20).astype(float))
    return out


def _repeats(text: bytes) -> tuple[float, float]:
    """Distinct words and distinct lines, as shares of all."""
    words, lines = text.split(), text.split(b"\n")
    return len(set(words)) / len(words) if words else 0.0, len(set(lines)) / len(lines)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, DIM) document statistics; texts beyond BLOCK bytes are summed block by block."""
    n = len(offsets) - 1
    sums, shares = np.zeros((n, KINDS + 9)), np.zeros((n, 2))
    for i, j in spans(offsets, BLOCK):
        lo, hi = int(offsets[i]), int(offsets[j])
        if j == i + 1:
            for a in range(lo, hi, BLOCK):
                part = data[a : min(hi, a + BLOCK)]
                sums[i] += _sums(part, np.array([0, len(part)]))[0]
        else:
            sums[i:j] = _sums(data[lo:hi], offsets[i : j + 1] - lo)
        for r in range(i, j):
            shares[r] = _repeats(data[offsets[r] : offsets[r + 1]].tobytes())
    size = np.diff(offsets).astype(float)
    per = np.maximum(size, 1)[:, None]
    words = np.maximum(sums[:, KINDS], 1)
    out = np.zeros((n, DIM))
    out[:, :KINDS] = np.sqrt(sums[:, :KINDS] / per)
    w = sums[:, KINDS:]
    out[:, KINDS] = np.log1p(size)
    out[:, KINDS + 1] = size / words / 10
    out[:, KINDS + 2] = np.sqrt(w[:, 1] / words) / 10
    for k, source in ((3, 2), (4, 3), (5, 4), (6, 5), (7, 6)):
        out[:, KINDS + k] = np.sqrt(w[:, source] / words)
    out[:, KINDS + 8] = np.sqrt(w[:, 7] / words)
    out[:, KINDS + 9] = w[:, 8] / np.maximum(w[:, 7], 1)
    out[:, KINDS + 10 : KINDS + 12] = shares
    out[:, KINDS + 12] = np.log1p(w[:, 0])
    out[:, KINDS + 13] = sums[:, 6] / words
    out[size == 0] = 0
    return out


@dataclass
class QualityModel:
    mean: np.ndarray = field(default_factory=lambda: np.zeros(DIM))
    scale: np.ndarray = field(default_factory=lambda: np.ones(DIM))
    omega: np.ndarray | None = None
    phase: np.ndarray | None = None
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None
    prior: float = 0.5

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        phi = np.cos(z @ self.omega + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([phi, z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.prior)
        return np.interp(self.raw(stats), self.knots, self.levels)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of least weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(y, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks])


def _summed(rows: DataFrame, one: callable) -> np.ndarray | None:
    """The sum over all rows of one(statistics, labels), an array, added up in each task and then on the executors."""

    def run(batches):
        total = None
        for b in batches:
            y = b.column(b.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(float)
            part = one(unpacked(b), y)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["part"])

    def add(batches):
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                v = np.frombuffer(x, "<f8")
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = rows.select("stats", "label").mapInArrow(tidy(run), "part binary")
    n = parts._jdf.queryExecution().toRdd().getNumPartitions()
    while n > FAN_IN:  # a tree of sums
        n = -(-n // FAN_IN)
        parts = parts.repartition(n).mapInArrow(tidy(add), "part binary")
    got = [np.frombuffer(r[0], "<f8") for r in parts.collect()]  # FAN_IN arrays at most
    return np.sum(got, axis=0) if got else None


def fold_of(stats: np.ndarray) -> np.ndarray:
    """Each row's fold, by its statistics, so repeated rows share one."""
    return np.array([zlib.crc32(x.tobytes()) % FOLDS for x in np.ascontiguousarray(stats)], np.int64)


def train(labelled: DataFrame, features: int = 192, ridge: float = 1e-3, gamma: float = 0.05, bins: int = 400, seed: int = 11) -> QualityModel:
    """From stats and label (0 or 1), over all given rows; they are read three times."""
    rows = labelled.select("stats", F.col("label").cast("int").alias("label")).where(F.col("label").isin(0, 1))
    moments = _summed(rows, lambda s, y: np.concatenate([[len(y), y.sum()], s.sum(0), (s**2).sum(0)]))
    model = QualityModel()
    if moments is None:
        return model
    n, ones = moments[:2]
    model.prior = (ones + 1) / (n + 2)
    if not 0 < ones < n:
        return model
    model.mean = moments[2 : 2 + DIM] / n
    model.scale = np.sqrt(np.maximum(moments[2 + DIM :] / n - model.mean**2, 1e-6))
    rng = np.random.default_rng(seed)
    model.omega = rng.normal(0, np.sqrt(2 * gamma), (DIM, features))
    model.phase = rng.uniform(0, 2 * np.pi, features)
    size = features + DIM + 1
    share = ones / n

    def normal(s: np.ndarray, y: np.ndarray) -> np.ndarray:
        phi, fold = model.features(s), fold_of(s)
        w = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))[:, None]
        sums = [np.concatenate([(phi[at].T @ (w[at] * phi[at])).ravel(), (phi[at] * w[at]).T @ y[at]]) for at in (fold == f for f in range(FOLDS))]
        return np.concatenate([*sums, np.bincount(fold, minlength=FOLDS)])

    got = _summed(rows, normal)
    sums, sizes = got[:-FOLDS].reshape(FOLDS, size * size + size), got[-FOLDS:]

    def solved(eq: np.ndarray, rows_: float) -> np.ndarray:
        penalty = np.full(size, ridge * rows_)
        penalty[-1] = 1e-9 * rows_
        return np.linalg.solve(eq[: size * size].reshape(size, size) + np.diag(penalty), eq[size * size :])

    whole = sums.sum(0)
    model.weights = solved(whole, n)
    without = [replace(model, weights=solved(whole - sums[f], n - sizes[f])) if sizes[f] < n else model for f in range(FOLDS)]
    edges = np.linspace(-0.5, 1.5, bins + 1)

    def histogram(s: np.ndarray, y: np.ndarray) -> np.ndarray:
        fold, raw = fold_of(s), np.zeros(len(y))
        for f in range(FOLDS):
            raw[fold == f] = without[f].raw(s[fold == f])
        at = np.clip(np.searchsorted(edges, raw) - 1, 0, bins - 1)
        return np.concatenate([np.bincount(at, minlength=bins), np.bincount(at, weights=y, minlength=bins)]).astype(float)

    h = _summed(rows, histogram)
    total, good = h[:bins], h[bins:]
    used = total > 0
    level = isotonic((good[used] + model.prior) / (total[used] + 1), total[used])
    model.knots, model.levels = (edges[:-1] + (edges[1] - edges[0]) / 2)[used], np.clip(level, 0, 1)
    return model


def unpacked(b: pa.RecordBatch) -> np.ndarray:
    got = b.column(b.schema.get_field_index("stats")).to_pylist()
    return np.frombuffer(b"".join(got), "<f4").astype(float).reshape(len(got), DIM)


def with_statistics(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The named columns and ``stats``, the statistics of ``text`` as little-endian 32-bit floats."""
    own = spare_name(keep, "text")
    rows = documents.select(*keep, F.col("text").cast("string").alias(own))
    schema = T.StructType([*documents.select(*keep).schema.fields, T.StructField("stats", T.BinaryType())])

    def run(batches):
        for b in batches:
            data, offsets, _ = text_column(b, own)
            stats = statistics(data, offsets).astype("<f4")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x.tobytes() for x in stats], pa.binary())], names=schema.fieldNames())

    return rows.mapInArrow(tidy(run), schema)


def score(rows: DataFrame, model: QualityModel, column: str = "score") -> DataFrame:
    """The rows with the score of their ``stats``, which are dropped."""
    keep = [c for c in rows.columns if c != "stats"]
    column = spare_name(keep, column)
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.score(unpacked(b)), pa.float64())], names=schema.fieldNames())

    return rows.select(*keep, "stats").mapInArrow(tidy(run), schema)


def held_out(n: int = 5, rest: int = 0) -> Column:
    """Rows whose labels are never learned; a null id is never held out."""
    return F.coalesce(crc_mod(F.col("doc_id"), n) == rest, F.lit(False))


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """stats, label: the statistics of the documents that the labels' ids name; only these numbers are shuffled, never texts."""
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label")).where("label is not null")
    return stats.join(marks, F.col("doc_id") == F.col("_id")).select("stats", "label")


def op6_quality(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score; the texts are read once."""
    scratch = Scratch(spark, "quality")
    stats = scratch.table(with_statistics(documents, ["doc_id"]))
    model = train(scratch.table(labelled(stats.where(~held_out()), labels)))
    return score(stats, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, documents: DataFrame, labels: DataFrame, least: float = 0.3, sample: int = 50_000) -> DataFrame:
    """The documents that score ``least`` or more; columns as they are.

    The model is fit on at most ``sample`` labels, those of the least hashes of all, so that their ids may be
    broadcast and statistics be made of their documents only, before every document is scored.
    """
    scratch = Scratch(spark, "quality")
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1) and _id is not null")
    drawn = marks.orderBy(F.xxhash64("_id", "label"), "_id", "label").limit(sample)
    known = documents.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))
    model = train(scratch.table(with_statistics(known, ["label"])))
    rows = documents.withColumn("text", F.col("text").cast("string"))

    def run(batches):
        for b in batches:
            data, offsets, _ = text_column(b)
            yield b.filter(pa.array(model.score(statistics(data, offsets)) >= least))

    return rows.mapInArrow(tidy(run), rows.schema)
