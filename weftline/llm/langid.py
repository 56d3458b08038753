"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are its byte 3- and 4-grams that don't reach over white space (a bordering blank
counts as a letter, so beginnings and ends of words are told apart). Each is hashed to a bucket with an
embedding; the mean of all embeddings goes through a linear softmax. Both are trained by stochastic
gradient descent in numpy. As the mean and the linear map commute, a prediction adds up one row of
class scores for each subword.

Probabilities are tempered on a part of the training sample that the descent doesn't see, where the
rejection threshold is set too: the least score above which predictions reach ``precision``.

Training reads about ``per_language`` labelled texts of each language at most, chosen by a hash of id and text over
the whole table, equal texts once, as bucket counts made on the executors (never more than BUCKETS numbers a text).

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; other texts
always get a learned language; without any labelled row all are ``und``; repeated rows get equal
results; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, spans, text_column, tidy

BUCKETS = 1 << 13
#: Bytes looked at together; longer texts are cut with an overlap, and their parts added up.
BLOCK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER[_SPACE] = 32
_LETTER = regex.compile(r"\p{L}")


def _buckets(data: np.ndarray) -> np.ndarray:
    """(2, n) bucket of the 3-gram and of the 4-gram that begin at each byte; BUCKETS where there is none."""
    x = _LOWER[data]
    gap = _SPACE[data]
    n = len(x)
    out = np.full((2, n), BUCKETS, np.int32)
    v = x.astype(np.uint32)
    for row, k in ((0, 3), (1, 4)):
        m = n - k + 1
        if m <= 0:
            continue
        h = np.full(m, 2166136261 + k, np.uint32)
        for i in range(k):
            h = (h ^ v[i : i + m]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        inside = gap[1 : 1 + m].copy()
        for i in range(2, k - 1):
            inside |= gap[i : i + m]
        out[row, :m] = np.where(inside, BUCKETS, (h & np.uint32(BUCKETS - 1)).astype(np.int32))
    return out


def _blocks(data: np.ndarray, offsets: np.ndarray):
    """(rows, bytes with a blank between texts, where each row begins): blocks of about BLOCK bytes; a long text gives several with the same row."""
    blank = np.array([32], np.uint8)
    for i, j in spans(offsets, BLOCK):
        lo, hi = int(offsets[i]), int(offsets[j])
        if j == i + 1 and hi - lo > BLOCK:
            for a in range(lo, hi, BLOCK):
                # a part also sees the three bytes before it; what begins there and ends there is counted once
                yield np.array([i]), np.concatenate([blank if a == lo else data[a - 3 : a], data[a : min(hi, a + BLOCK)], blank if a + BLOCK >= hi else data[:0]]), np.array([0]), a > lo
            continue
        part = np.insert(data[lo:hi], np.repeat(offsets[i : j + 1] - lo, [1, *[2] * (j - i - 1), 1]) if j > i else [], 32)
        yield np.arange(i, j), part, offsets[i:j] - lo + 2 * np.arange(j - i), False


def _grams(data: np.ndarray, offsets: np.ndarray):
    """(rows, flat buckets, where each row begins in them)."""
    for rows, part, starts, again in _blocks(data, offsets):
        b = _buckets(part)
        if again:  # the 3-gram wholly within the overlap was counted with the part before
            b[0, 0] = BUCKETS
        yield rows, b.T.reshape(-1), 2 * starts


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # (BUCKETS + 1, languages) contribution of each bucket; the last row is 0
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total, count = np.zeros((n, len(self.languages))), np.zeros(n)
        for rows, flat, starts in _grams(data, offsets):
            np.add.at(total, rows, np.add.reduceat(self.scores[flat], starts, axis=0, dtype=np.float64))
            np.add.at(count, rows, np.add.reduceat((flat < BUCKETS).astype(np.float64), starts))
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = _softmax(self.logits(data, offsets) / self.temperature)
        return p.argmax(1), p.max(1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _counts(documents: DataFrame) -> DataFrame:
    """label, buckets, shares: each text's distinct buckets and their share of its subwords."""

    def run(batches):
        for b in batches:
            data, offsets, _ = text_column(b)
            labels, rows = b.column(0), []
            for i in range(b.num_rows):
                total = np.zeros(BUCKETS + 1)
                for _, flat, _ in _grams(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]])):
                    total += np.bincount(flat, minlength=BUCKETS + 1)
                at = np.nonzero(total[:BUCKETS])[0]
                share = total[at] / max(1.0, total[at].sum())
                rows.append((at.astype("<u2").tobytes(), share.astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([labels, pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["label", "buckets", "shares"])

    return documents.select("label", "text").mapInArrow(tidy(run), "label string, buckets binary, shares binary")


def train(documents: DataFrame, per_language: int = 400, dim: int = 16, epochs: int = 8, precision: float = 0.99, seed: int = 7) -> LanguageModel | None:
    """Learns from doc_id, text and lang of the given rows; rows without lang or letters are passed over."""
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("label")).where(F.col("label").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}  # a row for each language
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    # rows that share an id are drawn apart by their texts, and equal texts count once, so the sample is bounded whatever repeats
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.where(draw < share[F.col("label")]).where(F.col("text").rlike(r"\p{L}"))
    sample = sample.withColumn("mark", F.xxhash64("text")).dropDuplicates(["label", "mark"])
    got = sorted((r.label, bytes(r.buckets), bytes(r.shares)) for r in _counts(sample).collect())  # about per_language rows a language
    languages = sorted({g[0] for g in got})
    if not languages:
        return None
    x = [(np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(s, "<f4")) for _, b, s in got]
    y = np.array([languages.index(g[0]) for g in got])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = order[: len(y) // 5]
    fit = order[len(y) // 5 :]
    emb = rng.normal(0, 1 / dim, (BUCKETS, dim))
    out, bias = np.zeros((dim, len(languages))), np.zeros(len(languages))
    for epoch in range(epochs):
        rate = 2.0 * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            at, share_ = x[i]
            mean = share_ @ emb[at]
            p = _softmax(mean @ out + bias)
            p[y[i]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= 0.05 * rate * p
            emb[at] -= rate * 8 * share_[:, None] * back
    logits = np.array([x[i][1] @ emb[x[i][0]] @ out + bias for i in range(len(y))])
    use = held if len(held) >= 20 else order
    temperatures = np.geomspace(0.05, 5, 60)
    loss = [-np.mean(np.log(_softmax(logits[use] / t)[np.arange(len(use)), y[use]] + 1e-12)) + 1e-3 * abs(np.log(t)) for t in temperatures]
    temperature = float(temperatures[int(np.argmin(loss))])
    p = _softmax(logits[use] / temperature)
    right, score = p.argmax(1) == y[use], p.max(1)
    down = np.argsort(-score, kind="stable")
    good = np.nonzero(np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= precision)[0]
    threshold = float(score[down[good[-1]]]) if len(good) else 1.0
    table = np.vstack([emb @ out, np.zeros(len(languages))]).astype(np.float32)
    return LanguageModel(languages, table, bias, temperature, threshold)


def identify(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected; only the text is looked at."""
    schema = documents.select("doc_id").schema.add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("rejected", T.BooleanType())

    def run(batches):
        for b in batches:
            texts = b.column(1)
            letters = np.array([x is not None and _LETTER.search(x) is not None for x in texts.to_pylist()], dtype=bool)
            if model is None:
                pred, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            else:
                data, offsets, _ = text_column(b)
                best, score = model.predict(data, offsets)
                pred = np.array(model.languages, object)[best]
                pred[~letters], score[~letters] = "und", 0.0
            rejected = score < model.threshold if model else np.ones(b.num_rows, bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(rejected | ~letters)], names=schema.fieldNames())

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), schema)


def held_out(n: int, rest: int) -> Column:
    """Rows of which nothing is learned; a null id is never held out."""
    return F.coalesce(crc_mod(F.col("doc_id"), n) == rest, F.lit(False))


def op4_language(documents: DataFrame) -> DataFrame:
    model = train(documents.where(~held_out(4, 2)))
    return identify(documents, model).withColumn("held_out", held_out(4, 2)).select("doc_id", "held_out", "lang_pred", "score", "rejected")
