"""Packing of token sequences by best-fit decreasing.

Every document becomes token ids (a closing id included), overlong ones are cut into full windows and
a rest, and the pieces are placed by best-fit decreasing: longest first, each into the open window
with the least room that still holds it, found in a segment tree over remaining capacity.

Best-fit decreasing only looks at lengths, and there are at most ``capacity`` different ones. So the
driver runs it over the histogram of lengths - whole classes of equal windows at a time - and gets a
plan whose size depends on the capacity alone. Executors rank the pieces of each length (in salted
buckets, so that a length that a third of the pieces share is spread) and read sequence and offset off
the plan. The packing is that of one global run, at any size, with nothing gathered but the histogram.

Defined cases: a null or empty text is the closing id alone; an empty table gives no rows; repeated
rows are packed as often as they occur; rows with a null id are packed like others; other columns of
the input don't matter (only the two named ones are read).
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, spare_name, tidy

#: Words that one of a Python worker's two generations of remembered words holds, and the bytes of the longest.
CACHE_WORDS, CACHE_BYTES = 250_000, 32
#: Bytes of a text that are split into words at a time.
CHUNK = 1 << 20


class WordIds:
    """Ids of words, remembered in two generations of bounded size: what a full generation's successor asks for again moves on."""

    #: Marks that are one token run of their own behind a word of letters.
    MARKS = b".,!?;:|#$%&*+-/"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) + 1, bool)
        self.ends[[i for word, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if word.endswith("</w>")]] = True
        self.by_word = self._by_word()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    #: Texts on which a tokenizer must give the ids of the lower-cased words in order for words to be remembered.
    PROBES = ("Hello wide World", "one,two  THREE\tfour.\nFive!", "Größe ÉCOLE straße 12 34", "a b c")

    def _by_word(self) -> bool:
        """Whether ids can be put together from those of words, each ending in a token that ends a word."""
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        for probe in self.PROBES:
            words = [ids(w) for w in probe.lower().split()]
            if ids(probe) != [i for w in words for i in w] or not all(w and self.ends[w[-1]] for w in words):
                return False
        return True

    def encode(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def encode_letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters: many go through the tokenizer as one text, told apart by the tokens that end a word."""
        out: list[bytes] = []
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(part):  # a letter that becomes several when lower-cased
                out += self.encode(part)
                continue
            flat, at = ids.tobytes(), 0
            for e in ends:
                out.append(flat[at:e])
                at = e
        return out

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """A look-up that holds the words; words ending in MARKS are put together from the word and the marks."""
        if len(self.young) + len(words) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        young, old, parts, new, letters = self.young, self.old, [], set(), set()
        for w in words:
            if w in old:
                young[w] = old[w]
                continue
            core = w.rstrip(self.MARKS)
            if not core or not core.decode().isalpha():
                new.add(w)
            elif len(core) == len(w):
                letters.add(w)
            else:
                tail = w[len(core) :]
                parts.append((w, core, tail))
                for x, unknown in ((core, letters), (tail, new)):
                    if x not in young:
                        if x in old:
                            young[x] = old[x]
                        else:
                            unknown.add(x)
        for unknown, encode in ((list(new), self.encode), (list(letters), self.encode_letters)):
            young.update(zip(unknown, encode(unknown), strict=True))
        for w, core, tail in parts:
            young[w] = young[core] + young[tail]
        return young

    def forget_long(self, words: set[bytes]) -> None:
        for w in words:
            if len(w) > CACHE_BYTES:
                for x in (w, w.rstrip(self.MARKS)):
                    self.young.pop(x, None)


@lru_cache(maxsize=4)
def _words(path: str) -> WordIds:
    return WordIds(path)


def token_bytes(texts: list[str | None], path: str, end_id: int) -> list[bytes]:
    """Each text's ids, closing id included, as little-endian unsigned 32-bit numbers.

    A tokenizer that never lets a token reach over white space, lower-cases and marks the ends of words gives a
    text the ids of its lower-cased words in order, so each different word is encoded once; with any other, texts
    are encoded whole. A text with the
    beginning of a special token's name is not lower-cased before, as those names are looked for first.
    """
    held, out = _words(path), []
    if not held.by_word:  # another kind of tokenizer: whole texts as they are
        return [np.array([*held.tokenizer.encode(t or "", add_special_tokens=False).ids, end_id], "<u4").tobytes() for t in texts]
    end = end_id.to_bytes(4, "little")
    group: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        data = (t or "").encode()
        if len(data) > CHUNK and group:
            out += _group_bytes(held, group, end)
            group, size = [], 0
        group.append(data if b"<|" in data else data.lower())
        size += len(data)
        if size >= CHUNK // 2 or i + 1 == len(texts):
            out += _group_bytes(held, group, end)
            group, size = [], 0
    return out


def _group_bytes(held: WordIds, group: list[bytes], end: bytes) -> list[bytes]:
    """The group's texts; one beyond CHUNK bytes comes alone, and in parts."""
    pieces: list[list[bytes]] = [[] for _ in group]
    parts = [(i, part) for i, data in enumerate(group) for part in chunks(data)] if len(group) == 1 else list(enumerate(group))
    for some in ([x] for x in parts) if len(group) == 1 else [parts]:
        words: list[bytes] = []
        stops = []
        for _, part in some:
            words += part.split()
            stops.append(len(words))
        found = list(map(held.young.get, words))
        if None in found:
            known = held.learn({w for w, f in zip(words, found, strict=True) if f is None})
            found = [known[w] if f is None else f for w, f in zip(words, found, strict=True)]
        at = 0
        for (i, _), stop in zip(some, stops, strict=True):
            pieces[i].append(b"".join(found[at:stop]))
            at = stop
    return [b"".join(p) + end for p in pieces]


def chunks(data: bytes) -> Iterator[bytes]:
    """The bytes, cut at ASCII white space into chunks of about CHUNK bytes."""
    i, n = 0, len(data)
    while n - i > CHUNK:
        j = max(data.rfind(s, i, i + CHUNK) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if j <= i:
            j = min((k for k in (data.find(s, i + 1) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if k > 0), default=n)
        yield data[i:j]
        i = j
    yield data[i:]


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def tokenize(documents: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit): documents as pieces of at most ``capacity`` ids."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for lo in range(0, len(ids), 256):
                rows: list[list] = [[], [], [], [], []]
                for d, x in zip(ids[lo : lo + 256], token_bytes(texts[lo : lo + 256].to_pylist(), tokenizer_path, end_id), strict=True):
                    n = len(x) // 4
                    for s in range(0, n, capacity):
                        piece = x[4 * s : 4 * (s + capacity)]
                        for col, v in zip(rows, (d, s, len(piece) // 4, n, piece), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    names=PIECES.fieldNames(),
                )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), PIECES)


class RoomTree:
    """Segment tree over remaining capacity: which rooms have an open window."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, room: int, there: bool) -> None:
        i = self.size + room
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that a window has."""
        i = self.size + need
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """The plan (length, first rank, rank after the last, first sequence, pieces a sequence, offset of the first).

    Windows with the same room are handled as runs of consecutive sequences. One run takes pieces of a
    length until either is used up; a window takes as many as fit before the next one starts, as
    best-fit does, since a window just used is the tightest. Runs split only where a length ends, so
    their number, and the plan's, is bounded by the capacity, not by the number of pieces.
    """
    tree, open_, plan, sequences = RoomTree(capacity), defaultdict(list), [], 0

    def put(room: int, n: int, first: int) -> None:
        if n and room:
            open_[room].append((n, first))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} ids does not fit {capacity}")
        rank, total = 0, counts[length]
        while rank < total:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                n = first = None
                n, first = -(-(total - rank) // each), sequences
                sequences += n
            else:
                n, first = open_[room].pop()
                if not open_[room]:
                    tree.set(room, False)
                each = room // length
            used = min(n, -(-(total - rank) // each))
            taken = min(total - rank, used * each)
            plan.append((length, rank, rank + taken, first, each, capacity - room))
            full, rest = divmod(taken, each)
            put(room - each * length, full, first)
            put(room - rest * length, int(rest > 0), first + full)
            put(room, n - used, first + used)
            rank += taken
    return plan


PLAN = "length long, lo long, hi long, first long, each long, base long"


def pack(pieces: DataFrame, capacity: int = 4096, bucket_rows: int = 20_000) -> DataFrame:
    """The pieces with sequence_id and offset. ``length`` is read; all other columns are carried and, but for binary ones, decide ties.

    pieces is read three times, so hand over a written table where it is dear to compute.
    """
    spark: SparkSession = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = spark.createDataFrame(best_fit_decreasing(counts, capacity), PLAN)
    by = [c for c, kind in pieces.dtypes if kind != "binary"]
    buckets = max(64, sum(counts.values()) // bucket_rows)
    bucket, n, less, number, rank = (spare_name(pieces.columns, x) for x in ("bucket", "n", "less", "number", "rank"))
    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64(*by), F.lit(buckets)))
    group = ["length", bucket]
    before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*group).agg(F.count(F.lit(1)).alias(n))
    starts = starts.select(*group, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(less))
    ranked = dealt.withColumn(number, F.row_number().over(Window.partitionBy(*group).orderBy(*by)) - 1).join(starts, group)
    ranked = ranked.withColumn(rank, F.col(less) + F.col(number)).drop(bucket, number, less)
    names = {c: spare_name([*pieces.columns, rank], "plan_" + c) for c in plan.columns}
    p = F.broadcast(plan.select(*[F.col(c).alias(names[c]) for c in plan.columns]))  # its size depends on the capacity alone
    x = {c: F.col(names[c]) for c in plan.columns}
    here = F.col(rank) - x["lo"]
    placed = ranked.join(p, (F.col("length") == x["length"]) & (F.col(rank) >= x["lo"]) & (F.col(rank) < x["hi"]))
    return placed.select(
        *pieces.columns,
        (x["first"] + F.floor(here / x["each"])).cast("long").alias(spare_name(pieces.columns, "sequence_id")),
        (x["base"] + here % x["each"] * F.col("length")).cast("long").alias(spare_name(pieces.columns, "offset")),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the packed sequences' own ids, from pieces that carry ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` ids
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"),
    )


def op1_packing(spark: SparkSession, documents: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Where each piece of each document lies, with the digests of its ids."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    pieces = tokenize(documents, tokenizer_path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(Scratch(spark, "pack").table(pieces))
