"""Exact substring deduplication by a hash-compared suffix sort of sampled suffixes.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier (in a document of
smaller id, or further ahead in the same one). Sorting every suffix of the corpus would move each
byte's whole context, so suffixes are sampled by content first: every string of ``length`` bytes is
anchored at the least-hashed of the ``kgram``-grams in it (the leftmost of equal ones). Equal strings
have equal anchors at equal places, so only strings anchored alike have to be sorted.

1. Each task finds its anchors: prefix polynomial hashes give all k-gram hashes, a sliding minimum the
   anchors. An anchor stands for the strings that it anchors, together its context. Of equal contexts in
   a batch all but the first are covered; only the first goes on, so frequent passages shrink before
   the shuffle.
2. Anchors meet by k-gram hash, in buckets. Again all but the first of equal contexts are covered, and
   what is left alone is dropped. Anchors with different contexts remain: the ends of repeats.
3. For those the context's bytes are fetched, and the strings anchored alike are sorted: a mergesort
   whose comparisons find the common extension of two suffixes by binary search over prefix polynomial
   hashes. Strings whose hash no other has are left out, as they equal none. Neighbours that agree over
   the whole length are verified byte by byte; all but the first of a class are covered, and only the
   first goes on through the sort. Contexts of a k-gram that has more
   than ``crowd`` of them are cut into runs of strings of up to a fifth of ``length`` neighbouring
   starts, each dealt by k-gram, place and the bytes that all strings of the run share: equal strings
   share those too, so they meet, but no longer where all others of the k-gram are.
4. The covered runs of each document are united and cut out.

Contexts in steps 1 and 2 are told apart by two independent 64-bit hashes (of the k-gram and of the
context). Defined cases: a null text is empty; texts are UTF-8 bytes, and what is kept need not be
valid UTF-8; null ids come before all others; rows that share an id are ordered by text hash, equal
ones count as one document and get equal results; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shuffle_width, spans, text_column, tidy

BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1
LEAST = -(1 << 63)
#: Bytes of contexts that are sorted at a time (contexts dealt alike always together), and strings of them.
SORTED, STRINGS = 1 << 22, 1 << 20
#: Contexts of a k-gram from which on they are dealt by the bytes around it too.
CROWD = 256
#: Documents' anchors that a bucket is meant to hold.
BUCKET_DOCS = 2000
ANCHOR = np.dtype([("h", "<u8"), ("c", "<u8"), ("d", "<i8"), ("m", "<i8"), ("x", "<i8")])


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the i and to the -i, modulo 2^64, for i below n."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.ones(n, np.uint64)
        done = 1
        while done < n:
            step = np.uint64(pow(base, done, 1 << 64))
            p[done : 2 * done] = p[: min(done, n - done)] * step
            done *= 2
        out.append(p)
    return out[0], out[1]


def prefix_hashes(data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """n + 1 sums of byte times BASE to its place (``at``, or its index)."""
    up, _ = _powers(max(2, 1 << int(len(data) if at is None else 4096).bit_length()))
    out = np.zeros(len(data) + 1, np.uint64)
    for i in range(0, len(data), BLOCK):
        part = slice(i, min(len(data), i + BLOCK))
        np.cumsum((data[part].astype(np.uint64) + np.uint64(1)) * up[part if at is None else at[part]], out=out[part.start + 1 : part.stop + 1])
        out[part.start + 1 : part.stop + 1] += out[i]
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    return h


def block_anchors(data: np.ndarray, last: np.ndarray, length: int, kgram: int) -> tuple[np.ndarray, ...]:
    """(hash, place, first string, last string) of the block's anchors; last[s]: whether a string may start at s."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    _, down = _powers(1 << int(n).bit_length())
    p = prefix_hashes(data)
    h = _mixed((p[kgram:] - p[:-kgram]) * down[: n - kgram + 1])
    low = np.uint64((1 << 21) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, span = length - kgram + 1, 1
    least = key
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(key) - width + 1], least[width - span : width - span + len(key) - width + 1])
    starts = np.nonzero(last[: n - length + 1])[0]
    if not len(starts):
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    place = (least[starts] & low).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.nonzero(new)[0]
    ends = np.concatenate([at[1:], [len(starts)]]) - 1
    return h[place[at]], place[at], starts[at], starts[ends]


def _blocks(data: np.ndarray, offsets: np.ndarray, length: int):
    """(bytes, where a string may start, row of each byte, place in its row of the first byte): texts of about BLOCK bytes together, long ones in overlapping parts."""
    for i, j in spans(offsets, BLOCK):
        lo, hi = int(offsets[i]), int(offsets[j])
        if j == i + 1 and hi - lo > BLOCK:
            for a in range(lo, hi, BLOCK):
                part = data[a : min(hi, a + BLOCK + length - 1)]
                yield part, np.arange(len(part)) < BLOCK, np.full(len(part), i), np.full(len(part), lo - a)
            continue
        sizes = np.diff(offsets[i : j + 1])
        row = np.repeat(np.arange(i, j), sizes)
        end = np.repeat(offsets[i + 1 : j + 1] - lo, sizes)
        yield data[lo:hi], np.arange(hi - lo) + length <= end, row, np.repeat(offsets[i:j] - lo, sizes)


def batch_anchors(data: np.ndarray, offsets: np.ndarray, d: np.ndarray, m: np.ndarray, length: int, kgram: int) -> np.ndarray:
    out = []
    for part, may, row, begin in _blocks(data, offsets, length):
        h, place, first, last = block_anchors(part, may, length, kgram)
        if not len(h):
            continue
        raw, digest = part.tobytes(), xxhash.xxh3_64_intdigest
        c = [digest(raw[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]
        rows = np.zeros(len(h), ANCHOR)
        of = row[place]
        rows["h"], rows["c"], rows["d"], rows["m"] = h, np.array(c, np.uint64), d[of], m[of]
        rows["x"] = (place - begin[place]) << 16 | (place - last) << 8 | (place - first)
        out.append(rows)
    return np.concatenate(out) if out else np.zeros(0, ANCHOR)


def _first_of_context(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in order of k-gram, context and occurrence, equal ones once, and which is the first of its context."""
    low = rows["x"] & 0xFFFF
    rows = rows[np.lexsort((rows["x"] >> 16, rows["m"], rows["d"], low, rows["c"], rows["h"]))]
    if len(rows) < 2:
        return rows, np.ones(len(rows), bool)
    a, b = rows[1:], rows[:-1]
    same = (a["h"] == b["h"]) & (a["c"] == b["c"]) & ((a["x"] & 0xFFFF) == (b["x"] & 0xFFFF))
    again = same & (a["x"] == b["x"]) & (a["d"] == b["d"]) & (a["m"] == b["m"])
    first = np.concatenate([[True], ~same])
    keep = np.concatenate([[True], ~again])
    return rows[keep], first[keep]


def _covered(rows: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(d, m, begin, end) of whole contexts, united where one document's run together."""
    p, lo, hi = rows["x"] >> 16, rows["x"] >> 8 & 0xFF, rows["x"] & 0xFF
    return united(rows["d"], rows["m"], p - hi, p - lo + length)


def united(d: np.ndarray, m: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same bytes in runs that neither overlap nor touch."""
    if not len(d):
        return d, m, begin, end
    o = np.lexsort((begin, m, d))
    d, m, begin, end = d[o], m[o], begin[o], end[o]
    owner = np.concatenate([[False], (d[1:] != d[:-1]) | (m[1:] != m[:-1])]).cumsum()
    wide = int(end.max()) + 2
    if wide * (int(owner[-1]) + 1) >= 1 << 62:
        raise ValueError("texts too long to unite at once")
    reach = np.maximum.accumulate(end + owner * wide)  # a document's ends lie above all those of the one before
    new = np.ones(len(d), bool)
    new[1:] = begin[1:] + owner[1:] * wide > reach[:-1]
    at = np.nonzero(new)[0]
    stop = np.concatenate([at[1:], [len(d)]]) - 1
    return d[at], m[at], begin[at], reach[stop] - owner[stop] * wide


#: kind 0: a covered run [a, b) of document (d, m); kind 1: an anchor to sort, hash a and place, reach b; kind 2: one of a crowded hash.
FOUND = "kind int, d long, m long, a long, b long"


def _found(kind: int | np.ndarray, d, m, a, b) -> pa.RecordBatch:
    n = len(d)
    arrays = [pa.array(np.broadcast_to(kind, n).astype(np.int32))] + [pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)) for x in (d, m, a, b)]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "d", "m", "a", "b"])


class SuffixOrder:
    """Suffixes of short texts, compared over at most ``length`` bytes by prefix hashes."""

    def __init__(self, texts: list[bytes], length: int):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.place = (np.arange(len(self.data)) - np.repeat(self.begin, sizes)).astype(np.int16)
        self.hashes = prefix_hashes(self.data, self.place)
        self.down = _powers(4096)[1]
        self.length = length

    def hashed(self, at: np.ndarray) -> np.ndarray:
        """The hash of the whole length."""
        return (self.hashes[at + self.length] - self.hashes[at]) * self.down[self.place[at]]

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (self.hashes[a + n] - self.hashes[a]) * self.down[self.place[a]]
        y = (self.hashes[b + n] - self.hashes[b]) * self.down[self.place[b]]
        return x == y

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b have in common, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length, np.int64)
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = self.equal(a, b, mid)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        return low

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1; only what differs is searched for its first difference."""
        sign = np.zeros(len(a), np.int16)
        differ = np.nonzero(~self.equal(a, b, np.int64(self.length)))[0]
        a, b = a[differ], b[differ]
        common = np.minimum(self.extension(a, b), self.length - 1)
        sign[differ] = np.sign(self.data[a + common].astype(np.int16) - self.data[b + common])
        return sign

    def mergesort(self, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, again, before): the distinct suffixes of ``at`` in order within each run of equal ``group``, and which ones equal one ahead of them in it.

        Merges all pairs of runs of a level at once. Of equal suffixes in a merged run only the first of ``at`` goes on, so
        the levels shrink to the distinct ones.
        """
        order = np.arange(len(at))
        of, starts = group, np.arange(len(at) + 1)  # of each run its group and where it begins
        number = starts[:-1] - np.searchsorted(group, group)  # in its group
        again, before = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(of):
            right = number % 2 == 1
            other = np.where(right, np.arange(len(of)) - 1, np.arange(len(of)) + 1)
            paired = right.copy()
            paired[:-1] |= right[1:]
            if not paired.any():
                break
            sizes = np.diff(starts)
            run = np.repeat(np.arange(len(of)), sizes)
            act = np.nonzero(paired[run])[0]
            run = run[act]
            low, high = starts[other[run]], starts[other[run] + 1]
            first, late, mine = low, right[run], at[order[act]]
            low, high = low.copy(), high.copy()
            while (open_ := np.nonzero(low < high)[0]).size:
                mid = (low[open_] + high[open_]) >> 1
                sign = self.compare(at[order[mid]], mine[open_])
                ahead = (sign < 0) | ((sign == 0) & late[open_])  # of equal ones the left run's come first
                low[open_] = np.where(ahead, mid + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], mid)
            moved = order.copy()
            moved[starts[np.minimum(run, other[run])] + (act - starts[run]) + (low - first)] = order[act]
            order, of, number, starts = moved, of[~right], number[~right] >> 1, starts[np.append(~right, True)]
            begins = np.zeros(len(order) + 1, bool)
            begins[starts] = True
            near = act[~begins[act]]  # those with a neighbour ahead in their merged run
            same = near[self.equal(at[order[near - 1]], at[order[near]], np.int64(self.length))]
            again.append(order[same])
            before.append(order[same - 1])
            kept = np.ones(len(order), bool)
            kept[same] = False
            starts = np.concatenate([[0], np.cumsum(kept)])[starts]
            order = order[kept]
        return order, np.concatenate(again), np.concatenate(before)

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the strings at a and b are equal byte by byte."""
        out = np.ones(len(a), bool)
        across = np.arange(self.length)
        for i in range(0, len(a), 20_000):
            out[i : i + 20_000] = (self.data[a[i : i + 20_000, None] + across] == self.data[b[i : i + 20_000, None] + across]).all(1)
        return out


def sort_contexts(h: np.ndarray, d: np.ndarray, m: np.ndarray, x: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(d, m, begin, end) of the strings in these contexts that are not the first of their class."""
    suffixes = SuffixOrder(texts, length)
    step = max(1, STRINGS // max(1, len(h)))  # starts at a time: strings that start in different places before the anchor never meet
    parts = [_sort_starts(suffixes, h, d, m, x, first, first + step - 1, length) for first in range(0, int((x & 0xFF).max()) + 1 if len(h) else 0, step)]
    return united(*map(np.concatenate, zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64),) * 4


def _sort_starts(suffixes: SuffixOrder, h, d, m, x, least: int, most: int, length: int) -> tuple[np.ndarray, ...]:
    """The same for the strings that start ``least`` to ``most`` bytes ahead of the anchor."""
    p, begin = x >> 16, np.maximum(x >> 8 & 0xFF, least)
    each = np.maximum(np.minimum(x & 0xFF, most) - begin + 1, 0)
    of = np.repeat(np.arange(len(h)), each)
    lead = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + begin[of]  # how far ahead of the anchor the string starts
    at = suffixes.begin[of] + (x & 0xFF)[of] - lead
    # a string that shares its hash, k-gram and start with no other equals none, and need not be sorted
    mark = _mixed(suffixes.hashed(at) + _mixed(h[of].view(np.uint64) + lead.astype(np.uint64)))
    o = np.argsort(mark)
    same = mark[o[1:]] == mark[o[:-1]]
    may = np.zeros(len(of), bool)
    may[o[1:][same]] = may[o[:-1][same]] = True
    of, lead, at = of[may], lead[may], at[may]
    o = np.lexsort((p[of], m[of], d[of], lead, h[of]))
    of, lead, at = of[o], lead[o], at[o]
    group = np.concatenate([[False], (h[of[1:]] != h[of[:-1]]) | (lead[1:] != lead[:-1])]).cumsum() if len(of) else np.zeros(0, np.int64)
    _, again, before = suffixes.mergesort(at, group)
    if not suffixes.verified(at[again], at[before]).all():  # two strings of equal hash: those groups are settled by their bytes
        return _by_bytes(suffixes, of, lead, at, group, d, m, p, length)
    j = of[again]
    s = p[j] - lead[again]
    return united(d[j], m[j], s, s + length)


def _by_bytes(suffixes: SuffixOrder, of, lead, at, group, d, m, p, length: int) -> tuple[np.ndarray, ...]:
    seen: dict[tuple[int, bytes], tuple] = {}
    again = []
    for i in sorted(range(len(at)), key=lambda i: (group[i], d[of[i]], m[of[i]], p[of[i]])):
        key = (int(group[i]), suffixes.data[at[i] : at[i] + length].tobytes())
        if key in seen:
            again.append(i)
        seen[key] = ()
    j = of[np.array(again, np.int64)]
    s = p[j] - lead[np.array(again, np.int64)]
    return united(d[j], m[j], s, s + length)


def crowded_runs(text: bytes, h: int, x: int, length: int):
    """(key, x, context) of a context's runs of neighbouring starts; equal strings have equal keys."""
    p, lo, hi = x >> 16, x >> 8 & 0xFF, x & 0xFF
    width = max(1, length // 5)
    for first in range(lo - lo % width, hi + 1, width):
        shared = text[p - first : p - first - width + 1 + length]  # by all strings that start first to first + width - 1 bytes ahead
        key = xxhash.xxh3_64_intdigest(shared, seed=(h ^ first) & _M)
        a, b = max(lo, first), min(hi, first + width - 1)
        yield key - (key >> 63 << 64), p << 16 | a << 8 | b, text[p - b : p - a + length]


def repeated_runs(spark: SparkSession, texts: DataFrame, length: int, kgram: int, crowd: int = CROWD) -> DataFrame:
    """d, m, runs (list of begin, end): the covered bytes of the documents (d, m, text) that have any."""
    scratch = Scratch(spark, "suffixes")
    # the number of buckets follows the rows; a bucket's blobs are settled together
    buckets = max(4 * shuffle_width(spark), texts.select("d").count() // BUCKET_DOCS)
    item = ANCHOR.itemsize

    def find(batches):
        for b in batches:
            data, offsets, _ = text_column(b)
            rows = batch_anchors(data, offsets, b.column(0).to_numpy(), b.column(1).to_numpy(), length, kgram)
            if not len(rows):
                continue
            rows, first = _first_of_context(rows)
            d, m, begin, end = _covered(rows[~first], length)
            rows = rows[first]
            bucket = (rows["h"] % np.uint64(buckets)).astype(np.int64)
            o = np.lexsort((rows["x"], rows["d"], bucket))
            rows, bucket = rows[o], bucket[o]
            edge = np.concatenate([[0], np.nonzero(bucket[1:] != bucket[:-1])[0] + 1, [len(rows)]])
            blobs = [columns_of(rows[i:j]) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            where = bucket[edge[:-1]].tolist()
            if len(d):  # runs already known travel along, dealt by document
                o = np.argsort(d % buckets, kind="stable")
                known = np.stack([d, m, begin, end], 1)[o]
                owner = (d % buckets)[o]
                edge = np.concatenate([[0], np.nonzero(owner[1:] != owner[:-1])[0] + 1, [len(known)]])
                blobs += [b"R" + known[i:j].astype("<i8").tobytes() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                where += owner[edge[:-1]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def columns_of(rows: np.ndarray) -> bytes:
        return b"A" + b"".join(rows[f].tobytes() for f in ANCHOR.names)

    def rows_of(blob: bytes) -> np.ndarray:
        n = (len(blob) - 1) // item
        rows = np.zeros(n, ANCHOR)
        for i, f in enumerate(ANCHOR.names):
            rows[f] = np.frombuffer(blob, ANCHOR[f], n, 1 + 8 * n * i)
        return rows

    def settle(held: list[bytes]):
        rows, first = _first_of_context(np.concatenate([rows_of(x) for x in held]))
        d, m, begin, end = _covered(rows[~first], length)
        if len(d):
            yield _found(0, d, m, begin, end)
        rows = rows[first]
        new = np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]])
        sizes = np.diff(np.concatenate([np.nonzero(new)[0], [len(rows)]]))
        sizes = np.repeat(sizes, sizes)
        rows, kind = rows[sizes > 1], 1 + (sizes[sizes > 1] > crowd)
        if len(rows):
            yield _found(kind, rows["d"], rows["m"], rows["h"], rows["x"])

    def meet(batches):
        now, held = None, []
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if blob[:1] == b"R":
                    known = np.frombuffer(blob, "<i8", offset=1).reshape(-1, 4)
                    yield _found(0, *known.T)
                    continue
                if bucket != now:
                    if held:
                        yield from settle(held)
                    now, held = bucket, []
                held.append(blob)
        if held:
            yield from settle(held)

    dealt = texts.mapInArrow(tidy(find), "bucket long, blob binary").repartition(shuffle_width(spark), "bucket").sortWithinPartitions("bucket")
    found = scratch.table(dealt.mapInArrow(tidy(meet), FOUND))

    ends = found.where("kind > 0").groupBy("d", "m").agg(F.collect_list(F.struct("kind", "a", "b")).alias("marks"))  # bounded by the text

    def fetch(batches):
        for whole in batches:
            for b in (whole.slice(i, 200) for i in range(0, whole.num_rows, 200)):
                out: list[list] = [[], [], [], [], []]
                for d, m, text, marks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    data = text.encode()
                    for mark in marks or ():
                        h, x = mark["a"], mark["b"]
                        p, lo, hi = x >> 16, x >> 8 & 0xFF, x & 0xFF
                        runs = crowded_runs(data, h, x, length) if mark["kind"] == 2 else [(h, x, data[p - hi : p - lo + length])]
                        for h, x, context in runs:
                            for col, v in zip(out, (h, d, m, x, context), strict=True):
                                col.append(v)
                if out[0]:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["h", "d", "m", "x", "context"])

    def order(batches):
        held: list[tuple] = []
        size = 0

        def done(rows: list[tuple]) -> pa.RecordBatch | None:
            crowds = [list(same) for _, same in groupby(rows, itemgetter(0))]
            rows = [r for same in crowds if len(same) > 1 for r in same]  # alone, it equals nothing
            if not rows:
                return None
            h, d, m, x, context = zip(*rows, strict=True)
            runs = sort_contexts(np.array(h), np.array(d), np.array(m), np.array(x), list(context), length)
            return _found(0, *runs) if len(runs[0]) else None

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size > SORTED and row[0] != held[-1][0]:
                    if (out := done(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held and (out := done(held)) is not None:
            yield out

    # the same exchange of texts serves here and where the runs are cut out
    with_ends = texts.join(ends, ["d", "m"], "left").where("marks is not null")
    contexts = with_ends.select("d", "m", "text", "marks").mapInArrow(tidy(fetch), "h long, d long, m long, x long, context binary")
    contexts = contexts.repartition(shuffle_width(spark), "h").sortWithinPartitions("h")
    runs = found.where("kind = 0").unionByName(contexts.mapInArrow(tidy(order), FOUND))
    return runs.groupBy("d", "m").agg(F.collect_list(F.struct("a", "b")).alias("runs"))


def keyed(documents: DataFrame) -> DataFrame:
    """d, m, text: the id in order (null first), a text hash where ids repeat (else 0), the text."""
    twice = documents.groupBy("doc_id").count().where("count > 1").limit(1).count()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mark = F.xxhash64(text) if twice else F.lit(0).cast("long")
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("d"), mark.alias("m"), text.alias("text"))


def dedup_substrings(spark: SparkSession, documents: DataFrame, length: int = 100, kgram: int = 24, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, spans (list of begin, end of the maximal removed runs), kept (the remaining bytes)."""
    if not 1 <= kgram <= length or length - kgram > 255:
        raise ValueError("kgram must be at most length, and at most 255 below it")
    texts = keyed(documents)
    runs = repeated_runs(spark, texts, length, kgram, crowd)

    def cut(batches):
        for whole in batches:
            for b in (whole.slice(i, 200) for i in range(0, whole.num_rows, 200)):
                sizes, spans_, kept = [], [], []
                for text, runs_ in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    data, out, pieces, at = text.encode(), [], [], 0
                    for a, e in sorted((r["a"], r["b"]) for r in runs_ or ()):
                        if out and a <= out[-1][1]:
                            out[-1][1] = max(out[-1][1], e)
                        else:
                            out.append([a, e])
                    for a, e in out:
                        pieces.append(data[at:a])
                        at = e
                    pieces.append(data[at:])
                    sizes.append(len(data))
                    spans_.append([{"begin": a, "end": e} for a, e in out])
                    kept.append(b"".join(pieces))
                span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans_, span), pa.array(kept, pa.binary())], names=["d", "n_bytes", "spans", "kept"])

    joined = texts.join(runs, ["d", "m"], "left").select("d", "m", "text", "runs")
    out = joined.mapInArrow(tidy(cut), "d long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")
    return out.select(F.when(F.col("d") != LEAST, F.col("d")).alias("doc_id"), "n_bytes", "spans", "kept")


def op3_substrings(spark: SparkSession, documents: DataFrame) -> DataFrame:
    out = dedup_substrings(spark, documents)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["begin"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
