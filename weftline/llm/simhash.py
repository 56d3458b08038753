"""SimHash near-duplicates by anchor-point covering.

A fingerprint has bit i set if more than half of the text's shingle hashes have it. Fingerprints link
if they differ in at most ``bits`` bits; documents whose fingerprints are linked, over any number of
links, form a component.

Finding links: a covering code on the 64 bits - the product of two perfect Golay codes of length 23
(radius 3), two Hamming codes of length 7 (radius 1) and a free rest of 4 bits - is the set of anchors.
Every point has its nearest anchor. A point between two linked fingerprints lies within ceil(bits / 2)
of both, so each fingerprint is replicated to the nearest anchors of all points that near: anchors
within the covering radius plus that part of the threshold, and only those that can matter. Two linked
fingerprints meet at one anchor at least; fingerprints at the same anchor are compared.

An anchor with more than ``dense`` fingerprints (which lie close together, as equal ones are one) is
not compared pair by pair: its fingerprints are replicated to the points around them themselves, the
code of radius 0. For an even threshold those that share such a point are linked for sure, so a star
of links is enough; the number of rows stays in proportion to the fingerprints. No link between
components is lost, and none is counted that isn't there.

Components are found by alternating large-star and small-star steps on the links, each written to
the shared folder; no link or fingerprint comes to the driver.

Defined cases: null and empty texts, and those of white space, have fingerprint 0 and link with each
other as any; rows that share an id are documents of their own with one label; rows with a null id are
fingerprinted, and represented by the least id among equal texts' rows, else by null; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shuffle_width, tidy

#: Lengths of the code's blocks from the lowest bit; what is left of 64 bits is free.
BLOCKS = (23, 23, 7, 7)
#: Generator polynomials of the cyclic codes, and their radius.
POLYNOMIAL = {23: (0b101011100011, 3), 7: (0b1011, 1)}
#: Shingles hashed at a time.
CHUNK = 1 << 16


@lru_cache(maxsize=4)
def nearest(length: int) -> np.ndarray:
    """Every word's nearest codeword, as its number, of the perfect cyclic code of that length."""
    generator, radius = POLYNOMIAL[length]
    degree = generator.bit_length() - 1
    numbers = np.arange(1 << (length - degree), dtype=np.int64)
    words = np.zeros_like(numbers)
    for i in range(length - degree):
        words ^= np.where(numbers >> i & 1, generator << i, 0)
    table = np.full(1 << length, -1, np.int16)
    for r in range(radius + 1):
        for flips in combinations(range(length), r):
            table[words ^ sum(1 << f for f in flips)] = numbers
    return table


def _block_flips(values: np.ndarray, length: int, most: int) -> list[np.ndarray]:
    """For r = 0..most, the (n, choices) nearest codewords after flipping r of the block's bits."""
    table = nearest(length)
    out = []
    for r in range(most + 1):
        masks = np.array([sum(1 << f for f in c) for c in combinations(range(length), r)], np.int64)
        out.append(table[values[:, None] ^ masks[None, :]].astype(np.int64))
    return out


def anchors(prints: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(which fingerprint, anchor): the distinct nearest anchors of all points within ``reach`` flips of each fingerprint."""
    n, at, shift = len(prints), 0, 0
    total: list[list[np.ndarray]] = [[np.zeros((n, 1), np.int64)]] + [[] for _ in range(reach)]
    for length in BLOCKS:
        values = (prints >> np.uint64(at) & np.uint64((1 << length) - 1)).astype(np.int64)
        flips = _block_flips(values, length, min(reach, length))
        grown: list[list[np.ndarray]] = [[] for _ in range(reach + 1)]
        for used, parts in enumerate(total):
            for part in parts:
                for r, choices in enumerate(flips):
                    if used + r <= reach:
                        grown[used + r].append((part[:, :, None] | choices[:, None, :] << shift).reshape(n, -1))
        # what is reached with fewer flips need not be reached again with more
        total = [[_distinct_rows(np.concatenate(g, axis=1))] if g else [] for g in grown]
        at += length
        shift += int(nearest(length).max()).bit_length()
    every = _distinct_rows(np.concatenate([p for parts in total for p in parts], axis=1))
    keep = np.ones(every.shape, bool)
    keep[:, 1:] = every[:, 1:] != every[:, :-1]
    who, _ = np.nonzero(keep)
    return who, every[keep]


def _distinct_rows(a: np.ndarray) -> np.ndarray:
    """Each row sorted, its repeats moved together; columns that repeat in all rows go."""
    a = np.sort(a, axis=1)
    if a.shape[1] < 2:
        return a
    same = a[:, 1:] == a[:, :-1]
    most = a.shape[1] - int(same.sum(1).min()) if len(a) else a.shape[1]
    if most == a.shape[1]:
        return a
    out = np.repeat(a[:, :1], most, axis=1)
    fresh = np.concatenate([np.ones((len(a), 1), bool), ~same], axis=1)
    rank = np.cumsum(fresh, axis=1) - 1
    rows, cols = np.nonzero(fresh)
    out[rows, rank[rows, cols]] = a[rows, cols]
    return np.sort(out, axis=1)


def points(prints: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(which fingerprint, point) of all points within ``reach`` flips: the covering code of radius 0."""
    masks = np.array([sum(1 << f for f in c) for r in range(reach + 1) for c in combinations(range(64), r)], np.uint64)
    return np.repeat(np.arange(len(prints)), len(masks)), (prints[:, None] ^ masks[None, :]).ravel().view(np.int64)


def fingerprint(text: str | None, words: int = 3) -> int:
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    ones, n = np.zeros(64, np.int64), max(1, len(found) - words + 1)
    hashed = xxhash.xxh64_intdigest
    for lo in range(0, n, CHUNK):
        part = found[lo : min(n, lo + CHUNK) + words - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(part) - words + 1)].tolist()
        stops = ends[min(words, len(part)) - 1 :].tolist()
        h = np.array([hashed(line[a:b], 42) for a, b in zip(begins, stops, strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def text_mark() -> Column:
    """A hash that tells apart rows that share an id."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def with_fingerprint(documents: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, mark (the text's hash), fp (the 64 bits as a signed number)."""

    def run(batches):
        for b in batches:
            got = np.array([fingerprint(t.as_py(), words) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.int64())], names=["doc_id", "mark", "fp"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark().alias("mark"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(run), "doc_id long, mark long, fp long")


def _replicated(prints: DataFrame, how: callable, reach: int) -> DataFrame:
    """fp, anchor."""
    step = 2000 if reach < 2 else 100

    def run(batches):
        for b in batches:
            all_ = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, len(all_), step):
                fp = all_[lo : lo + step]
                who, at = how(fp.view(np.uint64), reach)
                yield pa.RecordBatch.from_arrays([pa.array(fp[who]), pa.array(at)], names=["fp", "anchor"])

    return prints.select("fp").mapInArrow(tidy(run), "fp long, anchor long")


def links(prints: DataFrame, bits: int, scratch: Scratch, dense: int = 64) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp). Every pair that differs in at most ``bits`` bits is linked, directly or over others."""
    reach = -(-bits // 2)
    dealt = prints.select("fp").repartition(shuffle_width(scratch.spark), "fp")  # a row becomes many, so rows are spread first
    met, met_at = scratch.write(_replicated(dealt, anchors, reach))
    sizes = scratch.table(met.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = scratch.table(met.join(sizes, "anchor"))
    scratch.drop(met_at)
    small = shared.where(F.col("n") <= dense)
    a, b = small.select("anchor", F.col("fp").alias("u")), small.select("anchor", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits
    pairs = a.join(b, "anchor").where((F.col("u") < F.col("v")) & near).select("u", "v")
    crowded = shared.where(F.col("n") > dense).select("fp").distinct()
    # two points within bits / 2 of a third are within bits of each other; an odd threshold's last step goes from point to fingerprint
    around = scratch.table(_replicated(crowded, points, bits // 2))
    if bits % 2:
        far = _replicated(crowded, points, reach)
        star = around.groupBy("anchor").agg(F.min("fp").alias("u")).join(far.withColumnRenamed("fp", "v"), "anchor").where(near & (F.col("u") != F.col("v"))).select("u", "v")
    else:
        star = around.groupBy("anchor").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1").join(around, "anchor").where("u != fp").select("u", F.col("fp").alias("v"))
    return pairs.unionByName(star).distinct()


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """node, root: the least node of each node's component, for all nodes with an edge (u, v)."""
    now, path = scratch.write(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # least numbers are summed up before the shuffle, and written, so that Spark can split the joins at a node with many links
        least, least_at = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large, large_at = scratch.write(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        scratch.drop(least_at)
        least, least_at = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, new_path = scratch.write(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(path, large_at, least_at)
        now, path = new, new_path
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def groups(spark: SparkSession, documents: DataFrame, words: int = 3, bits: int = 2, dense: int = 64) -> DataFrame:
    """doc_id, mark, fp, root, component: every document's fingerprint, its component and the least id in it."""
    scratch = Scratch(spark, "simhash")
    printed = scratch.table(with_fingerprint(documents, words))
    prints = scratch.table(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(prints, bits, scratch, dense)
    roots = components(edges, scratch)
    at = scratch.table(prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    least = scratch.table(at.groupBy("root").agg(F.min("least").alias("component")))
    named = scratch.table(at.join(least, "root").select(F.col("fp").alias("own"), "root", "component"))
    return printed.join(named, F.col("fp") == F.col("own")).select("doc_id", "mark", "fp", "root", "component")


def op2_simhash(spark: SparkSession, documents: DataFrame) -> DataFrame:
    found = groups(spark, documents)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
