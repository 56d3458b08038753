"""Near copies by SimHash: documents whose sets of five-word shingles have a Jaccard similarity of at least 4/5, over any number of links.

A text has ``PRINTS`` independent SimHash fingerprints of 72 bits. Next to each bit its margin is kept: how far
the shingles' votes are from a tie. Anchors are the products of three codewords of the extended Golay code
(length 24, distance 8, covering radius 4), 2^36 for each fingerprint. The distance of a fingerprint to an anchor
counts each differing bit by its margin, and a fingerprint is replicated to its ``NEAR`` nearest anchors: those
within its distance to the code plus a threshold that has room for so many. Bits near a tie, which are those that
differ between near copies, so cost little. Fingerprints that meet at an anchor are compared.

How many links are found: two texts at exactly 0.8 differ in 15% of the bits and meet with a chance of 0.98 (by
simulation, and in the test), at 0.85 with 0.998. 72 equal random bits are unlikely at any size: unrelated texts
meet at an anchor once in 2^36 / NEAR^2 pairs.

Fingerprints that meet are compared by the correlation of all their margins, which is that of the shingle sets with
an error of 0.012; similar sets have 0.889 or more, and pairs below ``LEAST`` (four errors less) are no candidates.
Each candidate is verified on the whole sets of 64-bit shingle hashes. Texts of equal sets are one node.

1. Each node is verified against three others at most, the least of all that share an anchor with it in three
   orders; copies of one text agree on these, so a group of any size takes rows in proportion to it.
2. At the first fingerprint's anchors whose nodes still are in several components, each node outside the largest one
   is compared with all nodes of other components, and verified against the nearest of each anchor, ``NEAREST`` in all.
   That links most of a large group's nodes for a quarter of the comparisons.
3. What then still is in several components at any anchor is compared likewise, and every candidate verified.

Pairs already in one component need no comparison, so nothing is lost by it. An anchor with many nodes is compared
in blocks of ``BLOCK`` nodes, each pair of blocks by a task of its own.

Defined cases: null and empty texts, and those of white space, have no shingles and are copies of each
other; a text of fewer than five words is one shingle; ids as in ``simhash``; the columns of the input are kept,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_width, slots, spare_name, tidy, with_slot
from .simhash import components, text_mark
from .words import shingle_hashes

#: Fingerprints of a text, each of BLOCKS codewords of 24 bits; anchors each is replicated to, and the codewords of a block that are looked at.
PRINTS, BLOCKS, NEAR, CHOICES = 4, 3, 32, 8
SIZE = 24 * BLOCKS * PRINTS
#: The least correlation of margins of candidates, how many nearest ones a node is verified against at first, and nodes compared at a time.
LEAST, NEAREST, BLOCK = 0.84, 4, 2048
#: The least similarity, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Shingles hashed at a time, and texts a batch.
CHUNK, BATCH = 4096, 200
#: Generator polynomial of the cyclic Golay code of length 23.
GOLAY = 0b101011100011
#: A margin of one standard deviation, as stored.
UNIT = 32

_RNG = np.random.default_rng(11)
_TIMES = _RNG.integers(0, 1 << 63, -(-SIZE // 64), np.uint64) * np.uint64(2) + np.uint64(1)
#: Breaks ties between anchors alike for all texts.
_TIE = _RNG.uniform(-1, 1, SIZE).astype(np.float32)


def half_code() -> np.ndarray:
    """(24, 2048) codewords of the extended Golay code as signs, one of each complementary pair."""
    numbers = np.arange(2048, dtype=np.int64)
    words = np.zeros_like(numbers)
    for i in range(11):
        words ^= np.where(numbers >> i & 1, GOLAY << i, 0)
    odd = np.bitwise_count(words.astype(np.uint64)).astype(np.int64) & 1
    words |= odd << 23
    return (2.0 * (words[None, :] >> np.arange(24)[:, None] & 1) - 1).astype(np.float32)


_CODE = half_code()


def shingles(text: str | None) -> np.ndarray:
    """The text's distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes((text or "").encode()))


def margins(found: np.ndarray) -> np.ndarray:
    """Of each bit, how many standard deviations its votes are from a tie, times UNIT, as bytes; the bit is 1 above 0."""
    ones = np.zeros(64 * len(_TIMES), np.int64)
    for lo in range(0, len(found), CHUNK):
        h = found[lo : lo + CHUNK, None] * _TIMES
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    n = max(1, len(found))
    return np.clip(np.rint((2 * ones[:SIZE] - n) * (UNIT / np.sqrt(n))), -127, 127).astype(np.int8)


def anchors(votes: np.ndarray) -> np.ndarray:
    """(texts, PRINTS * NEAR) anchors of (texts, SIZE) margins."""
    n = len(votes)
    z = (votes.astype(np.float32) + _TIE).reshape(-1, 24)
    near = z @ _CODE
    np.abs(near, out=near)
    at = np.argpartition(near, 2048 - CHOICES, axis=1)[:, 2048 - CHOICES :]
    gain = np.take_along_axis(near, at, 1).reshape(n * PRINTS, BLOCKS, CHOICES)
    del near
    side = np.einsum("ij,jik->ik", z, _CODE[:, at]) > 0
    word = (at.astype(np.int64) << 1 | side).reshape(n * PRINTS, BLOCKS, CHOICES)
    total, key = gain[:, 0], word[:, 0]
    for b in range(1, BLOCKS):
        total = (total[:, :, None] + gain[:, b, None, :]).reshape(len(total), -1)
        key = (key[:, :, None] << 12 | word[:, b, None, :]).reshape(len(key), -1)
        if total.shape[1] > NEAR:
            best = np.argpartition(total, total.shape[1] - NEAR, axis=1)[:, total.shape[1] - NEAR :]
            total, key = np.take_along_axis(total, best, 1), np.take_along_axis(key, best, 1)
    number = np.tile(np.arange(PRINTS, dtype=np.int64) << 12 * BLOCKS, n)
    return (key | number[:, None]).reshape(n, -1)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


def _node(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def printed(documents: DataFrame) -> DataFrame:
    """doc_id, mark, node (the hash of the shingles), n (how many), votes (the margins)."""

    def run(batches):
        for whole in batches:
            for b in (whole.slice(i, BATCH) for i in range(0, whole.num_rows, BATCH)):
                node, n, votes = [], [], []
                for x in b.column(2):
                    found = shingles(x.as_py())
                    node.append(_node(found))
                    n.append(len(found))
                    votes.append(margins(found).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(votes, pa.binary())], names=["doc_id", "mark", "node", "n", "votes"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark().alias("mark"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(run), "doc_id long, mark long, node long, n long, votes binary")


def replicated(nodes: DataFrame) -> DataFrame:
    """anchor, node: each node with votes at its anchors."""

    def run(batches):
        for whole in batches:
            for b in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                votes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int8).reshape(-1, SIZE)
                at = anchors(votes)
                who = np.repeat(b.column(0).to_numpy(), at.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), pa.array(who)], names=["anchor", "node"])

    return nodes.select("node", "votes").mapInArrow(tidy(run), "anchor long, node long")


def shared(met: DataFrame, parts: int) -> DataFrame:
    """Those of the rows (anchor, node) whose anchor has several nodes, with ``least``, the anchor's least node."""

    def run(batches):
        last = None  # the row whose anchor may go on, and whether it has been given
        for b in batches:
            a, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(a):
                continue
            if last is not None:
                a, v = np.concatenate([[last[0]], a]), np.concatenate([[last[1]], v])
            new = np.concatenate([[True], a[1:] != a[:-1]])
            starts = np.nonzero(new)[0]
            run_of = np.cumsum(new) - 1
            least = v[starts]
            if last is not None:
                least[0] = last[2]
            several = ~(new & np.concatenate([new[1:], [True]]))
            given = last is not None and last[3]
            if given and len(a) > 1:
                several[0] = False
            out = np.nonzero(several)[0]
            gone = bool(several[-1]) or (given and starts[-1] == 0)
            last = (a[-1], v[-1], least[-1], gone)
            if given:
                out = out[out > 0]
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(a[out]), pa.array(v[out]), pa.array(least[run_of[out]])], names=["anchor", "node", "least"])

    dealt = met.repartition(parts, "anchor").sortWithinPartitions("anchor", "node")
    return dealt.mapInArrow(tidy(run), "anchor long, node long, least long")


def with_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles (bytes of 64-bit hashes) of the wanted rows (doc_id, mark, node), which stand for a node each."""

    def run(batches):
        for whole in batches:
            for b in (whole.slice(i, BATCH) for i in range(0, whole.num_rows, BATCH)):
                raw = [shingles(x.as_py()).tobytes() for x in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["node", "shingles"])

    texts = documents.select(F.col("doc_id").cast("long").alias("d"), text_mark().alias("m"), F.col("text").cast("string").alias("text"))
    texts = with_slot(texts, F.col("m"), slots(wanted, "mark"), "may").where("may")
    mine = texts["d"].eqNullSafe(wanted["doc_id"]) & (texts["m"] == wanted["mark"])
    return texts.join(wanted, mine).select("node", "text").mapInArrow(tidy(run), "node long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of nodes that are similar; a node that many have as v is dealt out by Spark's skew join."""
    a, b = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))

    def run(batches):
        for whole in batches:
            for x in (whole.slice(i, BATCH) for i in range(0, whole.num_rows, BATCH)):
                ok = [similar(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)) for p, q in zip(x.column(2), x.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b")
    return both.mapInArrow(tidy(run), "u long, v long")


def _close(a: str, b: str):
    """Whether sets of those sizes can be similar."""
    return DENOMINATOR * F.least(a, b) >= NUMERATOR * F.greatest(a, b)


def _star(open_: DataFrame) -> DataFrame:
    """u, v: each node u with the least others that share an anchor with it, in three orders."""
    node = F.col("node")
    order = [lambda c, i=i: F.xxhash64(c, F.lit(i)) for i in (1, 2)]
    ends = open_.groupBy("anchor").agg(*[F.min(F.struct(h(node).alias("h"), node.alias("v"))).alias(f"e{i}") for i, h in enumerate(order)])
    met = open_.join(ends, "anchor")
    best = met.groupBy("node").agg(F.min("least").alias("v0"), F.min("e0").alias("e0"), F.min("e1").alias("e1"))
    pairs = best.select(F.col("node").alias("u"), F.explode(F.array("v0", "e0.v", "e1.v")).alias("v"))
    return pairs.where("u != v").distinct()


def compared(rows: DataFrame, every: bool) -> DataFrame:
    """u, v, corr: nodes of different components that correlate and have sizes that can be similar.

    rows: anchor, i, j (the pair of the anchor's blocks), block, node, n, root, main, votes. u is outside the
    anchor's largest component; of its partners at an anchor the nearest is given, or every one.
    """

    def pairs(held: list[tuple]) -> list[tuple]:
        block, node, n, root, main = (np.array(x) for x in zip(*[r[:5] for r in held], strict=True))
        z = np.frombuffer(b"".join(r[5] for r in held), np.int8).reshape(-1, SIZE).astype(np.float32)
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        two = held[0][6]
        mine = np.nonzero(root != main)[0]
        out = []
        for lo in range(0, len(mine), 512):
            at = mine[lo : lo + 512]
            corr = z[at] @ z.T
            small, large = np.minimum(n[at, None], n), np.maximum(n[at, None], n)
            ok = (root[at, None] != root) & (DENOMINATOR * small >= NUMERATOR * large) & (corr >= LEAST)
            if two:
                ok &= block[at, None] != block
            if every:
                x, y = np.nonzero(ok)
            else:
                corr = np.where(ok, corr, -1)
                x, y = np.arange(len(at)), corr.argmax(1)
                good = corr[x, y] >= LEAST
                x, y = x[good], y[good]
            out += zip(node[at[x]].tolist(), node[y].tolist(), np.round(corr[x, y].astype(float), 4).tolist(), strict=True)
        return out

    def run(batches):
        now, held = None, []

        def done() -> pa.RecordBatch:
            found = pairs(held)
            u, v, corr = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(corr, pa.float64())], names=["u", "v", "corr"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:3] != now:
                    if len(held) > 1:
                        yield done()
                    now, held = row[:3], []
                held.append((*row[3:], row[1] != row[2]))
        if len(held) > 1:
            yield done()

    key = ["anchor", "i", "j"]
    dealt = rows.select(*key, "block", "node", "n", "root", "main", "votes").repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(tidy(run), "u long, v long, corr double")


def _open(open_: DataFrame, nodes: DataFrame, roots: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[str]]:
    """The rows of ``compared`` for the anchors whose nodes are in several components, and the written paths."""
    held, held_at = scratch.write(open_.select("anchor", "node").join(roots, "node", "left").select("anchor", "node", F.coalesce("root", "node").alias("root")))
    sizes, sizes_at = scratch.write(held.groupBy("anchor", "root").agg(F.count(F.lit(1)).alias("k")))
    several = sizes.groupBy("anchor").agg(F.max(F.struct("k", "root")).alias("x"), F.count(F.lit(1)).alias("roots"), F.sum("k").alias("all")).where("roots > 1")
    main, main_at = scratch.write(several.select("anchor", F.col("x.root").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks")))
    rows = held.join(main, "anchor").join(nodes.select("node", "n", "votes"), "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return rows, [held_at, sizes_at, main_at]


def _each_once(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def groups(spark: SparkSession, documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, mark, root: rows of one root are near copies of each other, over any number of links."""
    scratch = scratch or Scratch(spark, "nearcopies")
    rows, _ = scratch.write(printed(documents))
    first = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "mark")
    nodes, nodes_at = scratch.write(rows.groupBy("node").agg(F.min(first).alias("of"), F.max("n").alias("n"), F.max("votes").alias("votes")))
    dealt = nodes.where("n > 0").repartition(shuffle_width(spark), "node")
    open_, open_at = scratch.write(shared(replicated(dealt), shuffle_width(spark)))
    size = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(c + "n"))
    one, one_at = scratch.write(_each_once(_star(open_).join(size("u"), "u").join(size("v"), "v").where(_close("un", "vn"))))
    wanted = nodes.join(open_.select("node").distinct(), "node", "left_semi").select("of.doc_id", "of.mark", "node")
    sets, sets_at = scratch.write(with_sets(documents, wanted).dropDuplicates(["node"]))
    links, links_at = scratch.write(verified(one, sets))
    roots = components(links, scratch)
    scratch.drop(one_at, links_at)
    for every in (False, True):
        left, paths = _open(open_ if every else open_.where(F.col("anchor") < 1 << 12 * BLOCKS), nodes, roots, scratch)
        found, found_at = scratch.write(compared(left, every))
        if not every:  # of a node's nearest partners at its anchors, which are bounded in number, the nearest of all
            best = found.groupBy("u").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("corr")).alias("far"), "v"))), 1, NEAREST).alias("x"))
            found = best.select("u", F.explode("x.v").alias("v"))
        pairs, pairs_at = scratch.write(_each_once(found))
        links, links_at = scratch.write(verified(pairs, sets))
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links), scratch)
        scratch.drop(*paths, found_at, pairs_at, links_at)
    scratch.drop(nodes_at, open_at, sets_at)
    return rows.select("doc_id", "mark", "node").join(roots, "node", "left").select("doc_id", "mark", F.coalesce("root", "node").alias("root"))


def drop_near_copies(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """One document of each group, that of the least id (of the least text hash among rows that share it; null ids last)."""
    scratch = Scratch(spark, "nearcopies")
    rows, rows_at = scratch.write(groups(spark, documents, scratch))
    each, each_at = scratch.write(rows.groupBy("root", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n")))
    first, first_at = scratch.write(each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("x")))
    split = each.join(first, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("mark") == F.col("x.mark")))
    # what goes, and rows equal in id and text of which one stays
    gone = scratch.table(split.where("not stays or n > 1").select("doc_id", "mark", "stays"))
    scratch.drop(rows_at, each_at, first_at)
    names = documents.columns
    own, may, number, stays = spare_name(names, "own"), spare_name(names, "may"), spare_name(names, "number"), spare_name(names, "stays")
    marked = with_slot(documents.withColumn(own, text_mark()), F.col(own), slots(gone, "mark"), may)
    free = marked.where(~F.col(may)).select(*names)
    listed = gone.select(F.col("doc_id").alias(may), F.col("mark").alias(number), F.col("stays").alias(stays))
    rest = marked.where(may).drop(may)
    rest = rest.join(listed, rest["doc_id"].cast("long").eqNullSafe(listed[may]) & (rest[own] == listed[number]), "left").where(f"coalesce(`{stays}`, true)")
    single = rest.where(F.col(stays).isNull()).select(*names)
    if gone.where("stays").limit(1).count():
        one = F.row_number().over(Window.partitionBy("doc_id", own).orderBy(own))
        again = rest.where(F.col(stays).isNotNull()).select(*names, own).withColumn(number, one).where(F.col(number) == 1).select(*names)
        single = single.unionByName(again)
    return free.unionByName(single)
