"""The pipeline's near-copies stage against brute force, on planted copies and clean documents."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from weftline.llm import nearcopies
from weftline.llm.simhash import text_mark


def shingle_set(text):
    found = (text or "").lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def planted():
    """Clean documents, copies of each with more and more words changed, a crowd of copies, a shared passage, nulls and short texts."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]

    def changed(words, n):
        out = list(words)
        for i in rng.sample(range(len(out)), n):
            out[i] = rng.choice(vocabulary)
        return out

    passage = say(60)
    texts = []
    for i in range(40):
        base = say(400)
        texts += [base] + [changed(base, n) for n in (2, 4, 6, 8, 9, 10, 14)]
        texts.append(passage + say(200))
    crowd = say(200)
    texts += [changed(crowd, rng.randint(1, 4)) for _ in range(120)]
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    return rows + [(5000, None), (5001, " "), (5002, "One two"), (5003, "one TWO"), (5004, "one"), (None, rows[0][1]), (0, rows[0][1])]


def brute_force(rows):
    """Each row's component, and the similar pairs."""
    sets = [shingle_set(x) for _, x in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = {}
    for i in range(len(rows)):
        for j in range(i):
            s = jaccard(sets[i], sets[j])
            if s >= 0.8:
                near[i, j] = min(int(s * 20), 19)
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], near


def test_near_copies_are_those_of_brute_force(spark):
    rows = planted()
    roots, near = brute_force(rows)
    in_band = Counter(near.values())
    assert all(in_band[x] > 30 for x in (16, 17, 18, 19))  # 0.8 to 0.85, and so on
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {(r.doc_id, r.mark): r.root for r in nearcopies.groups(spark, docs).collect()}
    marks = docs.select("doc_id", "text", text_mark().alias("mark")).collect()
    own = {(r.doc_id, r.text): found[r.doc_id, r.mark] for r in marks}
    mine = [own[r] for r in rows]
    true = {}
    for m, r in zip(mine, roots, strict=True):  # nothing is linked that isn't a copy
        assert true.setdefault(m, r) == r
    linked = Counter(band for (i, j), band in near.items() if mine[i] == mine[j])
    for band in in_band:  # the chance of a miss is that of no common anchor
        assert linked[band] >= (0.95 if band == 16 else 0.98) * in_band[band]
    kept = corpus_pipeline.one_of_near_copies(spark, docs, "").collect()
    assert len(kept) == len(set(mine)) and len(set(mine)) - len(set(roots)) <= 4
    least = {}
    for (i, _), m in zip(rows, mine, strict=True):
        least[m] = min(least.get(m, (True, 0)), (i is None, i if i is not None else 0))
    assert sorted((r.doc_id is None, r.doc_id if r.doc_id is not None else 0) for r in kept) == sorted(least.values())


def test_pairs_at_the_least_similarity_meet():
    rng = np.random.default_rng(3)
    for common, rest, least in ((288, 36, 0.95), (315, 26, 0.98), (8, 1, 0.9)):  # similarities 0.8, 0.86 and 0.8
        sets = [rng.integers(0, 1 << 63, common + 2 * rest, np.uint64) for _ in range(400)]
        a = np.array([nearcopies.margins(x[: common + rest]) for x in sets])
        b = np.array([nearcopies.margins(x[rest:]) for x in sets])
        z, y = (x / np.linalg.norm(x.astype(float), axis=1, keepdims=True) for x in (a, b))
        assert np.mean((z * y).sum(1) >= nearcopies.LEAST) >= (0.99 if common > 8 else 0.9)
        met = [len(np.intersect1d(x, y)) > 0 for x, y in zip(nearcopies.anchors(a), nearcopies.anchors(b), strict=True)]
        assert np.mean(met) >= least


def test_anchors_are_the_nearest_of_the_code():
    code = np.concatenate([nearcopies.half_code(), -nearcopies.half_code()], axis=1)
    apart = (24 - code.T @ code) / 2
    assert set(np.unique(apart)) == {0, 8, 12, 16, 24}
    votes = nearcopies.margins(np.random.default_rng(4).integers(0, 1 << 63, 300, np.uint64))[None]
    z = (votes.astype(np.float32) + nearcopies._TIE).reshape(nearcopies.PRINTS, nearcopies.BLOCKS, 24)
    at = nearcopies.anchors(votes).reshape(nearcopies.PRINTS, nearcopies.NEAR)
    numbered = {}
    for i in range(2048):
        for side in (0, 1):
            numbered[i << 1 | side] = nearcopies.half_code()[:, i] * (1 if side else -1)
    for p in range(nearcopies.PRINTS):
        gains = [z[p, b] @ code for b in range(nearcopies.BLOCKS)]
        x, y, w = (np.sort(g)[-nearcopies.CHOICES :] for g in gains)
        best = np.sort((x[:, None, None] + y[:, None] + w).ravel())[::-1][: nearcopies.NEAR]
        mine = [sum(float(z[p, b] @ numbered[int(k) >> 12 * (nearcopies.BLOCKS - 1 - b) & 4095]) for b in range(nearcopies.BLOCKS)) for k in at[p]]
        assert len(set(at[p].tolist())) == nearcopies.NEAR and np.allclose(sorted(mine, reverse=True), best, rtol=1e-4)
        assert (at[p] >> 36 == p).all()


def test_shared_streams_what_has_company(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 400), i) for i in range(500)] + [(7, 1000 + i) for i in range(300)] + [(1 << 37, 5)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {tuple(r) for r in nearcopies.shared(spark.createDataFrame(rows, "anchor long, node long"), 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for a in {a for a, _ in rows}:
        held = [v for b, v in rows if b == a]
        want |= {(a, v, min(held)) for v in held if len(held) > 1}
    assert got == want


def test_blocks_compare_all_pairs(spark, monkeypatch):
    """With small blocks every pair of different components that correlates is found, as without."""
    from weftline.llm.common import Scratch

    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 200, np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(200)[:180]], rng.integers(0, 1 << 63, 20, np.uint64)])) for _ in range(40)]
    nodes = spark.createDataFrame([(i, len(x), bytearray(nearcopies.margins(x).tobytes())) for i, x in enumerate(sets)], "node long, n long, votes binary")
    met = spark.createDataFrame([(5, i) for i in range(40)] + [(6, i) for i in range(3)], "anchor long, node long")
    roots = spark.createDataFrame([(i, 0) for i in range(12)], "node long, root long")
    got = {}
    for size in (2048, 7):
        monkeypatch.setattr(nearcopies, "BLOCK", size)
        left, _ = nearcopies._open(met, nodes, roots, Scratch(spark, "t"))
        got[size] = {tuple(r) for r in nearcopies._each_once(nearcopies.compared(left, True)).collect()}
    z = np.array([nearcopies.margins(x) for x in sets], float)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    want = {(i, j) for j in range(40) for i in range(j) if j >= 12 and z[i] @ z[j] >= nearcopies.LEAST}
    assert got[2048] == got[7] == want and len(want) > 30


def test_empty_and_clashing_tables(spark):
    named = "doc_id long, text string, own int, number int, node long, root string, d int, m int"
    assert corpus_pipeline.one_of_near_copies(spark, spark.createDataFrame([], named), "").collect() == []
    rows = [(i, "one two three", 1, 2, 3, "4", 5, 6) for i in (3, 2, 2, None)]
    got = corpus_pipeline.one_of_near_copies(spark, spark.createDataFrame(rows, named), "").collect()
    assert [tuple(r) for r in got] == [(2, "one two three", 1, 2, 3, "4", 5, 6)]
