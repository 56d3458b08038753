"""Every stage of the pipeline against a plain version, each on what its predecessor kept."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_nearcopies import brute_force
from test_operators import SPACE, made_up, words_of

import corpus_pipeline
from weftline.llm import quality

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    """(doc_id, text, lang, source, n_chars) and labels: the awkward rows, good and bad documents, near copies, repeats."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(1500)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(d, t, lang, s) for d, t, lang, s in made_up()]
    labels = []
    for i in range(200, 320):
        bad = i % 3 == 0
        rows.append((i, "$$$ !!! 77 " * 30 + "BUY | NOW | " * 20 if bad and i % 2 else "x1 | 9 | " * 60 + say(3) if bad else say(80).capitalize() + ".\n" + say(40) + ".", "en", "abc"[i % 3]))
        labels.append((i, int(not bad), 0))
    for i in range(400, 412):
        base = say(300).split()
        rows.append((10 * i, " ".join(base), "en", "a"))
        for k in range(1, 4):
            changed = list(base)
            for at in rng.sample(range(300), 2 * k):
                changed[at] = rng.choice(vocabulary)
            rows.append((10 * i + k, " ".join(changed), "en", "b"))
    rows += [rows[-1], rows[-1], (None, "no id at all " + say(20), None, None), (None, "no id at all " + say(30), "en", None)]
    return [(*r, len(r[1] or "")) for r in rows], labels + [(None, 1, None), (5, None, None), (99999, 1, 0), (200, 1, 1)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{name}.parquet")
        docs = spark.read.parquet(f"{folder}/{name}.parquet")
        out[name] = docs.collect()
    out["folder"], out["labels"] = str(folder), labels
    return out


def test_quality_is_the_direct_fit(stages):
    good = {d: q for d, q, _ in stages["labels"] if q is not None}
    pairs = [(r.text, q) for r in stages["documents"] for d, q, _ in stages["labels"] if q is not None and d is not None and d == r.doc_id]
    stat = lambda texts: np.vstack([quality.statistics(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())])) for t in texts]).astype("<f4").astype(float)
    s, y = stat([t for t, _ in pairs]), np.array([q for _, q in pairs], float)
    m = quality.QualityModel(mean=s.mean(0), scale=np.sqrt(np.maximum((s**2).mean(0) - s.mean(0) ** 2, 1e-6)))
    rng = np.random.default_rng(11)
    m.omega, m.phase = rng.normal(0, np.sqrt(0.1), (quality.DIM, 192)), rng.uniform(0, 2 * np.pi, 192)

    def weights(at):
        phi, w = m.features(s[at]), np.where(y[at] == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        penalty = np.full(phi.shape[1], 1e-3 * at.sum())
        penalty[-1] = 1e-9 * at.sum()
        return np.linalg.solve(phi.T @ (w[:, None] * phi) + np.diag(penalty), phi.T @ (w * y[at]))

    fold = quality.fold_of(s)
    raw = np.zeros(len(y))
    for f in range(quality.FOLDS):
        raw[fold == f] = m.features(s[fold == f]) @ weights(fold != f)
    edges = np.linspace(-0.5, 1.5, 401)
    at = np.clip(np.searchsorted(edges, raw) - 1, 0, 399)
    total, ones = np.bincount(at, minlength=400), np.bincount(at, weights=y, minlength=400)
    prior = (y.sum() + 1) / (len(y) + 2)
    level = quality.isotonic((ones[total > 0] + prior) / (total[total > 0] + 1), total[total > 0])
    score = np.interp(m.features(stat([r.text for r in stages["documents"]])) @ weights(np.ones(len(y), bool)), (edges[:-1] + 0.0025)[total > 0], np.clip(level, 0, 1))
    sure = np.abs(score - 0.3) > 1e-6
    want = Counter((r.doc_id, r.text) for r, x in zip(stages["documents"], score, strict=True) if x >= 0.3)
    assert sure.all() and Counter((r.doc_id, r.text) for r in stages["quality"]) == want
    kept = {r.doc_id for r in stages["quality"]}
    marked = [d for d in good if d is not None and 200 < d < 320]
    assert np.mean([(d in kept) == bool(good[d]) for d in marked]) > 0.95


def test_lines_are_those_of_brute_force(stages):
    key = lambda x: x.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for r in stages["quality"]:
        for x in (r.text or "").split("\n"):
            holders[key(x)].add(r.doc_id)
    keeper = {k: max(v, key=lambda d: (d is not None, d)) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    want = Counter()
    for r in stages["quality"]:
        text = None if r.text is None else "\n".join(x for x in r.text.split("\n") if key(x) not in keeper or keeper[key(x)] == r.doc_id)
        want[r.doc_id, text, r.lang, r.source, None if text is None else len(text)] += 1
    assert Counter(tuple(r) for r in stages["lines"]) == want and keeper


def test_near_copies_leave_one_of_each(stages):
    rows = [(r.doc_id, r.text) for r in stages["lines"]]
    roots, _ = brute_force(rows)
    first = {}
    for i, r in enumerate(roots):
        key = (rows[i][0] is None, rows[i][0] or 0)
        first[r] = min(first.get(r, (True, 1 << 62)), key)
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in stages["near_copies"])
    assert kept == sorted(first.values()) and len(kept) < len(rows) - 36
    assert {tuple(r) for r in stages["near_copies"]} <= {tuple(r) for r in stages["lines"]}


def test_mix_takes_near_its_targets(stages):
    size = lambda r: len(words_of(r.text))
    totals, taken = Counter(), Counter()
    before = Counter(tuple(r) for r in stages["near_copies"])
    after = Counter(tuple(r) for r in stages["mix"])
    for r in stages["near_copies"]:
        totals[r.source] += size(r)
    for r in stages["mix"]:
        taken[r.source] += size(r)
    assert all(after[k] <= 2 * before[k] for k in after)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(totals, key=lambda s: (s is None, s or "")))}
    open_, left, target = set(totals), 1.5 * sum(totals.values()), {}
    while over := {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * totals[s]}:
        target |= {s: 2 * totals[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    for s in totals:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 20


def test_packing_holds_every_id_once(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in stages["mix"])
    assert Counter((r.doc_id, r.doc_tokens) for r in stages["pack"] if r.start == 0) == want
    assert sum(r.length for r in stages["pack"]) == sum(n * k for (_, n), k in want.items())
    held = defaultdict(list)
    for r in stages["pack"]:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096


def test_run_is_the_chain_of_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, stages["folder"]).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, got)) == sorted(map(key, stages["pack"]))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
