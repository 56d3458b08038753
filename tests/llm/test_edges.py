"""Rows that share ids or have none, images that are none, tokenizers of another kind, names that are taken."""

import hashlib
import random
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import brute_substrings, made_up, words_of

from weftline.llm import langid, lines, media, mixing, packing, sketch, suffixes


def bmp(pixels, depth, masks=None, palette=None, top_down=False):
    """pixels: rows of bytes, each a row's samples."""
    step = -(-len(pixels[0]) // 4) * 4
    body = b"".join(x.ljust(step, b"\0") for x in (pixels if top_down else pixels[::-1]))
    width = len(pixels[0]) * 8 // depth
    extra = (struct.pack("<III", *masks) if masks else b"") + (b"".join(bytes([*c[::-1], 0]) for c in palette) if palette else b"")
    head = struct.pack("<IiiHHIIiiII", 40, width, -len(pixels) if top_down else len(pixels), 1, depth, 3 if masks else 0, len(body), 0, 0, len(palette or ()), 0)
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(extra)) + head + extra + body


def test_images_of_all_kinds():
    red, blue, grey = (255, 0, 0), (0, 0, 255), (9, 9, 9)
    rgb = [[red, blue, grey], [grey, red, blue]]
    rows = [b"".join(bytes(p[::-1]) for p in r) for r in rgb]
    for top_down in (False, True):
        assert (media.decode(bmp(rows, 24, top_down=top_down)) == rgb).all()
    assert (media.decode(bmp([b"\0\1\2", b"\2\0\1"], 8, palette=[red, blue, grey])) == rgb).all()
    assert (media.decode(bmp([b"\0\1", b"\1\1"], 8, palette=[(3, 3, 3), (7, 7, 7)])) == [[3, 7], [7, 7]]).all()
    packed = [struct.pack("<I", 1023 << 20 | 512 << 10 | 0)]
    assert (media.decode(bmp(packed, 32, masks=(1023 << 20, 1023 << 10, 1023))) == [[[255, 128, 0]]]).all()
    assert (media.decode(b"P1 3 1 101") == [[0, 255, 0]]).all() and (media.decode(b"P4\n10 1\n" + bytes([0b10000000, 0b01000000])) == [[0, *[255] * 8, 0]]).all()
    assert (media.decode(b"P3 2 1 255 1 2 3 4 5 6") == [[[1, 2, 3], [4, 5, 6]]]).all() and (media.decode(b"P6 1 1 255\n\1\2\3") == [[[1, 2, 3]]]).all()
    wide = media.decode(b"P5 2 1 65535\n" + struct.pack(">HH", 65535, 7))
    assert wide.dtype == np.uint16 and wide.tolist() == [[65535, 7]]
    assert media.decode(b"P2 3 1 15 0 15 5").tolist() == [[0, 255, 85]] and media.decode(b"P2 2 1 1000 500 1000").tolist() == [[32768, 65535]]


def test_what_is_no_image_has_a_reason(spark):
    bad = [b"P5 99999999999999999999 9 255\nxx", b"P2 1 1 255 99999999999999999999999", b"P2 1 1 255 300", b"P2 1 1 255 -3", b"P5 1 1 100\n\xff", b"P6 100000 100000 255\n", bmp([b"\0" * 4], 32, masks=(5, 2, 8)), b"BM" + b"\xff" * 60, b"", b"P", b"P4 1000000000 1000000000\n"]
    rows = [(i, x) for i, x in enumerate([*bad, None, b"P2 1 1 255 7"])]
    got = {r.i: r for r in media.media_features(spark.createDataFrame(rows, "i int, media binary")).collect()}
    assert all(got[i].media_error and got[i].width is None for i in range(len(bad)))
    assert got[len(bad)].media_error is None and got[len(bad)].tile is None and got[len(bad) + 1].width == 1


def test_sketches_of_groups(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(0, 60))) for _ in range(60)]
    rows = [(i % 4, texts[i % 60], 1, "x") for i in range(240)] + [(9, None, 1, "x")]
    docs = spark.createDataFrame(rows, "g int, text string, salt int, distinct string").repartition(5)
    got = {r.g: r for r in sketch.merge_sketches(sketch.with_sketch(docs), ["g"], salts=3).collect()}
    for g in (0, 1, 2, 3, 9):
        every = {h for k, t, *_ in rows if k == g and t for h in sketch.shingle_hashes(t.encode()).tolist()}
        assert sketch.from_text(got[g].sketch).tolist() == sorted(every)[: sketch.K]
        assert got[g].distinct == sketch.distinct(np.array(sorted(every)[: sketch.K], np.uint64))


def test_fingerprints_are_the_least_hashes():
    for _, text, *_ in made_up():
        w = words_of(text)
        shingles = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        assert sketch.sketch(text).tolist() == sorted(xxhash.xxh3_64_intdigest(s.encode(), 8) for s in shingles)[:128]


def test_next_documents_across_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sketch, "RANGE", 1 << 10)
    texts = {i: f"{i} " * 50 for i in range(0, 900, 3)}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = sketch.op8_fingerprint(spark, spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert out.rdd.getNumPartitions() > 4  # more ranges than shuffles have partitions, by the input's bytes
    got = {r.doc_id: r.edited_sha256 for r in out.collect()}
    ids = sorted(texts)
    cut = {i: len(texts[i]) // 4 for i in ids}
    assert got == {i: hashlib.sha256((texts[i][: len(texts[i]) - cut[i]] + texts[j][: cut[i]]).encode()).hexdigest() for i, j in zip(ids, ids[1:] + ids[:1], strict=True)}


def test_mix_rates_solve_the_dual(spark):
    """The conditions of the optimum: the odds tilt with size by one multiplier a source, and the rates meet the target."""
    rows = [(i, "w " * ((i * 37) % 200), "abc"[i % 3]) for i in range(600)] + [(None, None, "a")] * 700 + [(7, "a b c", "b")] * 1500
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(spark, docs).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((d, len((t or "").split()), s) for d, t, s in rows)
    for source in "abc":
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.rate * r.size for r in mine) - mine[0].target) < 1e-6 * mine[0].target
        assert abs(sum(r.taken for r in mine) - mine[0].target) < 0.02 * mine[0].target
        if mine[0].target < 2 * mine[0].source_size * (1 - 1e-9):
            tilt = [(np.log(r.rate / (2 - r.rate)) - np.log(1.5 / 0.5)) / r.size for r in mine if r.size]
            assert np.ptp(tilt) < 1e-9 * max(1, np.abs(tilt).max())


def test_copies_of_rows_that_share_all(spark):
    rows = [(1, "a b c", "s", 5, "x")] * 40 + [(i, "d e", "t", 6, "y") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, copies string")
    got = Counter(tuple(r) for r in mixing.take_copies(spark, docs).collect())
    assert set(got) <= set(rows) and got[rows[0]] <= 80
    words = sum(n * len(k[1].split()) for k, n in got.items() if k[2] == "s")
    assert abs(words - 180) <= 0.02 * 180 + 20


def test_lines_of_rows_that_share_an_id(spark):
    line = "a line of more than twenty characters"
    rows = [(1, f"{line}\nfirst", 0), (1, f"second\n{line}", 0), (2, line, 0), (3, f"{line}\nx", 0), (None, line, 0), (None, f"{line}\ny", 0), (4, "two hold this line, and no more do", 0), (4, "two hold this line, and no more do", 0), (5, "two hold this line, and no more do", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, drops int").repartition(3)
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(spark, docs).collect())
    assert got == Counter([(1, "first", 2, 1), (1, "second", 2, 1), (2, "", 1, 1), (3, f"{line}\nx", 2, 0), (None, "", 1, 1), (None, "y", 2, 1), (4, rows[6][1], 1, 0), (4, rows[6][1], 1, 0), (5, rows[6][1], 1, 0)])


def test_lines_are_joined_alike_at_any_size(spark, capsys):
    docs = spark.createDataFrame([(i, f"a line of more than twenty characters\nline {i}") for i in range(9)], "doc_id long, text string")
    out = lines.dedup_lines(spark, docs)
    out.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sum(r.n_dropped for r in out.collect()) == 8


@pytest.mark.parametrize("length,kgram,crowd", [(100, 24, 3), (30, 8, 0), (4, 2, 1)])
def test_substrings_of_crowded_kgrams(spark, length, kgram, crowd):
    rng = random.Random(length)
    say = lambda n: "".join(rng.choice("abcdefghijklmnop é") for _ in range(n))
    common, longer = say(60), say(140)
    rows = [(i, say(rng.randint(0, 80)) + (common if i % 2 else longer[rng.randint(0, 40) :]) + rng.choice("xy") + say(rng.randint(0, 80))) for i in range(80)]
    got = suffixes.dedup_substrings(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length, kgram, crowd).collect()
    want = brute_substrings(rows, length)
    assert {r.doc_id: (r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got} == want
    assert sum(w[1] for w in want.values()) > 1000


@pytest.mark.parametrize("kinds", [5, 3000])
def test_sort_of_one_crowd_follows_its_repeated_strings(monkeypatch, kinds):
    n, rng = 3000, random.Random(1)
    tails = ["".join(rng.choice("abcdefgh") for _ in range(20)).encode() for _ in range(kinds)]
    texts = [b"p" * 50 + b"q" * 50 + tails[i % kinds] for i in range(n)]
    searched, extension = [], suffixes.SuffixOrder.extension
    monkeypatch.setattr(suffixes.SuffixOrder, "extension", lambda self, a, b: searched.append(len(a)) or extension(self, a, b))
    sort = lambda: suffixes.sort_contexts(np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64), np.full(n, 60 << 16 | 40 << 8 | 60), texts, 100)
    found = sort()
    assert sum(searched) < 300 * n  # 1,300 or more if all of them are compared
    seen, want = set(), []
    for i, x in enumerate(texts):
        again = [a for a in range(21) if x[a : a + 100] in seen]
        seen.update(x[a : a + 100] for a in range(21))
        if again:
            assert again == list(range(len(again)))
            want.append((i, 0, 0, again[-1] + 100))
    assert list(zip(*(c.tolist() for c in found), strict=True)) == want
    monkeypatch.setattr(suffixes, "STRINGS", 2 * n)  # two starts at a time
    assert all((a == b).all() for a, b in zip(sort(), found, strict=True))


def test_line_sql_says_the_same(spark, tmp_path):
    import duckdb

    line = "a line of more than twenty characters"
    rows = [(1, f"{line}\nfirst"), (2, line), (3, f"{line.upper()}  \nx"), (None, f"{line}\ny"), (5, None), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {tuple(r) for r in db.sql(lines.OP7_SQL).fetchall()}
    assert {tuple(r) for r in lines.op7_lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()} == want


def test_language_sample_is_bounded(spark):
    rows = [(None, "der hund und die katze " + "x" * (i % 3), "de") for i in range(3000)] + [(i, f"the dog and the cat number {i} runs", "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.train(docs, per_language=50)
    assert model is not None and set(model.languages) <= {"de", "en"}
    sample = []
    original = langid._counts
    langid._counts = lambda df: sample.append(df.groupBy("label").count().collect()) or original(df)
    try:
        langid.train(docs, per_language=50)
    finally:
        langid._counts = original
    assert all(r["count"] < 100 for r in sample[0])


def test_tokenizer_of_another_kind(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    whole = Tokenizer(models.WordLevel({"Ab": 0, "ab": 1, "c": 5, "?": 9}, unk_token="?"))
    whole.pre_tokenizer = pre_tokenizers.Whitespace()
    whole.save(str(tmp_path / "other.json"))
    got = packing.token_bytes(["Ab ab c", None, "zz"], str(tmp_path / "other.json"), 2)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[0, 1, 5, 2], [2], [9, 2]]


def test_packed_ids_come_back_from_sequences(spark):
    rows = [(i, f"some words here {i} " * (i % 40), "x", 1) for i in range(80)]
    import public_tokenizers

    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string, rank int")
    pieces = packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), 128).withColumn("n", F.lit("n")).withColumn("lo", F.lit(0)).withColumn("rank", F.lit(1))
    packed = packing.pack(pieces, 128)
    made = packing.sequences(packed).collect()
    assert sum(r.length for r in made) == pieces.agg(F.sum("length")).first()[0] and all(len(r.ids) == 4 * r.length <= 512 for r in made)
    by = {r.sequence_id: bytes(r.ids) for r in made}
    for r in packed.collect():
        assert by[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)




@pytest.mark.parametrize("text", [None, "", "\n", "a"])
def test_sketch_of_little(text):
    assert len(sketch.sketch(text)) == (1 if text == "a" else 0)
