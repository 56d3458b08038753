"""Documents as triples hold their whole texts."""

from collections import Counter

from weftline.sources.relational import load_triples


def test_documents_carry_the_whole_text(spark, tmp_path):
    long = "the same twenty-four characters, then other ones "
    rows = [(1, long + "a" * 5000, "en", "s", 5049), (2, long + "b", "en", "s", 50), (3, long + "b", "de", "s", 50), (4, None, "en", "s", 0), (5, "", None, None, 0), (6, "line\nžluť 🐎 " * 10, "cs", "s", 110)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = load_triples(spark, str(tmp_path), ["documents"]).where("p = 'urn:col:text'").collect()
    assert Counter((r.s, r.o, r.o_lang) for r in got) == Counter((f"urn:documents:{i}", x, lang or "") for i, x, lang, _, _ in rows if x is not None)
