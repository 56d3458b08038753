"""Templates of paths with seven and more segments."""

from pyspark.sql import functions as F

from weftline.llm import urls


def test_branches_below_the_sixth_segment_are_told_apart(spark):
    bad = [f"/a/b/c/d/e/bad/{i}" for i in range(20)]
    good = [f"/a/b/c/d/e/good/{i}" for i in range(20)]
    deep = [f"/a/b/c/d/e/good/x/y/z/{i}" for i in range(5)]
    rules = [("block", "h.org", f"/a/b/c/d/e/bad/{i}") for i in range(5, 10)] + [("allow", "h.org", f"/a/b/c/d/e/good/{i}") for i in range(5, 7)]
    rows = [(i, "http://h.org" + p) for i, p in enumerate(["", "/", "/a", *bad, *good, *deep])]
    got = {r.path: r for r in urls.judge(spark, spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert len(got) == len(rows)
    assert all(got[p].verdict == "block" and got[p].template == "/a/b/c/d/e/bad/*" for p in bad)
    assert all(got[p].verdict == "allow" and got[p].template.startswith("/a/b/c/d/e/good/") for p in good + deep)
    assert (got[""].template, got["/"].template, got["/a"].template) == ("/", "/", "/a")


def test_templates_have_a_part_for_each_segment(spark):
    path = "/" + "/".join("abcdefghijklm")
    found = urls.judge(spark, spark.createDataFrame([(i, f"x://h{path}") for i in range(4)], "page_id long, url string"), []).select(F.col("template")).distinct().collect()
    assert [r.template for r in found] == [path]
