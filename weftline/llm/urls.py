"""URL filters: rules by host and path, and a path-template tree for what no rule decides.

For each host the tree is built level by level over path segments, of which each counts its pages, the labelled
ones among them and the blocked ones among those. Pages that a rule decides are the labelled ones.

Variable segments: where at least ``variable`` different segments of a node have fewer than ``least`` pages, the
place is variable and those segments become one wildcard - but a segment whose labelled share differs significantly
from that of the node's other segments (two-proportion test) keeps its name, however small it is. All other segments
keep theirs, however many a node has.

Similar branches: of a node's literal segments those without labels are merged, those nearly all allowed, and those
nearly all blocked (share within ``pure`` of 0 or 1), unless a segment's share differs significantly from that of its
group. Branches with mixed labels stay apart, as the levels below tell theirs apart.

A template is rejected if its smoothed share of blocked pages reaches ``reject``. An unlabelled page counts as
``weak`` of an allowed one there, so a few labels don't speak for many pages; without any label a template is allowed.

All numbers are sums that are grouped in part before a shuffle, and written before they are joined to pages or
segments, so that Spark can split the joins at a host that has many.

Defined cases: a null url, or one without ``://``, has empty host and path (template ``/``); an empty segment keeps
its place; the tree is as deep as the longest path; repeated rows get equal verdicts; other columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: verdict, host, path prefix.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one. For rule lists of some hundreds."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _differs(m1: Column, k1: Column, m2: Column, k2: Column, z: float) -> Column:
    """Whether k1 of m1 and k2 of m2 are significantly different shares; without labels on either side they aren't."""
    one, two = F.greatest(m1, F.lit(1)), F.greatest(m2, F.lit(1))
    pooled = (k1 + k2) / F.greatest(m1 + m2, F.lit(1))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / one + 1 / two))
    return (m1 > 0) & (m2 > 0) & (F.abs(k1 / one - k2 / two) > z * spread)


def branches(scratch: Scratch, segments: DataFrame, variable: int, least: int, pure: float, z: float) -> DataFrame:
    """host, template, seg, step of the segments (host, template, seg, n, m, k), a written table: the name each goes by in the next level's template."""
    node, n, m, k = ["host", "template"], F.col("n"), F.col("m"), F.col("k")
    rare = n < least
    totals = scratch.table(segments.groupBy(*node).agg(F.sum("m").alias("all_m"), F.sum("k").alias("all_k"), F.count_if(rare).alias("rare")))
    pooled = rare & (F.col("rare") >= variable) & ~_differs(m, k, F.col("all_m") - m, F.col("all_k") - k, z)
    share = k / F.greatest(m, F.lit(1))
    kind = F.when(F.col("seg") == "", "own").when(pooled, "*").when(m == 0, "none").when(share <= pure, "allowed").when(share >= 1 - pure, "blocked").otherwise("own")
    told = scratch.table(segments.join(totals, node).select(*node, "seg", "m", "k", kind.alias("kind")))
    groups = scratch.table(told.where("kind in ('none', 'allowed', 'blocked')").groupBy(*node, "kind").agg(F.sum("m").alias("group_m"), F.sum("k").alias("group_k"), F.min("seg").alias("first"), F.count(F.lit(1)).alias("members")))
    both = told.join(groups, [*node, "kind"], "left")
    alike = (F.col("members") > 1) & ~_differs(m, k, F.col("group_m") - m, F.col("group_k") - k, z)
    step = F.when(F.col("kind") == "*", "*").when(alike, F.concat(F.lit("{"), F.col("first"), F.lit("|..}"))).otherwise(F.col("seg"))
    return both.select(*node, "seg", step.alias("step"))


def templates(scratch: Scratch, pages: DataFrame, variable: int = 8, least: int = 3, pure: float = 0.1, z: float = 1.96) -> DataFrame:
    """page_id, host, path, rule, label, template of pages (page_id, host, path, rule, label: 1 block, 0 allow, null)."""
    names = ["page_id", "host", "path", "rule", "label"]
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    rows = pages.select(*names, F.when(F.col("path").isin("", "/"), F.array().cast("array<string>")).otherwise(parts).alias("segs"), F.lit("").alias("template"))
    rows, at = scratch.write(rows)
    deepest = rows.agg(F.max(F.size("segs"))).first()[0] or 0
    done = []
    for i in range(deepest):
        ended, _ = scratch.write(rows.where(F.size("segs") <= i))  # paths that end above have no part in this round
        done.append(ended)
        here = rows.where(F.size("segs") > i).withColumn("seg", F.get("segs", F.lit(i)))
        node = ["host", "template", "seg"]
        sums = here.groupBy(*node).agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("m"), F.coalesce(F.sum("label"), F.lit(0)).alias("k"))
        named = scratch.table(branches(scratch, scratch.table(sums), variable, least, pure, z))
        joined = here.join(named, node).select(*names, "segs", F.concat("template", F.lit("/"), "step").alias("template"))
        rows, new_at = scratch.write(joined)
        scratch.drop(at)
        at = new_at
    rows = reduce(DataFrame.unionByName, done, rows)
    return rows.select(*names, F.when(F.col("template") == "", "/").otherwise(F.col("template")).alias("template"))


def judge(
    spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, prior: float = 0.1, strength: float = 2.0, weak: float = 0.02, reject: float = 0.5
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity."""
    scratch = Scratch(spark, "urls")
    url = F.col("url").cast("string")
    split = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    marked = split.withColumn("rule", name).withColumn("label", (verdict == "block").cast("int"))
    rows = scratch.table(templates(scratch, marked))
    unlabelled = F.count(F.lit(1)) - F.count("label")
    purity = (F.coalesce(F.sum("label"), F.lit(0)) + strength * prior) / (F.count("label") + strength + weak * unlabelled)
    judged = rows.join(scratch.table(rows.groupBy("host", "template").agg(purity.alias("purity"))), ["host", "template"])
    own = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    said = F.when(F.col("label") == 1, "block").when(F.col("label") == 0, "allow").otherwise(own)
    return judged.select("page_id", "host", "path", "rule", said.alias("verdict"), "template", "purity")


def op9_urls(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judge(spark, pages)
