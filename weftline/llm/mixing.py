"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Every source gets a target of words. Among all document rates between 0 and ``most``, the mix takes
those of least relative entropy to one base rate that meet each source's target. By convex duality
these are exponentially tilted: the odds of document i are the base odds times exp(lambda_s * size_i /
mean_s). The dual separates by source; all lambdas are found together by Newton's method, kept between
bounds, one distributed aggregation an iteration over the histogram of sizes of each source (rates
depend on nothing else, so documents are aggregated before the first iteration).

Rates are rounded into copies by error diffusion: the documents of a source, dealt by a hash into parts
of about ``part`` rows, are walked from the largest to the smallest, each getting the whole number from 0
to ``most`` that keeps the part's words nearest to what the rates ask for, among those for which the
documents still to come can make up. What is left over a part is about the size of its smallest ones. A source of any size is spread over many parts.

Defined cases: a null text has size 0 and is taken as 0 words; a null source is a source of its own,
ordered last; sources without words have target 0; an empty table gives no rows; repeated rows are
documents of their own, however many have an id and a size in common; a null id is kept; other columns are not read. Equal input gives equal output.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, repeats_ids, spare_name

SPACE = r"[\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """The number of runs of other characters than ASCII white space; 0 for null."""
    pieces = F.size(F.split(text, SPACE + "+", -1))
    lead, trail = F.substring(text, 1, 1).rlike(SPACE), F.substring(text, -1, 1).rlike(SPACE)
    n = pieces - lead.cast("int") - trail.cast("int")
    return F.when(text.isNull() | (F.length(text) == 0), F.lit(0)).otherwise(n).cast("long")


def ranked_sources(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with ``k``, their place (from 0) in code point order of ``source``, null last; ranked range by range."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = scratch.table(sources.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_rn", within).join(starts, "_part").withColumn("k", F.col("_before") + F.col("_rn")).drop("_part", "_rn", "_before")


def targets(sources: DataFrame, scratch: Scratch, weights: list[float], share: float, most: float) -> DataFrame:
    """The rows with ``target``: ``share`` of all sizes dealt by weight, no source over ``most`` times its size, the excess dealt anew."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    rows = scratch.table(sources.withColumn("_w", weight).withColumn("_cap", F.lit(float(most)) * F.col("source_size")))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # the level only rises; each round fills another source at least, or is the last
        full = F.col("_cap") <= F.lit(level) * F.col("_w")
        used, open_weight = rows.agg(F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_w")))).first()
        rise = (share * total - used) / open_weight if open_weight else level
        if rise <= level * (1 + 1e-12):
            break
        level = rise
    return rows.withColumn("target", F.least("_cap", F.lit(level) * F.col("_w"))).drop("_w", "_cap")


def rate(size: Column, lam: Column, mean: Column, base: float, most: float) -> Column:
    odds = math.log(base / (most - base))
    return F.lit(float(most)) / (F.lit(1.0) + F.exp(-(F.lit(odds) + lam * size / mean)))


def balance(histogram: DataFrame, sources: DataFrame, scratch: Scratch, base: float, most: float, rounds: int = 60, close: float = 1e-9) -> DataFrame:
    """The sources with ``lam``, the dual solution: the rates' words of each source are its target's."""
    mean = F.greatest(F.col("source_size") / F.col("n"), F.lit(1e-9))
    state = sources.withColumn("mean", mean).withColumn("lam", F.lit(0.0)).withColumn("lo", F.lit(-1e7)).withColumn("hi", F.lit(1e7))
    state = scratch.table(state)
    keep = state.columns
    for _ in range(rounds):
        w = rate(F.col("size"), F.col("lam"), F.col("mean"), base, most)
        slope = F.col("size") * w * (F.lit(float(most)) - w) / F.lit(float(most)) * F.col("size") / F.col("mean")
        sums = histogram.join(state.select("k", "lam", "mean"), "k").groupBy("k").agg(F.sum(F.col("rows") * F.col("size") * w).alias("_f"), F.sum(F.col("rows") * slope).alias("_d"))
        over = F.coalesce(F.col("_f"), F.lit(0.0)) - F.col("target")
        # a full source, or one without words, has no finite solution or needs none
        rest = F.when((F.col("target") <= 0) | (F.col("target") >= F.lit(most * (1 - 1e-12)) * F.col("source_size")), 0.0).otherwise(F.abs(over) / F.col("target"))
        lo, hi = F.when(over < 0, F.col("lam")).otherwise(F.col("lo")), F.when(over > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - over / F.col("_d")
        middle = F.when((lo > -1e7) & (hi < 1e7), (lo + hi) / 2).otherwise(F.when(over > 0, F.col("lam") - 2 * F.abs(F.col("lam")) - 1).otherwise(F.col("lam") + 2 * F.abs(F.col("lam")) + 1))
        step = F.when((F.col("_d") > 0) & (newton > lo) & (newton < hi), newton).otherwise(middle)
        moved = state.join(sums, "k", "left").withColumn("_rest", rest)
        moved = moved.select(*[c for c in keep if c not in ("lam", "lo", "hi")], F.when(F.col("_rest") > close, step).otherwise(F.col("lam")).alias("lam"), lo.alias("lo"), hi.alias("hi"), "_rest")
        moved = scratch.table(moved)
        state = moved.select(*keep)
        worst = moved.agg(F.max("_rest")).first()[0]
        if worst is None or worst <= close:
            break
    return state


def copies(sized: DataFrame, state: DataFrame, base: float, most: float, part: int = 512) -> DataFrame:
    """doc_id, k, size, copies: the rates of ``state`` rounded for the rows of ``sized`` (doc_id, k, size)."""
    full = F.col("target") >= F.lit(most * (1 - 1e-12)) * F.col("source_size")
    w = F.when(full, F.lit(float(most))).otherwise(rate(F.col("size"), F.col("lam"), F.col("mean"), base, most))
    rated = sized.join(state.select("k", "lam", "mean", "target", "source_size", "n"), "k").withColumn("w", w)
    # rows equal in id and size are counted, and chunks of them dealt like documents of their own, so a part stays at about ``part`` rows
    same = rated.groupBy("k", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows"), F.first("w").alias("w"), F.first("n").alias("n"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / part)))
    chunks = same.withColumn("chunk", chunk).withColumn("rows", F.least(F.lit(part).cast("long"), F.col("rows") - F.col("chunk") * part).cast("int"))
    mark = F.xxhash64(F.lit("mix"), "doc_id", "size", "chunk")
    dealt = chunks.withColumn("part", F.pmod(mark, F.ceil(F.col("n") / part)))
    # about ``part`` documents each: a hash deals a source's documents into n / part parts
    each = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("less"), mark.alias("mark"), "doc_id", "w", F.col("rows").alias("times"))))
    rows = F.flatten(F.transform(each, lambda x: F.array_repeat(x, x["times"])))
    # up, down: what the documents still to come can add to their rates' words, and take from them
    start = F.struct(F.lit(0.0).alias("off"), F.col("up"), F.col("down"), F.expr("cast(array() as array<int>)").alias("got"))

    def place(acc: Column, x: Column) -> Column:
        size, w = -x["less"].cast("double"), x["w"]
        up, down = acc["up"] - (F.lit(float(most)) - w) * size, acc["down"] - w * size

        def choice(c: int) -> Column:
            off = acc["off"] + (F.lit(float(c)) - w) * size
            lost = F.round(F.greatest(off - down, -off - up, F.lit(0.0)), 3)  # no later document can make up for it
            return F.struct(lost.alias("lost"), F.abs(off).alias("far"), F.abs(F.lit(float(c)) - w).alias("turn"), F.lit(c).alias("c"), off.alias("off"))

        best = F.array_min(F.array(*[choice(c) for c in range(math.floor(most) + 1)]))
        return F.struct(best["off"].alias("off"), up.alias("up"), down.alias("down"), F.concat(acc["got"], F.array(best["c"])).alias("got"))

    words = F.col("size").cast("double")
    lists = dealt.groupBy("k", "part").agg(rows.alias("rows"), F.sum((F.lit(float(most)) - F.col("w")) * words * F.col("rows")).alias("up"), F.sum(F.col("w") * words * F.col("rows")).alias("down"))
    lists = lists.withColumn("got", F.aggregate("rows", start, place, lambda acc: acc["got"]))
    one = lists.select("k", F.explode(F.arrays_zip("rows", "got")).alias("x"))
    return one.select(F.col("x.rows.doc_id").alias("doc_id"), "k", (-F.col("x.rows.less")).alias("size"), F.col("x.got").alias("copies"), F.col("x.rows.w").alias("rate"))


def mix(spark: SparkSession, documents: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken of every document."""
    scratch = Scratch(spark, "mix")
    raw = scratch.table(documents.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size")))
    sources = raw.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = targets(ranked_sources(sources, scratch), scratch, list(weights), share, most)
    sources = scratch.table(sources)
    names = sources.select(F.col("source").alias("_source"), "k")
    sized = raw.join(names, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "k", "size")
    histogram = scratch.table(sized.where("size > 0").groupBy("k", "size").agg(F.count(F.lit(1)).alias("rows")))
    base = min(share, most * 0.999)
    state = balance(histogram, sources, scratch, base, most)
    out = copies(sized, state, base, most).join(state.select("k", "source", "source_size", "target"), "k")
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op10_mixing(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return mix(spark, documents).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def take_copies(spark: SparkSession, documents: DataFrame, **how) -> DataFrame:
    """The documents as often as the mix takes them; columns as they are. Rows that share an id are told apart by source, size and number, so each gets copies of its own."""
    names = documents.columns
    size, number, copies_, copy, d, s, z, k = (spare_name(names, x) for x in ("size", "number", "copies", "copy", "of_id", "of_source", "of_size", "of_number"))
    got = mix(spark, documents, **how).select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(z), F.col("copies").alias(copies_))
    if repeats_ids(documents):
        mine = documents.withColumn(size, word_count(F.col("text").cast("string")))
        mine = mine.withColumn(number, F.row_number().over(Window.partitionBy("doc_id", "source", size).orderBy(size)))
        got = got.withColumn(k, F.row_number().over(Window.partitionBy(d, s, z).orderBy(F.desc(copies_))))
        same = F.col("doc_id").eqNullSafe(F.col(d)) & F.col("source").cast("string").eqNullSafe(F.col(s)) & (F.col(size) == F.col(z)) & (F.col(number) == F.col(k))
    else:
        mine, same = documents, F.col("doc_id").eqNullSafe(F.col(d))
    both = mine.join(got.where(F.col(copies_) > 0), same)
    return both.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copies_)))).select(*names)
