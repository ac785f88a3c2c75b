"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies. Of all rates between 0 and `most` that give each source
its token target, those closest to one copy of each document in relative entropy are

    rate = min(most, exp(multiplier of the source * size of the document)),

and the multipliers are the maximum of a convex dual. Newton's method solves it: each iteration is one aggregate over
the histogram of (source, size), which gives the gradient (tokens taken less the target) and the curvature of all
sources at once. A document has one source, so the Hessian is diagonal. A step is no longer than one over the mean size
of a taken token's document, and a bracket around the root catches a step that leaves it.

Rates become copies: the documents of one source and size take round(rows * rate) copies together, of which each gets
the whole part and the first ones in hash order one more. What a source's sum then lacks or has too much goes to its
largest sizes that fit, until none fits; the error is less than the smallest size that has room.

Only lean rows (no texts) leave the scan. Sums are exact decimals, so their order does not matter and reruns agree. Groups of
one source and size with more than PART rows are ranked in parts; which of their rows get the odd copy depends on the scan's order.
A window runs over the distinct sizes of one source, at most about the square root of twice its words.

Defined cases: null and empty texts have size 0, count in no sum and are taken 0 times their size; null sources are one source,
after all others; rows that repeat a doc_id, and those with a null one, are documents of their own; an empty table gives no rows;
columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import h64, join_hot, running_totals, width, written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Rows of one source and size that are ranked in one task; relative error at which a source's multiplier is settled.
PART, CLOSE = 50_000, 1e-7
KEY = ["bare", "src"]


def n_words(text: Column) -> Column:
    """Runs of other characters than ASCII white space: white space before such a character, with one put before all."""
    text = F.concat(F.lit(" "), F.coalesce(text, F.lit("")))
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D](?=[^\x20\x09-\x0D])", ""))).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """sources (bare, src, ...) with `number`, from 0, by code point; null last."""
    ranged = written(sources.repartitionByRange(width(sources.sparkSession), *KEY).withColumn("part", F.spark_partition_id()), "ranged")
    before = running_totals(ranged.groupBy("part").agg(F.count("*").alias("n")), "part", "n").select("part", "before")
    place = F.row_number().over(W.partitionBy("part").orderBy(*KEY)) - 1
    return ranged.withColumn("place", place).join(before, "part").withColumn("number", F.col("before") + F.col("place")).drop("part", "before", "place")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources (bare, src, source_size) with `target`: share of all sizes by weight, at most `most` times the source's size,
    the excess reshared by weight until none is above. Each round is one aggregate; a target is the lesser of its bound and
    its weight times a level, and the level rises until no more bounds are met."""
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    rows = written(numbered(sources).withColumn("weight", weight).withColumn("bound", F.col("source_size") * most).drop("number"), "weights")
    level, met = 0.0, -1
    while True:
        over = F.col("bound") < F.col("weight") * F.lit(level)
        got = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("bound"))).alias("bounds"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count_if(over).alias("met")).first()
        if got["met"] == met or not got["open"]:
            break
        met, level = got["met"], max(level, (share * (got["all"] or 0) - (got["bounds"] or 0)) / got["open"])
    return rows.withColumn("target", F.least(F.col("bound").cast("double"), F.col("weight") * F.lit(level))).drop("weight", "bound")


def multipliers(hist: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """goals (bare, src, source_size, target) with `lam`, the multiplier of each source; hist: bare, src, size, n."""
    top = math.log(most)
    full = F.col("target") >= F.col("source_size") * most
    state = goals.withColumn("lam", F.when(full, F.lit(top)).otherwise(0.0)).withColumn("lo", F.lit(-700.0)).withColumn("hi", F.lit(top)).withColumn("open", ~full)
    few = max(1, width(goals.sparkSession) // 16)
    names = state.columns
    exact = "decimal(38, 9)"
    done = state.where("not open").select(*KEY, "lam")
    state = state.where("open")
    for _ in range(200):
        tokens = F.col("n") * F.col("size") * rate(most)
        bend = F.when(F.col("lam") * F.col("size") < top, tokens * F.col("size"))
        sums = hist.join(state, KEY).groupBy(*names).agg(F.sum(tokens.cast(exact)).cast("double").alias("taken"), F.coalesce(F.sum(bend.cast(exact)).cast("double"), F.lit(0.0)).alias("bend"))
        gap = F.col("taken") - F.col("target")
        settled = F.abs(gap) <= F.greatest(F.lit(0.5), F.col("target") * CLOSE)
        sums = sums.withColumn("open", ~settled).withColumn("lo", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")))
        step = F.col("lam") + F.try_divide(F.least(-gap, F.col("taken")), F.col("bend"))
        middle = (F.col("lo") + F.col("hi")) / 2
        next_ = F.when(settled, F.col("lam")).when((step > F.col("lo")) & (step < F.col("hi")), step).otherwise(middle)
        sums = written(sums.withColumn("lam", next_).select(*names).coalesce(few), "multipliers")
        done = done.unionByName(sums.where("not open").select(*KEY, "lam"))
        state = sums.where("open")
        if state.isEmpty():
            return goals.join(written(done.coalesce(few), "multipliers"), KEY)
    raise RuntimeError("the multipliers did not settle")


def rate(most: int = MOST) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * F.col("size"), F.lit(1.0 + math.log(most)))))


def copies(hist: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """hist with rate and m, the copies that the rows of a source and size take together; goals: with lam."""
    groups = hist.join(goals, KEY).withColumn("rate", rate(most))
    groups = written(groups.withColumn("m", F.round(F.col("n") * F.col("rate")).cast("long")), "copies")
    source, by_size = W.partitionBy(*KEY), W.partitionBy(*KEY).orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    while True:
        off = (F.round("target") - F.sum(F.col("m") * F.col("size")).over(source)).cast("long")
        room = F.when(F.col("off") > 0, F.col("n") * most - F.col("m")).otherwise(F.col("m"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("off"))
        made = groups.withColumn("off", off).withColumn("room", F.when(fits, room).otherwise(0))
        left = F.abs("off") - F.coalesce(F.sum(F.col("room") * F.col("size")).over(by_size), F.lit(0))
        made = made.withColumn("left", left)
        more = F.when((F.col("room") > 0) & (F.col("left") > 0), F.least(F.col("room"), F.floor(F.col("left") / F.col("size")))).otherwise(0)
        made = made.withColumn("more", more.cast("long")).withColumn("m", F.col("m") + F.signum("off").cast("long") * F.col("more"))
        made = written(made.select(*groups.columns, "more"), "copies")
        if made.where("more > 0").isEmpty():
            return groups
        groups = made.drop("more")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, copies, rate for each row of docs: a mix of `share` times all words, sources by
    weight, no document more than `most` times."""
    source = F.col("source").cast("string")
    rows = docs.select("doc_id", source.isNull().alias("bare"), F.coalesce(source, F.lit("")).alias("src"), n_words(F.col("text")).alias("size"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    hist = written(rows.groupBy(*KEY, "size").agg(F.count("*").alias("n")), "histogram")
    goals = hist.groupBy(*KEY).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goals = written(targets(goals, weights, share, most), "targets")
    groups = copies(hist, written(multipliers(hist, goals, most), "balanced"), most)
    group = [*KEY, "size"]
    rows = join_hot(rows, groups.drop("lam"), group, "n", ["n", "m", "rate", "source_size", "target"])
    rows = rows.withColumn("part", F.pmod(h64(17, F.col("doc_id"), F.when(F.col("n") > PART, F.col("row"))), F.ceil(F.col("n") / PART)).cast("int"))
    counts = rows.where(F.col("n") > PART).groupBy(*group, "part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0))).drop("rows")
    rank = F.row_number().over(W.partitionBy(*group, "part").orderBy("hash", "doc_id", "row")) - 1
    ranked = rows.withColumn("hash", h64(19, F.col("doc_id"))).withColumn("rank", rank).join(counts, [*group, "part"], "left")
    odd = F.col("rank") + F.coalesce("before", F.lit(0)) < F.col("m") % F.col("n")
    copy = (F.floor(F.col("m") / F.col("n")) + odd.cast("int")).cast("long")
    return ranked.select("doc_id", "size", "source_size", "target", copy.alias("copies"), "rate")


def op11_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")
