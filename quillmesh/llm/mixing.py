"""Mixing sources to target weights: whole copies first, then a Pareto order sample of one further copy.

Sources, by code point with null last, weigh 5, 2, 1, 5, 2, 1, ...; together they get as many words as the corpus has.
A target stops at max_copies times its source's size and the excess is shared anew by weight: the capped sources are
those with the lowest cap for each unit of weight, so one pass over the sorted sources finds the level.

A source of size S with target T takes floor(T / S) whole copies of every document. The rest, R = T - floor(T / S) * S
words, is drawn as an unequal-probability sample without replacement whose size, in words, is fixed: document i has
inclusion probability min(1, c * size_i), with c such that the expected words are R; with u_i uniform from a hash of its id,
documents are ranked by (u_i / (1 - u_i)) / (p_i / (1 - p_i)) and taken in that order until R words are met, to within
half of the document at the cut. The cut is found from a histogram of the ranks, so that only the ranks of one bucket
of each source are ever sorted; no source meets in one task.

Defined cases: a null or blank text has size 0 and takes 0 words; null sources are one source, the last; rows alike in
doc_id, source and size are interchangeable; a corpus without words has targets of 0; other columns are kept by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, cut

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """From the seed and the id's text, strictly between 0 and 1: 48 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) of each source; sizes has source and size. The table of sources is sorted in one task."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    s = per.withColumn("w", weight.cast("long"))
    everything = W.partitionBy()
    by_cap = W.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    s = s.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
    )
    # the level if all earlier sources are capped; a source is capped if even that level is above its cap
    level = (F.col("total") - max_copies * F.col("size_before")).cast("double") / (F.col("all_w") - F.col("w_before")).cast("double")
    cap = (max_copies * F.col("source_size")).cast("double")
    s = s.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= cap)
    shared = F.max(F.when(F.col("free"), F.struct((-F.col("size_before")).alias("k"), (-F.col("w_before")).alias("j"), F.col("level").alias("level")))).over(everything)
    return s.select("source", "source_size", F.when(F.col("free"), shared["level"] * F.col("w")).otherwise(cap).alias("target"))


def inclusion_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, rest, sure, rate): rest words are to be drawn; size >= sure is certain, else p = rate * size."""
    t = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("rest", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double"))
    by_size = sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    down = W.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("source")
    mass, squares = F.col("size") * F.col("n"), (F.col("size") * F.col("size")).cast("decimal(38,0)") * F.col("n")
    c = by_size.select(
        "source",
        "size",
        F.coalesce(F.sum(mass).over(down), F.lit(0)).cast("double").alias("sure_mass"),
        (F.sum(squares).over(whole) - F.coalesce(F.sum(squares).over(down), F.lit(0))).cast("double").alias("squares"),
    )
    r = t.withColumnRenamed("source", "_s")
    c = c.join(r, F.col("source").eqNullSafe(F.col("_s")))
    rate = (F.col("rest") - F.col("sure_mass")) / F.col("squares")
    c = c.where(rate * F.col("size") < 1)  # the largest size that isn't certain decides
    best = c.groupBy("source").agg(F.max(F.struct("size", rate.alias("rate"))).alias("b"))
    b = best.select(F.col("source").alias("_b"), F.col("b.size").alias("free_to"), F.col("b.rate").alias("rate"))
    return t.join(b, F.col("source").eqNullSafe(F.col("_b")), "left").select("source", "source_size", "target", "whole", "rest", F.coalesce("free_to", F.lit(0)).alias("free_to"), F.coalesce("rate", F.lit(0.0)).alias("rate"))


def mix_sizes(sizes: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """sizes(doc_id, source, size) with source_size, target, copies and taken."""
    sizes = cut(sizes.select("doc_id", "source", "size"))
    plan = cut(inclusion_rates(sizes, source_targets(sizes, weights, max_copies)))
    p = plan.withColumnRenamed("source", "_s")
    drawn = sizes.join(p, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    prob = F.when(F.col("size") > F.col("free_to"), 1.0).otherwise(F.greatest(F.col("rate"), F.lit(0.0)) * F.col("size"))
    u = uniform(F.col("doc_id"), seed)
    # rank / (1 + rank), which keeps the order and lies between 0 and 1; 1 for what can't be drawn
    drawn = drawn.withColumn("prob", prob).withColumn("u", u)
    odds_u, odds_p = F.col("u") / (1 - F.col("u")), F.col("prob") / (1 - F.col("prob"))
    rank = F.when(F.col("prob") >= 1, 0.0).when(F.col("prob") <= 0, 1.0).otherwise(odds_u / (odds_u + odds_p))
    drawn = drawn.withColumn("rank", rank).withColumn("bucket", F.least(F.floor(F.col("rank") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    sums = drawn.groupBy("source", "bucket").agg(F.sum("size").alias("mass"), F.max("rest").alias("rest"))
    up = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = sums.withColumn("upto", F.sum("mass").over(up))
    crossing = sums.where(F.col("upto") >= F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("mass")).alias("base"))).alias("x"))
    x = crossing.select(F.col("source").alias("_x"), F.col("x.bucket").alias("at"), F.col("x.base").alias("base"))
    marked = cut(drawn.join(x, F.col("source").eqNullSafe(F.col("_x")), "left").select("doc_id", "source", "size", "source_size", "target", "whole", "rest", "rank", "bucket", F.coalesce("at", F.lit(BUCKETS)).alias("at"), F.coalesce("base", F.lit(0)).alias("base")))
    clear = marked.where("bucket <> at").withColumn("extra", (F.col("bucket") < F.col("at")).cast("long"))
    near = W.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    middle = (F.col("base") + F.sum("size").over(near)).cast("double") - F.col("size") / F.lit(2.0)
    edge = marked.where("bucket = at").withColumn("extra", (middle <= F.col("rest")).cast("long"))
    copies = F.col("whole") + F.when(F.col("rest") > 0, F.col("extra")).otherwise(0)
    return clear.unionByName(edge).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
