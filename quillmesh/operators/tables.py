"""Generic table operators: keep-first and arg-max dedup, unions, modes, lookups with fallback, cliques, matrices."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import cut


#: Rows that one task sorts; parts of a group of items.
ROWS, PARTS = 1_000_000, 64


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys, in as many partitions as rows need for ROWS each, and the session's number at least: a task's sort does not grow with the input."""
    return df.repartition(max(-(-rows // ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def keep_first(df: DataFrame, keys: list[str], order: list[Column], rows: int | None = None) -> DataFrame:
    """One row for each key, the first in the given order.

    With rows, how many df has, rows are dealt by key before any is sorted, and sorted by a hash of the keys first. Without, each
    task sorts all that it reads, which pays where a key has many rows.
    """
    if rows is None:
        w = W.partitionBy(*keys).orderBy(*order)
        return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    w = W.partitionBy("_h", *keys).orderBy(*order)
    return dealt(df, rows, *keys).withColumn("_h", F.xxhash64(*keys)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_h")


def keep_best(df: DataFrame, keys: list[str], score: str, seq: str, rows: int | None = None) -> DataFrame:
    """One row for each key, that with the highest score (null lowest), the first of equals by seq; rows as for keep_first."""
    return keep_first(df, keys, [F.coalesce(F.col(score).cast("double"), F.lit(-1.0)).desc(), F.col(seq).asc()], rows)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows by name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def most_common(df: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """The commonest value for each key, the first seen of equals (the least of those seen at once), with how many values the key has."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"), F.min(seq).alias("_s"))
    w = W.partitionBy(*keys)
    ranked = counts.withColumn("_n", F.row_number().over(w.orderBy(F.desc("_c"), "_s", value))).withColumn("n_values", F.count(F.lit(1)).over(w))
    return ranked.where("_n = 1").drop("_n", "_c", "_s")


def lookup_with_fallback(df: DataFrame, column: str, alias: Column, mapping: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """The value for column, else the value for its alias, else column itself."""
    a, b = (mapping.select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")) for i in (1, 2))
    df = df.withColumn("_alias", alias)
    df = df.join(a, df[column] == F.col("_k1"), "left").join(b, F.col("_alias") == F.col("_k2"), "left")
    return df.withColumn(out, F.coalesce("_v1", "_v2", F.col(column))).drop("_alias", "_k1", "_v1", "_k2", "_v2")


def clique_pairs(members: DataFrame, group: str, item: str, cap: int) -> DataFrame:
    """Distinct (source, target), source < target, of items that share a group of 2 to cap distinct items.

    The cap is applied before pairs are made, so a group makes at most cap * (cap - 1) / 2. Items of a group are sorted and each meets
    those after it; no self-join, and no hash table of members or pairs, which would grow with the input. A group is first cut to
    cap + 1 items in each of PARTS parts, so that none lies whole in one task.
    """
    sets = members.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(group, item)
    most = F.least(F.col("_c"), F.lit(cap))
    rows, n_pairs = sets.groupBy(group).agg(F.count(F.lit(1)).alias("_c")).agg(F.coalesce(F.sum("_c"), F.lit(0)), F.coalesce(F.sum((most * (most - 1) / 2).cast("long")), F.lit(0))).first()
    w = W.partitionBy(group, "_part").orderBy(item)
    parts = dealt(sets.withColumn("_part", F.pmod(F.xxhash64(item), F.lit(PARTS)).cast("byte")), rows, group, "_part")
    once = parts.withColumns({"_before": F.lag(item).over(w), "_n": F.dense_rank().over(w)}).where(F.col("_before").isNull() | (F.col("_before") != F.col(item)))
    w = W.partitionBy(group).orderBy(item)
    whole = dealt(once.where(F.col("_n") <= cap + 1).select(group, item), rows, group).select(
        F.col(item).alias("source"),
        F.count(F.lit(1)).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_n"),
        F.collect_list(item).over(w.rowsBetween(1, cap)).alias("_after"),
    )
    pairs = whole.where(F.col("_n").between(2, cap)).select("source", F.explode("_after").alias("target"))
    return keep_first(pairs, ["source", "target"], [F.col("target")], n_pairs)


def aligned(frames: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """One row for each key with a column for each frame: one union and one aggregation in place of chained outer joins."""
    tall = union_all(df.select(key, F.col(value).alias("_v"), F.lit(name).alias("_f")) for name, df in frames.items())
    return tall.groupBy(key).agg(*[F.max(F.when(F.col("_f") == name, F.col("_v"))).alias(name) for name in frames])


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df with old columns under their new names; a column that is not there, or whose new name is taken, stays as it is."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns and new not in df.columns})


def at_least_present(long: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """Keys with n non-null values or more."""
    return long.groupBy(key).agg(F.count(value).alias("_n")).where(F.col("_n") >= n).select(key)


def seeded(seed: int, *keys: str) -> Column:
    """A seeded order of rows that other engines can follow: the MD5 of the seed and the keys as text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """n rows, the same for the same seed whatever the partitioning."""
    return df.orderBy(seeded(seed, *keys), *keys).limit(n)


def numbered(df: DataFrame, order: list[str], name: str = "trial_index") -> DataFrame:
    """1-based numbers in the given order (rows equal in it in any order). Ranges are counted and offsets added, so that rows are numbered in parallel.

    The ranges are dealt once, into a checkpoint: a second dealing would sample other bounds, and other counts than those numbered.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("__place", F.monotonically_increasing_id()))  # the partition's number, then the row's place in it
    part, within = F.shiftright("__place", 33), F.col("__place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("__range")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__range", before.alias("__before"))  # a row for each range
    return placed.withColumn("__range", part).join(F.broadcast(offsets), "__range").withColumn(name, (within + F.col("__before") + 1).cast("long")).drop("__range", "__place", "__before")
