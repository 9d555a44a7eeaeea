"""A uniform shuffle of rows into shards of exact sizes, by a hypergeometric communication matrix.

How many rows each input partition sends to each cell (a part of a shard, one task's worth) is drawn first: a table with the
partitions' sizes as row sums and the cells' sizes as column sums, with the probability it has under a uniform permutation of
all rows. It is drawn down a binary tree of partitions, so that each task draws its own row of it from the seed and the
partitions' sizes; nobody holds the whole. A task deals its rows to cells in a random order (the local permutation), rows are
exchanged by cell, and each cell sorts what it got by the random keys that the senders drew (the second permutation). A row's
slot is its place in the cell after the cells before it in its shard, so slots have no gaps at any number of tasks.

Rows move once. What is broadcast is one long for each input partition, MAX_PARTITIONS at most; what a task holds besides its
sort is twelve bytes for each of its input rows.

Defined cases: all rows are dealt, null ids, null texts and repeated rows included; shard sizes differ by one at most, the
first having the rows over; an empty table gives no rows; the caller's columns lie in `row`, so that no name clashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of a cell (until there are MAX_CELLS), cells and input partitions at most.
CELL_ROWS, MAX_CELLS, MAX_PARTITIONS = 20_000, 16_384, 1 << 20
#: Row places within a partition, as monotonically_increasing_id() has them.
PLACE_BITS = 33
#: Below this number of rows numpy's own draws serve.
NUMPY_ROWS = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of sample rows, drawn from good + bad, are good; by inversion around the mode for numbers beyond numpy's."""
    if good + bad < NUMPY_ROWS:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(sample, good)
    if low == high:
        return low
    share = good / (good + bad)
    spread = math.sqrt(sample * share * (1 - share) * max(0.0, (good + bad - sample) / (good + bad - 1)))
    mode = min(high, max(low, (sample + 1) * (good + 1) // (good + bad + 2)))
    reach = int(14 * spread) + 40  # what lies beyond has less mass than a double resolves
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=float)
    steps = np.log((good - k[:-1]) * (sample - k[:-1])) - np.log((k[:-1] + 1) * (bad - sample + k[:-1] + 1))
    mass = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(mass - mass.max()))
    return int(k[np.searchsorted(mass, rng.random() * mass[-1], "right")])


def split(rng: np.random.Generator, capacities: np.ndarray, left: int) -> np.ndarray:
    """How many of left rows fall to each cell, when left of all rows are drawn at random; the cells' capacities count all rows."""
    if capacities.sum() < NUMPY_ROWS:
        return rng.multivariate_hypergeometric(capacities, left, method="marginals")
    out, rest = np.zeros_like(capacities), int(capacities.sum())
    for i, c in enumerate(capacities.tolist()):
        rest -= c
        out[i] = hypergeometric(rng, c, rest, left)
        left -= int(out[i])
    return out


def matrix_row(sizes: np.ndarray, capacities: np.ndarray, partition: int, seed: int) -> np.ndarray:
    """How many rows a partition sends to each cell: the way down to it from all partitions, halving them at each step.

    Every node draws with a generator of its own, so that all tasks see the same matrix.
    """
    begin, end, node = 0, len(sizes), 1
    sums = np.concatenate([[0], np.cumsum(sizes)])
    while end - begin > 1:
        middle = (begin + end) // 2
        first = split(np.random.default_rng([seed, node]), capacities, int(sums[middle] - sums[begin]))
        if partition < middle:
            end, node, capacities = middle, 2 * node, first
        else:
            begin, node, capacities = middle, 2 * node + 1, capacities - first
    return capacities


def shard_sizes(n: int, shards: int) -> np.ndarray:
    return np.array([n // shards + (i < n % shards) for i in range(shards)], dtype=np.int64)


def cell_sizes(n: int, shards: int, cells: int) -> np.ndarray:
    """Sizes of the cells of all shards, in order: each shard is cut into `cells` parts."""
    edges = [np.arange(cells + 1, dtype=np.int64) * s // cells for s in shard_sizes(n, shards).tolist()]
    return np.concatenate([np.diff(e) for e in edges])


def dealer(sizes: np.ndarray, capacities: np.ndarray, seed: int) -> Column:
    """For a row's place (partition and number within it): the cell it goes to and its key there."""

    def deal(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labels = keys = None
        for at in batches:
            at = at.to_numpy()
            if labels is None and len(at):
                part = int(at[0] >> PLACE_BITS)
                rng = np.random.default_rng([seed, part, 1])
                labels = rng.permutation(np.repeat(np.arange(len(capacities), dtype=np.int32), matrix_row(sizes, capacities, part, seed)))
                keys = rng.integers(np.iinfo(np.int64).max, size=len(labels))
            place = at & ((1 << PLACE_BITS) - 1)
            if len(at) and place[-1] >= len(labels):
                raise ValueError("a partition has more rows than when it was counted")
            yield pd.DataFrame({"cell": labels[place], "key": keys[place]} if len(at) else {"cell": [], "key": []})

    return F.pandas_udf(deal, "cell int, key long")


def sharded(docs: DataFrame, shards: int = 8, seed: int = 42, stored: bool = False, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(shard, slot, row): every row of docs once, in a uniformly random order cut into shards whose sizes differ by one at most.

    docs is read twice and must have the same rows in the same partitions each time; unless the caller tells that it is a plain read of
    stored files, which has, it is written to the shared folder first.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    docs = docs if stored else written(docs, "unsharded")
    counted = docs.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each partition
    parts = max((r.part for r in counted), default=-1) + 1
    if parts > MAX_PARTITIONS:
        raise ValueError(f"{parts} input partitions; read with a larger spark.sql.files.maxPartitionBytes")
    sizes = np.zeros(parts, dtype=np.int64)
    for r in counted:
        sizes[r.part] = r.n
    n = int(sizes.sum())
    cells = max(1, min(math.ceil(n / shards / cell_rows), MAX_CELLS // shards))
    placed = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at"))
    dealt = placed.withColumn("to", dealer(sizes, cell_sizes(n, shards, cells), seed)("at")).select("row", "at", F.col("to.cell").alias("cell"), F.col("to.key").alias("key"))
    sorted_cells = dealt.repartitionById(shards * cells, F.col("cell")).sortWithinPartitions("key", "at")
    place = F.monotonically_increasing_id().bitwiseAND((1 << PLACE_BITS) - 1)
    before = F.expr(f"(cell % {cells}) * ({n // shards}L + IF(cell DIV {cells} < {n % shards}, 1, 0)) DIV {cells}")
    return sorted_cells.select(F.expr(f"CAST(cell DIV {cells} AS INT)").alias("shard"), (place + before).alias("slot"), "row")


def write_shards(found: DataFrame, path: str, compression: str = "zstd") -> None:
    """The shards as Parquet, a folder each (_shard), with _slot before the rows' own columns; every file has the rows of one cell in the order of their slots."""
    named = found.select(F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), "row.*")
    named.sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").option("compression", compression).parquet(path)
