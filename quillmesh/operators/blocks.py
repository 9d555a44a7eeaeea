"""All pairs of two sets of vectors, as products of blocks: rows of the left in blocks meet blocks of the right by number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import numbered

#: Rows of a block on each side; pairs that leave a task at once.
LEFT, RIGHT = 256, 1024

Product = Callable[[pa.RecordBatch, pa.RecordBatch], pa.RecordBatch]


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as rows."""
    return pc.list_flatten(column).to_numpy().reshape(len(column), -1)


def in_blocks(right: DataFrame, size: int = RIGHT) -> DataFrame:
    """(block, rows): rows in order of node_id, size to a block, numbered from 0."""
    placed = numbered(right, ["node_id"], "_i")
    rows = F.array_sort(F.collect_list(F.struct("node_id", *[c for c in right.columns if c != "node_id"])))
    return placed.groupBy(F.floor((F.col("_i") - 1) / size).alias("block")).agg(rows.alias("rows"))


def crossed(left: DataFrame, right: DataFrame, product: Product, schema: str, left_size: int = LEFT, right_size: int = RIGHT) -> DataFrame:
    """What product makes of each block of left with each block of right (node_id and other columns), in order of node_id.

    No row meets a row outside a product of blocks. A block of the left, packed as one row, goes to as many tasks as there are blocks
    on the right; a block of the right to those that hold a block of the left. Where blocks on the right are fewer than shuffle partitions,
    blocks of the left are dealt in turn to copies of them, so that one block is not one task. An empty right gives no rows.
    """
    blocks = in_blocks(right, right_size)
    n = blocks.count()
    copies = -(-int(right.sparkSession.conf.get("spark.sql.shuffle.partitions")) // max(n, 1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for b in batches:
            for at in range(0, b.num_rows, left_size):
                turn += 1
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as w:
                    w.write_batch(b.slice(at, left_size))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([turn % copies], pa.int64())], ["packed", "turn"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                mine = pa.ipc.open_stream(b.column("packed")[i].as_buffer()).read_next_batch()
                yield product(mine, pa.RecordBatch.from_struct_array(b.column("rows").slice(i, 1).flatten()))

    upto = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    rows = left.mapInArrow(pack, "packed binary, turn long").withColumn("block", upto(max(n, 1)))
    return rows.join(blocks.withColumn("turn", upto(copies)), ["block", "turn"]).select("packed", "rows").mapInArrow(meet, schema)
