"""Counting what cells hold, in packed messages.

Each cell sends its distinct keys, dealt by hash into blocks, one message for each block that it has keys of: sorted keys as
differences, byte planes, Zstandard. A block brings the messages of all cells together, adds up the counts of each key,
numbers those that are frequent, and answers each message in the order of its keys; a cell finds that order again from its
own texts, so that answers hold no keys. Numbers rise with the keys of a block, so answers tell them as differences. Messages never outnumber keys, and a key, however common, is one place in one message of each
cell that holds it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import U64, scrambled

#: Bytes of text for each block, on average.
BLOCK_BYTES = 32_000_000
#: Kinds of rows that a block returns: its sums, a frequent key, an answer.
SUMS, FREQUENT, ANSWER = 0, 1, 2
SENT = "block int, cell int, keys binary, n binary"
COUNTED = "kind int, block int, cell int, c binary, number binary, key long, n long, id long"
ANSWERED = "cell int, layer int, block int, c binary, number binary, rest binary"
SENT_ARROW = pa.schema([("block", pa.int32()), ("cell", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])
COUNTED_ARROW = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("cell", pa.int32()), ("c", pa.binary()), ("number", pa.binary()), ("key", pa.int64()), ("n", pa.int64()), ("id", pa.int64())])
ANSWERED_ARROW = pa.schema([("cell", pa.int32()), ("layer", pa.int32()), ("block", pa.int32()), ("c", pa.binary()), ("number", pa.binary()), ("rest", pa.binary())])


class Packer:
    """Arrays of 64-bit integers as compressed byte planes."""

    def __init__(self) -> None:
        self.press, self.open = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

    def pack(self, values: np.ndarray) -> bytes:
        return self.press.compress(np.ascontiguousarray(values, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())

    def unpack(self, data: bytes) -> np.ndarray:
        planes = np.frombuffer(self.open.decompress(data), np.uint8).reshape(8, -1)
        return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def dealing(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of keys by block, the blocks that there are, and where each begins (and the end)."""
    block = (scrambled(keys.view(U64)) % U64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    there, begin = np.unique(block[order], return_index=True)
    return order, there, np.append(begin, len(keys))


def send(cell: int, keys: np.ndarray, n: np.ndarray, blocks: int) -> pa.Table:
    """The messages of a cell with sorted distinct keys (as int64) and their counts."""
    order, there, begin = dealing(keys, blocks)
    keys, n, packer = keys[order], n[order], Packer()
    spans = list(zip(begin[:-1], begin[1:], strict=True))
    columns = [there.astype(np.int32), np.full(len(there), cell, np.int32), [packer.pack(np.diff(keys[a:b], prepend=0)) for a, b in spans], [packer.pack(n[a:b]) for a, b in spans]]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, SENT_ARROW, strict=True)], schema=SENT_ARROW)


def counter(blocks: int, least: int, rare_too: bool, most: int):
    """most: a number of a frequent key must be less. rare_too: answers tell the counts of keys that aren't frequent; else these are nought."""

    def count(table: pa.Table) -> pa.Table:
        packer, block = Packer(), table.column("block")[0].as_py()
        keys = [np.cumsum(packer.unpack(x.as_py())) for x in table.column("keys")]
        ends = np.cumsum([len(k) for k in keys])
        n = np.concatenate([packer.unpack(x.as_py()) for x in table.column("n")])
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        c = np.bincount(at, n, len(known)).astype(np.int64)
        frequent = c >= least
        rank = np.cumsum(frequent) - 1
        told = c if rare_too else np.where(frequent, c, 0)
        out = {f.name: [] for f in COUNTED_ARROW}

        def add(rows: int, **columns) -> None:
            for f in COUNTED_ARROW:
                out[f.name].append(pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type))

        add(1, kind=[SUMS], block=[block], n=[int(c.sum())], key=[int((c > 0).sum())])
        k = np.flatnonzero(frequent)
        if len(k) and int(rank[k[-1]]) * blocks + block >= most:
            raise OverflowError(f"numbers of frequent keys beyond {most}: raise least or the bits that suffix_tree.SHIFT gives them")
        add(len(k), kind=np.full(len(k), FREQUENT, np.int32), block=np.full(len(k), block, np.int32), key=known[k], n=c[k], id=rank[k] * blocks + block)
        rows = table.num_rows
        parts = np.split(at, ends[:-1])
        add(rows, kind=np.full(rows, ANSWER, np.int32), block=np.full(rows, block, np.int32), cell=table.column("cell").to_numpy(), c=[packer.pack(told[p]) for p in parts], number=[packer.pack(np.diff(rank[p[frequent[p]]], prepend=0)) for p in parts])
        return pa.table([pa.chunked_array(v) for v in out.values()], schema=COUNTED_ARROW)

    return count


def answers(counted: DataFrame, layer: int, numbers: bool = True) -> DataFrame:
    number = F.col("number") if numbers else F.lit(None).cast("binary").alias("number")
    return counted.where(F.col("kind") == ANSWER).select("cell", F.lit(layer).alias("layer"), "block", "c", number, F.lit(None).cast("binary").alias("rest"))


def answers_with(counted: DataFrame, layer: int, rests: DataFrame, blocks: int) -> DataFrame:
    """Answers with, for each frequent key, twice the rest of (number, rest), a whole number, or -1."""

    def attach(told: pa.Table, states: pa.Table) -> pa.Table:
        packer = Packer()
        rank, twice = states.column("number").to_numpy() // blocks, np.rint(2 * states.column("rest").to_numpy()).astype(np.int64)
        rest = np.full((int(rank.max()) if len(rank) else -1) + 2, -1, np.int64)  # the last place is for none
        rest[rank] = twice
        out = [packer.pack(rest[np.minimum(np.cumsum(packer.unpack(x.as_py())), len(rest) - 1)]) for x in told.column("number")]
        return pa.table([*(told.column(c) for c in ("cell", "layer", "block", "c", "number")), pa.chunked_array([pa.array(out, pa.binary())])], schema=ANSWERED_ARROW)

    rests = rests.select(F.pmod("number", F.lit(blocks)).cast("int").alias("block"), "number", "rest")
    return answers(counted, layer).groupBy("block").cogroup(rests.groupBy("block")).applyInArrow(attach, ANSWERED)


class Answers:
    """What a cell gets back."""

    def __init__(self, table: pa.Table, blocks: int, least: int) -> None:
        self.table, self.blocks, self.least, self.packer = table, blocks, least, Packer()
        self.layer, self.block = table.column("layer").to_numpy(), table.column("block").to_numpy()

    def of(self, layer: int, keys: np.ndarray, *columns: str) -> list[np.ndarray]:
        """Columns (c, number, rest) of the cell's sorted distinct keys; number and rest are -1 for keys that aren't frequent."""
        order, there, begin = dealing(keys, self.blocks)
        rows = np.flatnonzero(self.layer == layer)
        rows = rows[np.argsort(self.block[rows])]
        assert np.array_equal(self.block[rows], there), "a block's answer is missing"
        out = {c: np.full(len(keys), -1, np.int64) for c in columns}
        for i, a, b in zip(rows, begin[:-1], begin[1:], strict=True):
            c = self.told("c", i)
            frequent = order[a:b][c >= self.least]
            if "c" in out:
                out["c"][order[a:b]] = c
            if "number" in out:
                out["number"][frequent] = np.cumsum(self.told("number", i)) * self.blocks + self.block[i]
            if "rest" in out:
                out["rest"][frequent] = self.told("rest", i)
        return list(out.values())

    def told(self, column: str, row: int) -> np.ndarray:
        return self.packer.unpack(self.table.column(column)[int(row)].as_py())
