"""Cells: bounded groups of documents, dealt by a hash, to which facts about the whole corpus are returned.

An operator that must compare each document with all others reduces a cell to distinct keys, has the keys of all cells
brought together by key, and sends back to each cell what its own documents need. Texts are shuffled once (all uses of a plan
share the exchange); a key, however common, is one row for each cell that holds it.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, text_key

#: Bytes of text in a cell, on average.
CELL_BYTES = 6_000_000
MEMO = 300_000
U64 = np.uint64


def dealt(docs: DataFrame, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(cell, doc_id, text as bytes); repeated ids spread by their texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / cell_bytes))
    cell = F.pmod(F.xxhash64("doc_id", text_key()), F.lit(n)).cast("int")
    return docs.select(cell.alias("cell"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))


class WordHashes:
    """64-bit hashes of words, keeping those of up to MEMO words."""

    def __init__(self, memo: int = MEMO) -> None:
        self.size, self.memo = memo, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo, digest = self.memo, xxhash.xxh64_intdigest
        if len(memo) > self.size:
            memo.clear()
        get = memo.get
        found = [get(w) for w in words]
        if None in found:
            for i, h in enumerate(found):
                if h is None:
                    found[i] = memo[words[i]] = digest(words[i])
        return np.frombuffer(array("Q", found), U64)


def scrambled(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that leaves no order."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def rolled(h: np.ndarray, n: int, factor: int) -> np.ndarray:
    """Hashes of all runs of n values, modulo 2^64."""
    size = max(0, len(h) - n + 1)
    out, factor = np.zeros(size, U64), U64(factor)
    for j in range(n):
        out *= factor
        out += h[j : j + size]
    return out
