"""SimHash near-dedup: 64-bit fingerprints, BK-trees over shards of distinct fingerprints, connected components.

Shards: fingerprints within `radius` bits of each other agree in some blocks - BLOCKS - radius of them - of their bits, so a
fingerprint goes to one shard for each choice of that many blocks, keyed by the bits there (ten shards of 25 or 26 fixed bits by default).
Each shard is a BK-tree whose children are keyed by their integer Hamming distance to the parent, and each member is looked up
by following only edges within the radius. The trees stay with their shard's members instead of being broadcast: all trees
together grow with the corpus, and no broadcast of them has a size bound. A shard of over SHARD members is dealt out as pairs of
bounded parts, which meet every pair of members once; a shard returns a spanning star of each of its components, not its pairs.

Components are found by alternating large-star and small-star steps on tables, checkpointed after each round.

Defined cases: null and blank texts have fingerprint 0, linked like any other; repeated rows are alike; a component
whose ids are all null has a null component_id; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_bytes

SHINGLE, RADIUS, BLOCKS, SEED, SHARD = 3, 3, 5, 42, 20_000


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of a text as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    buffer = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(buffer, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        digest, last = xxhash.xxh64_intdigest, shingle - 1
        hashes = [digest(buffer[a:b], SEED) for a, b in zip((ends - lengths)[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = np.add.reduce(bits, axis=0, dtype=np.uint32) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def each(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(x.as_py(), shingle) for x in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", F.arrow_udf(each, "long")(text_bytes()).alias("fp"))


class BKTree:
    """Distinct fingerprints; a child hangs from its parent under their Hamming distance."""

    def __init__(self, fps: np.ndarray) -> None:
        self.fps, self.bits, self.children = fps, fps.view(np.uint64), [{} for _ in fps]
        stack = [np.arange(len(fps))] if len(fps) else []
        while stack:
            group = stack.pop()
            node, rest = group[0], group[1:]
            if not len(rest):
                continue
            d = np.bitwise_count(self.bits[rest] ^ self.bits[node])
            for k in np.unique(d):
                part = rest[d == k]
                self.children[node][int(k)] = int(part[0])
                stack.append(part)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, numbers of the queries within radius of it), going down for all queries at once."""
        queries = queries.view(np.uint64)
        stack = [(0, np.arange(len(queries)))] if len(self.fps) else []
        while stack:
            node, active = stack.pop()
            d = np.bitwise_count(queries[active] ^ self.bits[node]).astype(np.int16)
            hits = active[d <= radius]
            if len(hits):
                yield node, hits
            for k, child in self.children[node].items():
                near = active[np.abs(d - k) <= radius]
                if len(near):
                    stack.append((child, near))

    def stars(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Members and the least member of their component, for components of two or more; fps must ascend."""
        part = np.arange(len(self.fps))
        for _, hits in self.search(self.fps, radius):
            roots = np.unique(part[hits])
            if len(roots) > 1:
                part[np.isin(part, roots)] = roots[0]
        moved = np.flatnonzero(part != np.arange(len(part)))
        return self.fps[moved], self.fps[part[moved]]


def masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Signed 64-bit masks of every choice of blocks - radius blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    whole = [sum(c) for c in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def shard_links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """(a, b) with a > b: spanning stars of each shard's components; fps has distinct values of fp."""
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(masks(radius, blocks))])
    entries = fps.select("fp", F.explode(keys).alias("x")).select("x.t", "x.k", "fp")
    large = entries.groupBy("t", "k").count().where(F.col("count") > shard).select("t", "k", F.ceil(F.col("count") * 2 / shard).cast("int").alias("parts"))
    parts: Column = F.coalesce(F.col("parts"), F.lit(1))
    own = F.pmod(F.xxhash64(F.lit(3), "fp"), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    dealt = entries.join(large, ["t", "k"], "left").select("t", "k", "fp", F.explode(pairs).alias("p")).select("t", "k", "p.i", "p.j", "fp")
    dealt = dealt.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            ends = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1)) + 1
            bounds = np.concatenate([[0], ends, [len(rows)]])
            found = [BKTree(rows[a:b, 4]).stars(radius) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b - a > 1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])

        held = np.zeros((0, 5), np.int64)
        pieces: list[np.ndarray] = []
        for b in batches:
            new = np.stack([np.asarray(c, dtype=np.int64) for c in b.columns], axis=1)
            if not len(new):
                continue
            pieces.append(new)
            if sum(map(len, pieces)) < 20_000:
                continue
            held = np.concatenate(pieces)
            last = np.flatnonzero((held[:, :4] != held[-1, :4]).any(1))
            stop = last[-1] + 1 if len(last) else 0
            yield from stars(held[:stop]) if stop else ()
            pieces = [held[stop:]]
        if pieces:
            yield from stars(np.concatenate(pieces))

    return dealt.mapInArrow(link, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of a link, the least node it reaches."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        wide = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        narrow = wide.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(narrow.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(now)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    marked = cut(fingerprints(docs, shingle))
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    fps = cut(fps)
    roots = components(shard_links(fps.select("fp"), radius, blocks))
    rooted = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of = rooted.join(first, "root").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(of, F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
