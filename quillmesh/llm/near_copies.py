"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8, and what they link.

Candidates come from SimHash fingerprints of the shingles within RADIUS bits of each other, found in the BK-trees of simhash, and,
since pairs near 0.8 differ in more bits than trees can tell apart, from MinHash bands: a pair at exactly 0.8 shares none of BANDS
bands of ROWS with probability 7e-5, a closer pair less often. Both kinds of links give components of candidates; the texts of each such component are brought together once
and all its pairs are compared by their exact shingle sets. A component over its bounds is dealt out as pairs of bounded
parts, which meet every pair of members; its cost grows with the square of its size.

Texts alike in their words (ASCII case and white space aside) are one node from the start, so exact copies are never compared.

Defined cases: null and blank texts are copies of each other; a text of under five words is its own only shingle; null and
repeated ids are no reason to drop a row, as rows are told apart by id and text; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import U64, WordHashes, rolled, scrambled
from .common import cut, text_bytes, text_key
from .simhash import RADIUS, components, shard_links, simhash

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 5
#: Bounds of what is compared in one go: documents, bytes of text.
GROUP, GROUP_BYTES = 1_000, 8_000_000
FACTOR = 0x9E3779B97F4A7C15
_SEEDS = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
TIMES, PLUS = _SEEDS[0] * U64(2) + U64(1), _SEEDS[1] * U64(2)


def shingles(words: list[bytes], hashed: WordHashes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of lower-case words."""
    if not words:
        return np.zeros(0, U64)
    return np.unique(scrambled(rolled(hashed(words), min(shingle, len(words)), FACTOR)))


def bands(found: np.ndarray) -> np.ndarray:
    """The hash of each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, U64)
    for i in range(0, len(found), 1024):
        values = np.multiply.outer(TIMES, found[i : i + 1024])
        values += PLUS[:, None]
        np.minimum(least, values.min(1), out=least)
    out = np.zeros(BANDS, U64)
    for column in least.reshape(BANDS, ROWS).T:
        out = scrambled(out * U64(FACTOR) + column)
    return out


MARKS = "node long, bands array<long>, fp long"


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, size, node, bands, fp) of every row; texts alike in their words have one node, short ones have no bands and no fingerprint."""

    def each(texts: pa.Array) -> pa.Array:
        hashed, nodes, found, fps = WordHashes(), [], [], []
        for x in texts:
            words = x.as_py().lower().split()
            nodes.append(xxhash.xxh64_intdigest(b" ".join(words), 42))
            found.append(bands(shingles(words, hashed)).view(np.int64) if len(words) > SHINGLE else [])
            fps.append(int(np.uint64(simhash(x.as_py(), SHINGLE)).view(np.int64)) if len(words) > SHINGLE else None)
        return pa.StructArray.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(found, pa.list_(pa.int64())), pa.array(fps, pa.int64())], ["node", "bands", "fp"])

    out = docs.select("doc_id", text_key().alias("text_key"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.arrow_udf(each, MARKS)(text_bytes()).alias("m"))
    return out.select("doc_id", "text_key", "size", "m.node", "m.bands", "m.fp")


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that join all nodes whose fingerprints chains of steps of at most radius bits join."""
    held = nodes.where("fp is not null").select("node", "fp")
    leaders = cut(held.groupBy("fp").agg(F.min("node").alias("leader")))
    same = held.join(leaders, "fp").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    one, other = (leaders.select(F.col("fp").alias(x), F.col("leader").alias(f"_{x}")) for x in "ab")
    near = shard_links(leaders.select("fp"), radius).distinct().join(one, "a").join(other, "b")
    return same.unionByName(near.select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def candidates(nodes: DataFrame) -> DataFrame:
    """(node, root): the components that near fingerprints and shared bands link, all members listed; nodes has distinct values of node."""
    entries = nodes.select("node", F.posexplode("bands").alias("t", "k"))
    leaders = entries.groupBy("t", "k").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    links = entries.join(leaders, ["t", "k"]).where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    found = components(links.unionByName(fingerprint_links(nodes)))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def compared(texts: list[bytes], hashed: WordHashes, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that join those of the texts which chains of similar pairs join."""
    sets = [shingles(x.lower().split(), hashed) for x in texts]
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(codes, kind="stable")
    begin = np.searchsorted(codes[order], np.arange(codes.max(initial=-1) + 2))
    owners, ends = owners[order], np.cumsum(sizes)
    part, links = np.arange(len(sets)), []
    for i in range(len(sets)):
        if (part == part[i]).all():
            continue  # nothing is left to join to it
        mine = codes[ends[i] - sizes[i] : ends[i]]
        common = np.bincount(np.concatenate([owners[begin[c] : begin[c + 1]] for c in mine.tolist()]), minlength=len(sets))
        # The small margin keeps pairs at exactly the threshold, which rounding could lose.
        for j in np.flatnonzero(common >= similarity * (sizes + sizes[i] - common) - 1e-9):
            if part[j] != part[i]:
                links.append((i, int(j)))
                part[part == part[j]] = part[i]
    return links


def similar(docs: DataFrame, members: DataFrame, group: int = GROUP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(a, b): links between similar members; members is (node, root, doc_id, text_key, size) with one row for each node."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    sizes = sizes.where((F.col("n") > group) | (F.col("bytes") > group_bytes)).select("root", F.ceil(F.greatest(F.col("n") * 2 / group, F.col("bytes") * 2 / group_bytes)).cast("int").alias("parts"))
    parts = F.coalesce(F.col("parts"), F.lit(1))
    own = F.pmod(F.xxhash64(F.lit(3), "node"), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    wanted = members.select("node", "root", F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"))
    rows = docs.select("doc_id", text_key().alias("text_key"), text_bytes().alias("text"))
    held = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("text_key").eqNullSafe(F.col("_k")))
    dealt = held.join(sizes, "root", "left").select("root", "node", "text", F.explode(pairs).alias("p")).select("root", "p.i", "p.j", "node", "text")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes()

        def links(nodes: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            found = compared(texts, hashed) if len(nodes) > 1 else []
            if found:
                a, b = (pa.array([nodes[x[k]] for x in found], pa.int64()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

        now, nodes, texts = None, [], []
        for batch in batches:
            for root, i, j, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, i, j) != now:
                    yield from links(nodes, texts)
                    now, nodes, texts = (root, i, j), [], []
                if not nodes or nodes[-1] != node:  # rows alike in id and text
                    nodes.append(node)
                    texts.append(text)
        yield from links(nodes, texts)

    return dealt.mapInArrow(link, "a long, b long")


def representatives(docs: DataFrame, group: int = GROUP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, text_key) of one row for each component of near copies: that with the smallest id (a null one only where there is no other)."""
    rows = cut(marked(docs))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "size")
    nodes = cut(rows.groupBy("node").agg(F.min(row).alias("r"), F.first("bands").alias("bands"), F.first("fp").alias("fp")))
    members = cut(candidates(nodes).join(nodes, "node").select("node", "root", "r.doc_id", "r.text_key", "r.size"))
    roots = components(similar(docs, members, group, group_bytes))
    of = nodes.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    return of.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("r").alias("r")).select("r.doc_id", "r.text_key")
