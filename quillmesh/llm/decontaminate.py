"""Benchmark decontamination with a distributed positional inverted index.

The index is a table in the shared folder: documents are dealt into shards (an Arrow batch each), and for each shard and term there
is one row with the sorted positions at which the term stands, so a term, however common, is one row for each shard that has it.
Test items are cut into windows where they are stored; each window is sent, by its rarest term over the whole index, to the
shards that hold that term. There its term's list, less the term's offset in the window, is intersected with the
offset-adjusted lists of its other terms, rarest first, until it is empty or the window is matched. With slop, a term may stand
up to that many words off its place (proximity matches); the exact ones are those with none.

Neither documents nor test items pass through the driver, and neither is broadcast; the distinct terms of the benchmark are, if
they are at most BROADCAST_ROWS, so that only lists of such terms move. A shard's windows are dealt into blocks, so the benchmark
may be of any size.

Defined cases: a null text has no words; an item without words or with a null id matches nothing; an item of fewer words
than a window is one window; items that share an id count once; rows are judged one by one, whatever their doc_id, and rows
alike in doc_id and text alike; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, text_bytes, text_key, written

WINDOW = 13
SLOP = 2
#: A document is contaminated if SHARE times its hit words are its words or more.
SHARE = 20
#: Windows of a block, on average.
BLOCK_WINDOWS = 1_000_000
#: ASCII other than letters and digits becomes a space, A-Z becomes a-z.
FOLD = bytes(32 if i < 128 and not chr(i).isalnum() else ord(chr(i).lower()) if i < 128 else i for i in range(256))
#: Rows of the index: a term's positions (term is null for the starts of the shard's documents), or a document.
INDEX = "shard long, term binary, n long, positions binary, place int, doc_id long, text_key long, n_words long"
INDEX_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("positions", pa.binary()), ("place", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64())])


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of 32-bit numbers as binary values, without a copy of each."""
    ends = np.concatenate([[0], np.cumsum(counts) * 4]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data, np.int32))])


def postings(shard: int, texts: list[bytes], doc_ids: pa.Array, keys: pa.Array, gap: int) -> Iterator[pa.RecordBatch]:
    """The index rows of a shard; gap places that hold no word stand after each document."""
    numbers: dict[bytes, int] = {}
    parts, n_words = [], []
    for text in texts:
        w = words(text)
        n_words.append(len(w))
        for x in w:
            if x not in numbers:
                numbers[x] = len(numbers)
        parts.append(np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)))
    sizes = np.array(n_words, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]])
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    at = np.arange(len(ids)) + np.repeat(np.arange(len(sizes)) * gap, sizes)
    order = np.argsort(ids, kind="stable")
    counts = np.bincount(ids, minlength=len(numbers))

    def rows(many: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(many, f.type)) for f in INDEX_ARROW], schema=INDEX_ARROW)

    n = len(sizes)
    yield rows(n, shard=pa.array(np.full(n, shard)), place=pa.array(np.arange(n, dtype=np.int32)), doc_id=doc_ids, text_key=keys, n_words=pa.array(sizes))
    yield rows(1, shard=pa.array([shard], pa.int64()), positions=binaries(starts, np.array([n])))
    if numbers:
        yield rows(len(numbers), shard=pa.array(np.full(len(numbers), shard)), term=pa.array(list(numbers), pa.binary()), n=pa.array(counts.astype(np.int64)), positions=binaries(at[order], counts))


def build(docs: DataFrame, slop: int = SLOP) -> DataFrame:
    """The index of docs, stored."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for i, b in enumerate(batches):
            if b.num_rows:
                yield from postings(base + i, [x.as_py() for x in b.column("text")], b.column("doc_id"), b.column("text_key"), 2 * slop + 1)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), text_bytes().alias("text"))
    return written(rows.mapInArrow(shards, INDEX), "index")


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, id, terms): the distinct windows of each item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items, terms = [], []
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = words(text)
                for part in dict.fromkeys(tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1) if w else 0)):
                    items.append(item)
                    terms.append(part)
            for at in range(0, len(items), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(items[at : at + 10_000], pa.string()), pa.array(terms[at : at + 10_000], pa.list_(pa.binary()))], ["item", "terms"])

    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), text_bytes().alias("text"))
    return items.mapInArrow(split, "item string, terms array<binary>").distinct().withColumn("id", F.xxhash64("item", "terms"))


class Shard:
    """Positions of the terms that a block's windows need, in one shard."""

    def __init__(self, starts: np.ndarray, lists: dict[bytes, np.ndarray]) -> None:
        self.start, self.lists = starts, lists

    def find(self, window: list[bytes], slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of matches, and which of them are exact; the window's place is that of its rarest term."""
        none = np.zeros(0, np.int64)
        found = [self.lists.get(t, none) for t in window]
        rarest = sorted(range(len(window)), key=lambda j: (len(found[j]), j))
        starts = found[rarest[0]] - rarest[0]
        exact = np.ones(len(starts), bool)
        for j in rarest[1:]:
            if not len(starts):
                break
            p, at = found[j], starts + j
            i = np.searchsorted(p, at)
            off = np.minimum(np.abs(p[np.minimum(i, len(p) - 1)] - at), np.abs(p[np.maximum(i - 1, 0)] - at))
            exact &= off == 0
            starts, exact = starts[off <= slop], exact[off <= slop]
        return starts, exact

    def search(self, looked_for: list[tuple[str, list[bytes]]], slop: int) -> dict[int, tuple[set[int], set[str], set[str]]]:
        """By the place of the document: hit words, items matched exactly, items matched nearby."""
        out: dict[int, tuple[set[int], set[str], set[str]]] = {}
        for item, window in looked_for:
            starts, exact = self.find(window, slop)
            for at, e in zip(starts.tolist(), exact.tolist(), strict=True):
                # near matches may begin before their document, in the gap
                doc = int(np.searchsorted(self.start, at if e else at + slop, "right")) - 1
                hits, here, near = out.setdefault(doc, (set(), set(), set()))
                if e:
                    first = at - int(self.start[doc])
                    hits.update(range(first, first + len(window)))
                    here.add(item)
                else:
                    near.add(item)
        return out


FOUND = "shard long, place int, hits array<int>, items array<string>, near array<string>"


def look(slop: int):
    kind = pa.schema([("shard", pa.int64()), ("place", pa.int32()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])

    def search(wanted: pa.Table, held: pa.Table) -> pa.Table:
        starts, lists = None, {}
        for term, positions in zip(held.column("term").to_pylist(), held.column("positions").to_pylist(), strict=True):
            p = np.frombuffer(positions, np.int32).astype(np.int64)
            if term is None:
                starts = p
            else:
                lists[term] = p
        if starts is None or not wanted.num_rows:
            return kind.empty_table()
        found = Shard(starts, lists).search(list(zip(wanted.column("item").to_pylist(), wanted.column("terms").to_pylist(), strict=True)), slop)
        shard = wanted.column("shard")[0].as_py()
        rows = [(shard, doc, sorted(h), sorted(i), sorted(n)) for doc, (h, i, n) in found.items()]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind) if rows else kind.empty_table()

    return search


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, text_key, n_words, hits, items, near) of every row: hit word positions, ids of items matched exactly and only nearby."""
    index = build(docs, slop)
    looked_for = written(windows(benchmark, window), "windows")
    blocks = max(1, -(-looked_for.count() // block_windows))
    uses = looked_for.select("item", "id", "terms", F.explode(F.array_distinct("terms")).alias("term"))
    vocabulary = checked_broadcast(uses.select("term").distinct())
    terms = index.where(F.col("term").isNotNull()).join(vocabulary, "term", "left_semi")  # the rest of the index stays where it is
    counts = terms.groupBy("term").agg(F.sum("n").alias("n"))  # over the whole index
    # windows all of whose terms there are, by their rarest
    rarest = uses.join(counts, "term").groupBy("item", "id", "terms").agg(F.min(F.struct("n", "term")).alias("r"), F.count(F.lit(1)).alias("_k"))
    rarest = rarest.where(F.col("_k") == F.size(F.array_distinct("terms"))).select("item", "id", "terms", F.col("r.term").alias("term"))
    wanted = written(terms.select("shard", "term").join(rarest, "term").select("shard", F.pmod("id", F.lit(blocks)).cast("int").alias("block"), "item", "terms"), "wanted")
    held = terms.select("shard", F.lit(0).alias("block"), "term", "positions")
    if blocks > 1:  # a block gets the lists of its own terms
        needed = wanted.select("shard", "block", F.explode("terms").alias("term")).distinct()
        held = held.drop("block").join(needed, ["shard", "term"]).select("shard", "block", "term", "positions")
    starts = index.where(F.col("term").isNull() & F.col("positions").isNotNull()).select("shard", "term", "positions")
    held = held.unionByName(starts.join(wanted.select("shard", "block").distinct(), "shard").select("shard", "block", "term", "positions"))
    held = held.select(F.col("shard").alias("s"), F.col("block").alias("b"), "term", "positions")
    found = wanted.groupBy("shard", "block").cogroup(held.groupBy("s", "b")).applyInArrow(look(slop), FOUND)

    def united(name: str):
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)

    found = found.groupBy("shard", "place").agg(united("hits"), united("items"), united("near"))
    rows = index.where(F.col("place").isNotNull()).select("shard", "place", "doc_id", "text_key", "n_words")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return rows.join(found, ["shard", "place"], "left").select("doc_id", "text_key", "n_words", F.coalesce("hits", none("int")).alias("hits"), F.coalesce("items", none("string")).alias("items"), F.coalesce(F.array_except("near", "items"), none("string")).alias("near"))


def verdicts(found: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id and text_key with n_words, n_hit, n_items, items_sha256, contaminated, n_near, from matches()."""
    n_hit = F.size("hits").cast("long")
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), F.size("near").cast("long").alias("n_near"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated."""
    bad = verdicts(matches(docs, benchmark)).where("contaminated").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct()
    bad = checked_broadcast(bad)
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_d")) & (text_key() == F.col("_k")), "left_anti")
