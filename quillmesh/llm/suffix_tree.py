"""LM scoring with a probabilistic suffix tree over words.

The root is the distribution of single words, each count plus a half. A context of one to `depth` words is a state of the tree
if (a) it and some words after it occur at least `least` times, which is the same number at every corpus size, so that the tree
grows with the corpus; and (b) a divergence test holds: the words that follow it differ from what its longest suffix among the
states predicts, by KL and by G2. A state's distribution keeps those next words, each count less a discount, and leaves the rest
to that suffix; a token is scored by the longest suffix of its history that is a state.

The tree is a set of tables (the grams of each length, the states of each) and nothing of it is collected or broadcast. Texts
are hashed once, into packed cells of documents. These send their distinct words, then their distinct pairs of frequent words,
then from level to level the grams whose prefix and suffix are both frequent, each to be counted over all training documents
(module blocks), until a level has none or the depth is reached. States are found by joins of what is frequent; and each cell
gets back the counts and states of what stands in it. Numbers of frequent grams are 64-bit and checked against the bits that
keys give them.

Defined cases: null and empty texts have one token, the end; doc_id is integral; rows with a null doc_id are learnt from
and are not held out; without training tokens, known words are none and every token's share is 0.5 / 0.5; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, COUNTED, FREQUENT, SENT, SENT_ARROW, SUMS, Answers, Packer, answers, answers_with, counter, send
from .cells import CELL_BYTES, U64, WordHashes, dealt
from .common import remainder, written

#: A line feed is in no word, so it stands for the end.
END = U64(xxhash.xxh64_intdigest(b"\n"))
#: Occurrences from which words, pairs and triples count as frequent.
LEAST = 32
#: Divergence tests: nats for each occurrence, and nats in all; discount of an entry.
MIN_KL, MIN_G2, DISCOUNT = 0.02, 10.0, 0.5
#: Words in the longest contexts.
DEPTH = 4
#: A gram of two words or more is one long: the number of the gram without its last word, then the last word's number.
#: Words' numbers stay below 2^SHIFT and other grams' below 2^(62 - SHIFT), else OverflowError.
SHIFT, MASK = 28, (1 << 28) - 1
#: Packed cells in a file: each is some megabytes.
CELL_ROWS = 16


@dataclass
class Tree:
    """grams: the counted grams of one word, of two and so on, as blocks return them (their rows of kind FREQUENT have key, number
    as id, and count as n); states: of contexts of one word, of two and so on, (number of the context's gram, rest)."""

    total: int
    distinct: int
    blocks: int
    grams: list[DataFrame]
    states: list[DataFrame]


# --- within a cell -------------------------------------------------------------------------------------------------------


def packed(table: pa.Table) -> pa.Table:
    """A cell as one row: texts are hashed once, and each token is kept as the place of its word among the cell's words by frequency."""
    hashes, parts, packer = WordHashes(), [], Packer()
    for text in table.column("text"):
        parts.append(np.append(hashes(text.as_py().lower().split()), END))
    words, word, times = np.unique(np.concatenate(parts).view(np.int64), return_inverse=True, return_counts=True)
    often = np.argsort(-times, kind="stable")  # small places for frequent words, which packs better
    place = np.empty(len(words), np.int64)
    place[often] = np.arange(len(words))
    train = table.column("train").to_numpy(zero_copy_only=False).astype(np.int64)
    arrays = [packer.pack(x) for x in (np.diff(words, prepend=0), often, place[word], np.array([len(p) for p in parts]), train)]
    ids = pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64()))
    return pa.table([pa.array([table.column("cell")[0].as_py()], pa.int32()), ids, *(pa.array([x], pa.binary()) for x in arrays)], names=["cell", "doc_ids", "words", "often", "word", "lengths", "train"])


class Cell:
    """The tokens of a cell's texts with the words, pairs and triples in them, as far as they are known."""

    def __init__(self, table: pa.Table | pa.RecordBatch, back: pa.Table | None, blocks: int, least: int = LEAST, row: int = 0) -> None:
        packer = Packer()
        words, often, word, self.lengths, train = (packer.unpack(table.column(c)[row].as_py()) for c in ("words", "often", "word", "lengths", "train"))
        self.blocks, self.cell, self.doc_ids = blocks, table.column("cell")[row].as_py(), table.column("doc_ids")[row].as_py()
        self.words, self.word = np.cumsum(words), often[word]
        self.train = np.repeat(train.astype(bool), self.lengths)
        self.got = None if back is None else Answers(back, blocks, least)
        self.ends = (self.words == END.astype(np.int64))[self.word]

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """From pairs on: a length, the tokens that begin a gram of it whose prefix and suffix are frequent, the distinct grams in
        order, and the gram of each such token. A length's answers are looked up when the next length is asked for."""
        number = prefix = suffix = self.got.of(1, self.words, "number")[0][self.word]
        prefix = np.where(self.ends, -1, number)  # nothing follows an end
        n = 2
        while True:
            at = np.flatnonzero((prefix[:-1] >= 0) & (suffix[1:] >= 0))
            keys, gram = np.unique((prefix[at] << SHIFT) | number[at + n - 1], return_inverse=True)
            yield n, at, keys, gram
            prefix = suffix = np.full(max(0, len(prefix) - 1), -1, np.int64)
            prefix[at] = self.got.of(n, keys, "number")[0][gram]
            n += 1

    def sent(self, keys: np.ndarray, at: np.ndarray, train: np.ndarray) -> pa.Table:
        return send(self.cell, keys, np.bincount(at, train, len(keys)).astype(np.int64), self.blocks)


def word_sender(blocks: int):
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                cell = Cell(b, None, blocks, row=row)
                yield from cell.sent(cell.words, cell.word, cell.train).to_batches()

    return words


def gram_sender(blocks: int, least: int, length: int):
    def grams(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return SENT_ARROW.empty_table()
        cell = Cell(table, back, blocks, least)
        _, at, keys, gram = next(g for g in cell.grams() if g[0] == length)
        return cell.sent(keys, gram, cell.train[at])

    return grams


def in_state(root: np.ndarray, kept: np.ndarray, rest: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Probabilities in a state, or those of its suffix (root) where rest says that there is none."""
    return np.where(rest >= 0, (np.where(kept > 0, kept - DISCOUNT, 0.0) + rest * root) / np.maximum(context, 1.0), root)


def scorer(total: int, vocabulary: int, blocks: int, least: int, longest: int):
    """longest: words in the longest grams, two or more."""
    denominator = total + 0.5 * (vocabulary + 1)
    names = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}

    def apply(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in names.items()})
        cell = Cell(table, back, blocks, least)
        counts, rest = (x[cell.word] for x in cell.got.of(1, cell.words, "c", "rest"))
        root = (counts + 0.5) / denominator
        p, context, rest = root.copy(), counts, np.where(cell.ends, -1, rest)
        for n, at, keys, gram in cell.grams():
            c, left = np.zeros(max(0, len(context) - 1), np.int64), np.full(max(0, len(context) - 1), -1, np.int64)
            told = cell.got.of(n, keys, "c", *(["rest"] if n < longest else []))
            c[at] = told[0][gram]
            p[n - 1 :] = in_state(p[n - 1 :], c, rest[:-1] / 2, context[:-1])
            if n == longest:
                break
            left[at] = told[1][gram]
            context, rest = c, left
        starts = np.concatenate([[0], np.cumsum(cell.lengths)[:-1]])
        known, base, scores = (np.add.reduceat(x, starts) for x in ((counts > 0).astype(np.int64), np.log10(root), np.log10(p)))
        columns = [cell.lengths, known, np.full(len(known), total), base, scores]
        return pa.table({"doc_id": pa.array(cell.doc_ids, pa.int64()), **{k: pa.array(v, names[k]) for k, v in zip(list(names)[1:], columns, strict=True)}})

    return apply


# --- over all cells ------------------------------------------------------------------------------------------------------


def states(entries: DataFrame, context: str) -> DataFrame:
    """(context, rest): those contexts that pass the divergence tests, of entries (context, of_context, c, by_suffix)."""
    seen = entries.groupBy(context).agg(
        F.max("of_context").alias("n"),
        F.sum("c").alias("kept"),
        F.sum("by_suffix").alias("kept_share"),
        F.sum(F.col("c") * F.log(F.col("c") / F.col("of_context") / F.col("by_suffix"))).alias("gain"),
        F.count(F.lit(1)).alias("entries"),
    )
    left = F.col("n") - F.col("kept")
    # what is left to the suffix diverges too: by the log-sum inequality, at least as the two rests do
    left_gain = F.when(left > 0, left * F.log(left / F.col("n") / F.greatest(1 - F.col("kept_share"), F.lit(1e-12)))).otherwise(0.0)
    gain = F.col("gain") + left_gain
    return seen.where((gain >= MIN_G2) & (gain >= MIN_KL * F.col("n"))).select(context, (left + DISCOUNT * F.col("entries")).alias("rest"))


def cells_of(docs: DataFrame, train: Column, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Packed cells, as a table with one row for each."""
    cells = dealt(docs, cell_bytes).withColumn("train", train)
    columns = "cell int, doc_ids array<long>, words binary, often binary, word binary, lengths binary, train binary"
    return written(cells.groupBy("cell").applyInArrow(packed, columns), "cells", rows_per_file=CELL_ROWS)


def fit(cells: DataFrame, blocks: int, least: int = LEAST, depth: int = DEPTH) -> Tree:
    """The tree of packed cells, learnt from their texts with train, with contexts of up to depth (one or more) words."""

    def counted(sent: DataFrame, length: int, bits: int, rare_too: bool = False) -> DataFrame:
        return written(sent.groupBy("block").applyInArrow(counter(blocks, least, rare_too, 1 << bits), COUNTED), f"grams{length}")

    words = counted(cells.mapInArrow(word_sender(blocks), SENT), 1, SHIFT, True)
    row = words.where(F.col("kind") == SUMS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("key"), F.lit(0))).first()
    total, vocabulary = int(row[0]), int(row[1])
    share = (F.col("n") + 0.5) / F.lit(total + 0.5 * (vocabulary + 1))
    frequent = F.col("kind") == FREQUENT
    # a level's frequent grams: number, key, count, number of the gram without its first word, share given the longest state before its last
    level = words.where(frequent).select("id", F.col("id").alias("key"), "n", F.lit(0).cast("long").alias("suffix"), share.alias("p"))
    tree, told = Tree(total, vocabulary, blocks, [words], []), answers(words, 1)
    for length in range(2, depth + 2):
        last = length == depth + 1
        sent = cells.groupBy("cell").cogroup(told.groupBy("cell")).applyInArrow(gram_sender(blocks, least, length), SENT)
        grams = counted(sent, length, 62 if last else 62 - SHIFT)
        found = grams.where(frequent)
        if length > 2 and found.isEmpty():
            break
        gram = found.select("id", "key", F.col("n").alias("c"), F.shiftright("key", SHIFT).alias("context"), F.col("key").bitwiseAND(MASK).alias("last"))
        before = level.select(F.col("id").alias("context"), F.col("n").alias("of_context"), F.col("suffix").alias("middle"))
        shorter = level.select(F.col("key").alias("suffix_key"), F.col("id").alias("suffix"), F.col("p").alias("by_suffix"))
        suffix_key = F.shiftleft(F.col("middle"), SHIFT).bitwiseOR(F.col("last")).alias("suffix_key")
        entries = gram.join(before, "context").select("id", "key", "c", "context", "of_context", suffix_key).join(shorter, "suffix_key")
        kept = written(states(entries, "context"), f"states{length - 1}")
        tree.grams.append(grams)
        tree.states.append(kept.withColumnRenamed("context", "number"))
        if not last:
            here = (F.col("c") - DISCOUNT + F.col("rest") * F.col("by_suffix")) / F.col("of_context")
            p = F.coalesce(here, F.col("by_suffix")).alias("p")
            level = written(entries.join(kept, "context", "left").select("id", "key", F.col("c").alias("n"), "suffix", p), f"level{length}")
            told = told.unionAll(answers(grams, length))
    return tree


def score(docs: DataFrame, held_out: int = 1, folds: int = 5, least: int = LEAST, cell_bytes: int = CELL_BYTES, block_bytes: int = BLOCK_BYTES, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The tree and the counts are learnt from rows whose crc32(doc_id) mod folds is not held_out, so a row is never
    scored by itself unless it is one of those.
    """
    out: Column = F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False))
    cells = cells_of(docs, ~out, cell_bytes)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tree = fit(cells, max(1, math.ceil(size / block_bytes)), least, depth)
    longest = len(tree.grams)
    told = answers(tree.grams[-1], longest, numbers=False)
    for length, (grams, kept) in enumerate(zip(tree.grams, tree.states), 1):
        told = told.unionAll(answers_with(grams, length, kept, tree.blocks))
    columns = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = cells.groupBy("cell").cogroup(told.groupBy("cell")).applyInArrow(scorer(tree.total, tree.distinct, tree.blocks, least, longest), columns)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def perplexity(log10_score: float, n_tokens: int) -> float:
    return math.pow(10, -log10_score / n_tokens)
