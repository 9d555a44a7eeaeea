"""Substring dedup by repeated-phrase automata.

A word goes if a window of `window` words that covers it also starts in a document with a smaller doc_id; windows are those of
the input. Every window is stood for by the least hash of the short phrases in it (its anchor), which depends on the window
alone, so windows that recur share a recurring anchor. Cells of documents send their distinct anchors to be counted, get
back those that recur, send the hashes of the windows that have one, and get back, for each that recurs, the least
doc_id it starts in. That confirms the passages: maximal runs of recurring windows. Each cell is one shard of the
automaton: its passages, as sequences of word numbers, are compiled into an Aho-Corasick automaton through which the cell's
documents are streamed, and each occurrence found marks the words of those windows that have an earlier document.

Defined cases: a null text has no words; doc_id is integral; a row with a null doc_id keeps all words and takes none from
others; rows that share a doc_id do not take words from each other; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .cells import U64, WordHashes, dealt, rolled, scrambled

WINDOW, PHRASE = 13, 5
FIRST, SECOND, THIRD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xF1357AEA2E62A9C5


def anchors(h: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """The anchor of each window."""
    g = scrambled(rolled(h, phrase, FIRST))
    n = len(h) - window + 1
    least = g[:n]
    for j in range(1, window - phrase + 1):
        least = np.minimum(least, g[j : j + n])
    return least


def window_hashes(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Eighty bits for each window: what is shuffled most is kept short."""
    return rolled(h, window, SECOND), (rolled(scrambled(h), window, THIRD) >> U64(48)).astype(np.int16)


def texts_of(table: pa.Table) -> Iterator[tuple[int | None, bytes]]:
    ids = table.column("doc_id")
    for i, text in enumerate(table.column("text")):
        yield ids[i].as_py(), text.as_py()


def first_pass(window: int, phrase: int):
    def distinct(table: pa.Table) -> pa.Table:
        hashes, seen = WordHashes(), []
        for doc, text in texts_of(table):
            words = text.split()
            if doc is not None and len(words) >= window:
                seen.append(np.unique(anchors(hashes(words), window, phrase)))
        a, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, U64), np.zeros(0, int))
        cell = table.column("cell")[0].as_py()
        return pa.table({"h": a.view(np.int64), "cell": np.full(len(a), cell, np.int32), "many": n > 1})

    return distinct


def second_pass(window: int, phrase: int):
    def candidates(table: pa.Table, back: pa.Table) -> pa.Table:
        recurring = np.sort(back.column("h").to_numpy().view(U64))
        hashes, one, two, low = WordHashes(), [], [], []
        for doc, text in texts_of(table) if len(recurring) else ():
            words = text.split()
            if doc is None or len(words) < window:
                continue
            h = hashes(words)
            a = anchors(h, window, phrase)
            at = np.flatnonzero(recurring[np.minimum(np.searchsorted(recurring, a), len(recurring) - 1)] == a)
            if len(at):
                w1, w2 = window_hashes(h, window)
                one.append(w1[at])
                two.append(w2[at])
                low.append(np.full(len(at), doc, np.int64))
        if not one:
            return pa.table({k: pa.array([], t) for k, t in (("w1", pa.int64()), ("w2", pa.int16()), ("cell", pa.int32()), ("lo", pa.int64()), ("many", pa.bool_()))})
        w1, w2, doc = np.concatenate(one), np.concatenate(two), np.concatenate(low)
        order = np.lexsort((doc, w2, w1))
        w1, w2, doc = w1[order], w2[order], doc[order]
        new = np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
        start = np.flatnonzero(new)
        last = np.concatenate([start[1:], [len(w1)]]) - 1
        cell = table.column("cell")[0].as_py()
        return pa.table({"w1": w1[start].view(np.int64), "w2": w2[start], "cell": np.full(len(start), cell, np.int32), "lo": doc[start], "many": doc[last] > doc[start]})

    return candidates


class Passages:
    """A shard of the automaton: passages as sequences of word numbers, each with the first document of its windows."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.found: dict[tuple[int, ...], np.ndarray] = {}

    def number(self, words: list[bytes]) -> list[int]:
        set_default, numbers = self.numbers.setdefault, self.numbers
        return [set_default(w, len(numbers)) for w in words]

    def add(self, words: list[int], first: np.ndarray, window: int) -> None:
        """first: by window the least document, or -1 where the window doesn't recur."""
        known = np.flatnonzero(first != np.iinfo(np.int64).max)
        for run in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1):
            if len(run):
                self.found.setdefault(tuple(words[run[0] : run[-1] + window]), first[run[0] : run[-1] + 1])

    def compiled(self) -> tuple[ahocorasick.Automaton, list[tuple[int, np.ndarray]]]:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        values = []
        for i, (words, first) in enumerate(self.found.items()):
            automaton.add_word(words, i)
            values.append((len(words), first))
        automaton.make_automaton()
        return automaton, values


def third_pass(window: int):
    none = np.iinfo(np.int64).max
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])

    def locate(table: pa.Table, back: pa.Table) -> pa.Table:
        w1, w2, lo = back.column("w1").to_numpy().view(U64), back.column("w2").to_numpy(), back.column("first").to_numpy()
        order = np.lexsort((w2, w1))
        w1, w2, lo = w1[order], w2[order], lo[order]
        hashes, shard, hit = WordHashes(), Passages(), {}
        for i, (doc, text) in enumerate(texts_of(table)) if len(w1) else ():
            words = text.split()
            if doc is None or len(words) < window:
                continue
            a, b = window_hashes(hashes(words), window)
            at = np.searchsorted(w1, a)
            first = np.full(len(a), none)
            todo = np.flatnonzero((at < len(w1)) & (w1[np.minimum(at, len(w1) - 1)] == a))
            while len(todo):  # equal first parts stand side by side
                here = at[todo]
                same = w2[here] == b[todo]
                first[todo[same]] = lo[here[same]]
                todo = todo[~same]
                at[todo] += 1
                todo = todo[at[todo] < len(w1)]
                todo = todo[w1[at[todo]] == a[todo]]
            if (first != none).any():
                numbers = shard.number(words)
                shard.add(numbers, first, window)
                hit[i] = numbers
        automaton, values = shard.compiled() if hit else (None, [])
        out = {k: [] for k in ("doc_id", "n_words", "removed", "kept")}
        for i, (doc, text) in enumerate(texts_of(table)):
            words = text.split()
            spans = []
            if i in hit:
                marks = np.zeros(len(words) + 1, np.int64)
                for end, k in automaton.iter(tuple(hit[i])):
                    length, first = values[k]
                    starts = end - length + 1 + np.flatnonzero(first < doc)
                    marks[starts] += 1
                    marks[starts + window] -= 1
                gone = np.concatenate([[0], (np.cumsum(marks[:-1]) > 0).astype(np.int8), [0]])
                turns = np.flatnonzero(np.diff(gone))
                spans = [{"start": int(a), "stop": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)]
                for s in reversed(spans):
                    del words[s["start"] : s["stop"]]
            out["doc_id"].append(doc)
            out["n_words"].append(len(words) + sum(s["stop"] - s["start"] for s in spans))
            out["removed"].append(spans)
            out["kept"].append(b" ".join(words))
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "removed": pa.array(out["removed"], pa.list_(span)), "kept": pa.array(out["kept"], pa.binary())})

    return locate


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, cell_bytes: int | None = None) -> DataFrame:
    """(doc_id, n_words, removed, kept): spans of removed words, and the kept words joined by spaces, as bytes."""
    cells = dealt(docs, cell_bytes) if cell_bytes else dealt(docs)
    seen = cells.groupBy("cell").applyInArrow(first_pass(window, phrase), "h long, cell int, many boolean")
    by_anchor = W.partitionBy("h")
    again = seen.select("h", "cell", ((F.count(F.lit(1)).over(by_anchor) > 1) | F.max("many").over(by_anchor)).alias("recurs")).where("recurs").select("cell", "h")
    found = cells.groupBy("cell").cogroup(again.groupBy("cell")).applyInArrow(second_pass(window, phrase), "w1 long, w2 short, cell int, lo long, many boolean")
    first = F.min("lo").over(W.partitionBy("w1", "w2"))
    confirmed = found.withColumn("first", first).where("first < lo or many").select("cell", "w1", "w2", "first")
    return cells.groupBy("cell").cogroup(confirmed.groupBy("cell")).applyInArrow(third_pass(window), "doc_id long, n_words long, removed array<struct<start:int,stop:int>>, kept binary")
