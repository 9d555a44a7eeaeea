"""Conversation structure repair: the cheapest edits that turn each conversation's roles into (s?(ua)+)?.

A forward Viterbi pass over four grammar states (nothing yet, after the system turn, after a user turn, after an assistant
turn) carries the least (cost, audit) for each state; each turn is kept, given another role or deleted, and its layer is
closed by insertions, two at most, since a third would come back to a state already reached for less. Audits that have used the same turns at
the same cost are never the beginning of one another (what is longer has more insertions and costs more), so the least of two
stays the least whatever follows; hence passes can be cut. A conversation's turns lie in pieces of PIECE turns or fewer, of which
each gets a table from state to state, and tables are joined in a tree, FAN at a time: no task holds a conversation's
turns, whatever its length, and what it ends as is the length of its own audit. The winning audit goes back to the pieces,
where each turn's edit is found and joined to its text by its number.

Edits: K keep (0), R give the role user or assistant (2), D delete (3; blank and repeated turns must be), I insert an empty user or assistant
turn (2); a truncated turn that is not deleted adds 1. Equal costs take the audit that is least as text.

Defined cases: turns are ordered by (turn, role, text), nulls first; a null role or text counts as one space; null ids are one conversation; a
repeated row is a repeated turn; a role is known by its first letter, and any other than s, u, a cannot be kept; a conversation
without turns has no row here; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.tables import numbered
from .common import BLANKS, written

#: Turns of a piece, pieces joined at once.
PIECE, FAN = 256, 64
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1
#: Where a role leads from each state; the states' names are the role before ("" at the start).
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
STATES = tuple(NEXT)
FINAL = ("", "a")
#: How a turn is written for the pass: its role's letter and its first fault, in one character each.
FINE, BLANK, DUPLICATE, CUT = "-", "b", "d", "t"
NAMES = {"s": "system", "u": "user", "a": "assistant"}

Layer = dict[str, tuple[int, str]]


def least(layer: Layer, state: str, cost: int, audit: str) -> None:
    if state not in layer or (cost, audit) < layer[state]:
        layer[state] = (cost, audit)


def closed(layer: Layer) -> Layer:
    """The layer with what insertions reach from it."""
    for _ in range(2):
        for state, (cost, audit) in list(layer.items()):
            for role in NEXT[state]:
                if role in "ua":
                    least(layer, role, cost + COST["I"], audit + "I")
    return layer


def step(layer: Layer, role: str, fault: str) -> Layer:
    out: Layer = {}
    extra = TRUNCATED if fault == CUT else 0
    for state, (cost, audit) in layer.items():
        least(out, state, cost + COST["D"], audit + "D")
        if fault not in (BLANK, DUPLICATE):
            for to in NEXT[state]:
                if to == role:
                    least(out, to, cost + COST["K"] + extra, audit + "K")
                elif to in "ua":
                    least(out, to, cost + COST["R"] + extra, audit + "R")
    return closed(out)


@lru_cache(maxsize=4096)
def table_of(turns: str) -> tuple[tuple[str, str, int, str], ...]:
    """(from, to, cost, audit) over the turns of a piece, two characters each, without insertions before the first."""
    out = []
    for state in STATES:
        layer: Layer = {state: (0, "")}
        for i in range(0, len(turns), 2):
            layer = step(layer, turns[i], turns[i + 1])
        out += [(state, to, *best) for to, best in layer.items()]
    return tuple(out)


def joined_tables(first: list, second: list) -> list:
    """The table over what two tables cover, one after the other."""
    from_state: dict[str, list] = {}
    for f, t, c, a in second:
        from_state.setdefault(f, []).append((t, c, a))
    layers: dict[str, Layer] = {}
    for f, t, c, a in first:
        for to, cost, audit in from_state.get(t, ()):
            least(layers.setdefault(f, {}), to, c + cost, a + audit)
    return [(f, to, *best) for f, layer in layers.items() for to, best in layer.items()]


def outcome(table: list) -> tuple[int, str]:
    """Cost and audit of the cheapest way from the start to a final state, insertions before the first turn included."""
    start = closed({"": (0, "")})
    out: Layer = {}
    for f, t, c, a in table:
        if f in start and t in FINAL:
            least(out, "end", start[f][0] + c, start[f][1] + a)
    return out["end"]


def edits_of(state: str, turns: str, audit: str) -> tuple[list[tuple[int | None, str, str | None]], str]:
    """(turn's place or None, edit, new role or None) for each edit of a piece that begins in a state, and the state after it."""
    out, at = [], 0
    for edit in audit:
        if edit == "D":
            out.append((at, edit, None))
            at += 1
            continue
        if edit == "K":
            state = turns[2 * at]
            out.append((at, edit, None))
            at += 1
            continue
        state = NEXT[state][-1]  # user, or assistant after a user
        out.append((at if edit == "R" else None, edit, NAMES[state]))
        at += edit == "R"
    return out, state


# --- rows ----------------------------------------------------------------------------------------------------------------


def is_blank(text: Column) -> Column:
    return F.length(F.btrim(text, F.lit(BLANKS))) == 0


def placed_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, g): turns numbered in order over all conversations, so that long ones are spread."""
    r = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return numbered(r, ["conv_id", "turn", "role", "text"], "g")


def marked_turns(placed: DataFrame) -> DataFrame:
    """(conv_id, turn, g, mark): each turn's letter and first fault; which of equal turns is the first is joined back by number."""
    text = F.col("text")
    last = F.substring(F.btrim(text, F.lit(BLANKS)), -1, 1)
    fault = F.when(is_blank(text), BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(FINE)
    letter = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    r = placed.select("conv_id", "turn", "g", letter.alias("letter"), fault.alias("fault"), *[F.xxhash64(F.lit(i), "role", "text").alias(f"h{i}") for i in (1, 2)])
    first = r.groupBy("conv_id", "h1", "h2").agg(F.min("g").alias("g")).select("g", F.lit(True).alias("_first"))
    r = r.join(first, "g", "left")
    fault = F.when(F.col("_first").isNull() & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault"))
    return r.select("conv_id", "turn", "g", F.concat("letter", fault).alias("mark"))


def none_key(c: str) -> list[Column]:
    """A conversation's id as keys that can be joined on, null or not."""
    return [F.col(c).isNull().alias("_none"), F.coalesce(c, F.lit(0)).alias("_conv")]


def pieces_of(marked: DataFrame, piece: int = PIECE) -> DataFrame:
    """(_none, _conv, piece, first, marks): a conversation's turns in pieces; first is the number of a piece's first turn."""
    r = marked.select(*none_key("conv_id"), F.floor(F.col("g") / piece).alias("piece"), "g", "mark")
    ordered = F.array_sort(F.collect_list(F.struct("g", "mark")))
    return r.groupBy("_none", "_conv", "piece").agg(F.min("g").alias("first"), F.array_join(ordered["mark"], "").alias("marks"))


KEYS = ["_none", "_conv"]
TABLE = "f array<string>, t array<string>, c array<long>, a array<string>"


def tables(marks: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([[list(x) for x in zip(*table_of(m), strict=True)] for m in marks], columns=list("ftca"))


def joined(parts: pd.Series) -> pd.DataFrame:
    """One table over an ordered array of tables."""
    out = []
    for row in parts:
        whole = None
        for p in row:
            one = list(zip(p["f"], p["t"], p["c"], p["a"], strict=True))
            whole = one if whole is None else joined_tables(whole, one)
        out.append([list(x) for x in zip(*whole, strict=True)])
    return pd.DataFrame(out, columns=list("ftca"))


def outcomes(table: pd.DataFrame) -> pd.DataFrame:
    rows = zip(table["f"], table["t"], table["c"], table["a"], strict=True)
    return pd.DataFrame([outcome(list(zip(*r, strict=True))) for r in rows], columns=["cost", "audit"])


def cheapest(pieces: DataFrame, fan: int = FAN) -> DataFrame:
    """(_none, _conv, cost, audit): the pieces' tables joined in order, a level of the tree at a time, until each conversation has one."""
    first = pieces.groupBy(*KEYS).agg(F.min("piece").alias("_from"))
    level = pieces.join(first, KEYS).select(*KEYS, (F.col("piece") - F.col("_from")).alias("i"), F.pandas_udf(tables, TABLE)("marks").alias("x"))
    level = written(level, "pieces")
    most = level.agg(F.max("i")).first()[0] or 0
    while most > 0:
        of = level.groupBy(*KEYS, F.floor(F.col("i") / fan).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("xs"))
        level = written(of.select(*KEYS, "i", F.pandas_udf(joined, TABLE)("xs").alias("x")), "joined")
        most //= fan
    return level.select(*KEYS, F.pandas_udf(outcomes, "cost long, audit string")("x").alias("o")).select(*KEYS, "o.cost", "o.audit")


def state_after(outputs: int, system: bool) -> str:
    """The state once a number of turns stand in the repaired conversation, which has a system turn or not."""
    if outputs == 0:
        return ""
    if system and outputs == 1:
        return "s"
    return "ua"[(outputs - 1 - system) % 2]


def split_audit(audit: str, sizes: list[int]) -> list[tuple[str, str]]:
    """(state before, edits) of each piece; insertions go with the turn before them, the first ones with the first piece.

    A repaired conversation has an odd number of turns just if it has a system turn.
    """
    system = (len(audit) - audit.count("D")) % 2 == 1
    out, at, outputs = [], 0, 0
    for left in sizes:
        begin, state = at, state_after(outputs, system)
        while at < len(audit) and (left or audit[at] == "I"):
            left -= audit[at] != "I"
            outputs += audit[at] != "D"
            at += 1
        out.append((state, audit[begin:at]))
    return out


def split_audits(audit: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([[(int(z["piece"]), *x) for z, x in zip(of, split_audit(a, [z["n"] for z in of]), strict=True)] for a, of in zip(audit, sizes, strict=True)])


def piece_edits(state: pd.Series, marks: pd.Series, edits: pd.Series) -> pd.Series:
    return pd.Series([edits_of(*x)[0] for x in zip(state, marks, edits, strict=True)])


def edited(placed: DataFrame, pieces: DataFrame, best: DataFrame, piece: int = PIECE) -> DataFrame:
    """(_none, _conv, piece, pos, edit, role, text): every edit in order, with the turn's new role and its text; deleted turns keep theirs."""
    sizes = pieces.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("piece", (F.length("marks") / 2).cast("int").alias("n")))).alias("sizes"))
    mine = best.join(sizes, KEYS).select(*KEYS, F.inline(F.pandas_udf(split_audits, "array<struct<piece:long,state:string,edits:string>>")("audit", "sizes")))
    found = pieces.join(mine, [*KEYS, "piece"]).select(*KEYS, "piece", "first", F.posexplode(F.pandas_udf(piece_edits, "array<struct<at:int,edit:string,role:string>>")("state", "marks", "edits")).alias("pos", "e"))
    # an insertion has no turn; numbers of its own keep it from meeting the others
    g = F.coalesce(F.col("first") + F.col("e.at"), -1 - (F.col("piece") * (4 * piece) + F.col("pos")))
    found = found.select(*KEYS, "piece", "pos", g.alias("g"), "e.edit", F.col("e.role").alias("_role"))
    turns = placed.select("g", F.col("role").alias("_was"), F.col("text").alias("_text"))
    return found.join(turns, "g", "left").select(*KEYS, "piece", "pos", "edit", F.coalesce("_role", "_was").alias("role"), F.coalesce("_text", F.lit("")).alias("text"))


def illegal_pairs(pieces: DataFrame) -> DataFrame:
    """(_none, _conv, illegal): adjacent turns whose roles' letters are none of su, ua, au."""
    before = F.lag(F.substring("marks", -2, 1)).over(W.partitionBy(*KEYS).orderBy("piece"))  # a row for each piece
    letters = pieces.select(*KEYS, F.concat(F.coalesce(before, F.lit("")), F.regexp_replace("marks", "(.).", "$1")).alias("l"))
    pair = F.transform(F.sequence(F.lit(1), F.greatest(F.length("l") - 1, F.lit(1))), lambda i: F.substring(F.col("l"), i, F.lit(2)))
    wrong = F.size(F.filter(pair, lambda x: (F.length(x) == 2) & ~x.isin("su", "ua", "au")))
    return letters.groupBy(*KEYS).agg(F.sum(wrong).cast("long").alias("illegal"))


@dataclass
class Repair:
    """The turns as edited, and for each conversation with turns (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)."""

    turns: DataFrame
    conversations: DataFrame


def repair(rows: DataFrame, piece: int = PIECE, fan: int = FAN) -> Repair:
    placed = placed_turns(rows)
    marked = written(marked_turns(placed), "marks")
    pieces = written(pieces_of(marked, piece), "turns")
    best = written(cheapest(pieces, fan), "cheapest")
    fault = F.substring("mark", 2, 1)
    names = {"blank": BLANK, "duplicate": DUPLICATE, "truncated": CUT}
    counts = marked.groupBy(*none_key("conv_id")).agg(*[F.count_if(fault == f).alias(c) for c, f in names.items()])
    each = marked.where(F.col("turn").isNotNull()).groupBy(*none_key("conv_id"), "turn").agg(F.lit(1).alias("_1"))
    gaps = each.groupBy(*KEYS).agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    found = best.join(counts, KEYS).join(illegal_pairs(pieces), KEYS).join(gaps, KEYS, "left")
    conv = F.when(~F.col("_none"), F.col("_conv")).alias("conv_id")
    found = found.select(conv, F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), *names, "illegal", "cost", "audit")
    turns = edited(placed, pieces, best, piece).select(conv, "piece", "pos", "edit", "role", "text")
    return Repair(turns, found)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the turns that are not deleted, as role:text, joined by newlines.

    A digest takes its text in order, so that a conversation is read by one task, turn by turn; none of it is held.
    """
    ordered = turns.where("edit <> 'D'").select("conv_id", "piece", "pos", F.concat_ws(":", "role", "text").alias("line"))
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "pos").select("conv_id", F.col("line").cast("binary").alias("line"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
        for b in batches:
            done = []
            for conv, line in zip(b.column("conv_id").to_pylist(), b.column("line").to_pylist(), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256(line)
                else:
                    digest.update(b"\n")
                    digest.update(line)
            yield pa.RecordBatch.from_pydict({"conv_id": [x for x, _ in done], "repaired_sha256": [x for _, x in done]}, schema=schema)
        if digest is not None:
            yield pa.RecordBatch.from_pydict({"conv_id": [now], "repaired_sha256": [digest.hexdigest()]}, schema=schema)

    return ordered.mapInArrow(part, "conv_id long, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The turns with faults planted by the checksum of conv_id:turn: some dropped, emptied, cut, repeated or given to the user; nulls as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    r = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("_d")).where("_d <> 0")
    body = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("_d") == 3, 2).otherwise(1).cast("int"))
    return r.select("conv_id", "turn", role.alias("role"), body.alias("text"), F.explode(copies).alias("_c")).drop("_c")
