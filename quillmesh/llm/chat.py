"""Chat formatting: a hidden Markov model recovers who speaks in the lines of a transcript, then turns are rendered.

States are (role, place): the first line of a role's turn or a later one. A line is observed as the kind of its speaker
marker together with coarse features (length, question mark, first letter, blank). Initial, transition and observation probabilities are
smoothed counts over labelled transcripts, made with one aggregation (a few hundred rows, however many transcripts), as whole
numbers of 2^-20 nats, so that sums are exact. Viterbi finds the best states of each transcript; markers are stripped, and
turns are rendered in one canonical form.

A long conversation lies in parts of up to PART turns, so that it never meets in one row, and is still decoded as a whole: each part
gives the best score from each state before it to each state at its end; these, 36 numbers for each part, are joined in order
into the scores before each part; each part then says which state before it belongs to each state at its end; and these are
followed back from the last part. Each part is decoded between the scores before it and the state at its end, which yields the
path of the whole transcript, ties included. A turn that goes on in the next part is rendered there as its continuation.

Defined cases: a null text is an empty line; rows with a null conv_id are one conversation, those with a null turn come
first; unknown or null roles count as user in training; rows alike are separate turns; an empty table gives an empty one;
other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import numbered
from .common import checked_broadcast, cut


ROLES = ("system", "user", "assistant")
PART = 512
#: Parts of a logarithm's unit.
UNIT = 1 << 20
NONE = -(1 << 60)
#: Speaker markers by role, as patterns of the name before a colon, bracket or dash.
MARKERS = {"system": r"system|instructions?|context", "user": r"user|human|customer|question|q|me|prompt", "assistant": r"assistant|ai|bot|answer|a|agent|model|response"}
MARKER = re.compile(r"^\s*(?:[#>*\-\[(<|]+\s*)?(?:" + "|".join(f"(?P<{k}>{v})" for k, v in MARKERS.items()) + r"|(?P<other>[A-Z][\w .]{0,30}))(?:\s*[\])>|*]+)?\s*:\s?(?:\*\*)?", re.I)
#: Markers that transcripts are written with, by style; an empty one leaves the speaker to be inferred.
STYLES = (("System: ", "User: ", "Assistant: "), ("[system]: ", "Human: ", "AI: "), ("### Instructions: ", "Q: ", "A: "), ("Context: ", "**User**: ", "**Assistant**: "))
SMOOTHING = 0.1
FEATURES = 5 * 3 * 2 * 3
STATES = 2 * len(ROLES)


def observed(line: str) -> tuple[int, int]:
    """The number of a line's features, and how many characters its marker has."""
    m = MARKER.match(line)
    kind = 0 if not m else next((i + 1 for i, r in enumerate(ROLES) if m.group(r)), 4)
    rest = line[m.end() :] if m else line
    length = 0 if not rest.strip() else 1 if len(rest) < 200 else 2
    first = rest.lstrip()[:1]
    letter = 0 if not first.isalpha() else 1 if first.isupper() else 2
    return ((kind * 3 + length) * 2 + rest.rstrip().endswith("?")) * 3 + letter, m.end() if m and kind < 4 else 0


@dataclass
class Model:
    """Logarithms of initial, transition and observation probabilities, in whole units."""

    start: np.ndarray
    step: np.ndarray
    see: np.ndarray

    def forward(self, seen: list[int], before: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Best scores at the last line, and the best state before each line but a transcript's first. before: the scores before the first line."""
        back = []
        best = None if before is None else np.asarray(before)
        for x in seen:
            if best is None:
                best = self.start + self.see[:, x]
                continue
            through = best[:, None] + self.step
            back.append(through.argmax(0))
            best = through.max(0) + self.see[:, x]
        return best, back

    def path(self, seen: list[int], before: np.ndarray | None = None, last: int | None = None) -> list[int]:
        """Viterbi: the likeliest states; ties go to the first state. last: the state at the last line, if that is settled."""
        if not seen:
            return []
        best, back = self.forward(seen, before)
        out = [int(best.argmax()) if last is None else last]
        for b in reversed(back[len(back) - len(seen) + 1 :]):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def across(self, seen: list[int]) -> np.ndarray:
        """Best scores from each state before the first line (rows) to each state at the last line."""
        total = None
        for x in seen:
            now = self.step + self.see[:, x][None, :]
            total = now if total is None else (total[:, :, None] + now[None]).max(1)
        return total

    def entries(self, seen: list[int], before: np.ndarray) -> list[int]:
        """For each state at the last line, the state before the first."""
        at = list(range(STATES))
        for b in reversed(self.forward(seen, before)[1]):
            at = [int(b[x]) for x in at]
        return at


def transcripts(turns: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, conv, part, n_turns, lines, truth) of a table of turns: raw lines, and the state that each line is in.

    The style of a conversation's markers hangs on its id, and one turn in five has none. Turns are numbered over the whole table,
    and part goes by that number, so that no conversation is sorted or cut up in one task; the first part of one may be short.
    """
    role = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.lower("role")), F.lit(0)).cast("int")
    role = F.when(role == 0, 2).otherwise(role) - 1
    t = turns.select("conv_id", F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    t = numbered(t, ["conv_id", "turn", "role", "text"], "n")
    style = F.element_at(F.array(*[F.array(*[F.lit(x) for x in s]) for s in STYLES]), (F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))) + 1).cast("int"))
    bare = F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(5)) == 0
    marked = F.concat(F.when(bare, "").otherwise(F.element_at(style, role + 1)), F.col("text"))
    turn = F.struct("n", role.alias("state"), marked.alias("raw"))
    conv = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    grouped = t.select(conv.alias("conv"), F.floor((F.col("n") - 1) / part).cast("long").alias("part"), "conv_id", turn.alias("t"))
    grouped = grouped.groupBy("conv", "part").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list("t")).alias("turns"))
    lines = F.flatten(F.transform("turns", lambda x: F.split(x["raw"], "\n")))
    truth = F.flatten(F.transform("turns", lambda x: F.transform(F.split(x["raw"], "\n"), lambda _, i: x["state"] * 2 + (i > 0).cast("int"))))
    return grouped.select("conv_id", "conv", "part", F.size("turns").alias("n_turns"), lines.alias("lines"), truth.alias("truth"))


def observe(raw: DataFrame) -> DataFrame:
    """raw with seen and cuts: for each line, the number of its features and the length of its marker. Kept as a checkpoint."""

    def look(lines: pa.Array) -> pa.Array:
        found = [[observed(x) for x in v or []] for v in lines.to_pylist()]
        kind = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array([[x[k] for x in v] for v in found], kind) for k in (0, 1)], ["seen", "cuts"])

    kept = [c for c in raw.columns if c not in ("seen", "cuts")]
    return cut(raw.select(*kept, F.arrow_udf(look, "seen array<int>, cuts array<int>")("lines").alias("_o")).select(*kept, "_o.seen", "_o.cuts"))


def fit(labelled: DataFrame) -> Model:
    """From a table with seen and truth. A conversation's later parts tell no initial state."""
    heads = labelled.groupBy("conv").agg(F.min("part").alias("_first"))
    x = labelled.where(F.size("seen") > 0).select("conv", "part", "truth", "seen").join(heads, "conv").withColumn("_head", F.col("part") == F.col("_first"))
    triples = F.transform("truth", lambda s, i: F.struct(F.when(i > 0, F.get("truth", i - 1)).when(F.col("_head"), -1).otherwise(-2).alias("before"), s.alias("state"), F.get("seen", i).alias("seen")))
    counts = x.select(F.explode(triples).alias("c")).groupBy("c.before", "c.state", "c.seen").count().collect()  # at most 8 * 6 * FEATURES rows
    start, step, see = np.full(STATES, SMOOTHING), np.full((STATES, STATES), SMOOTHING), np.full((STATES, FEATURES), SMOOTHING)
    for before, state, seen, n in counts:
        see[state, seen] += n
        if before == -1:
            start[state] += n
        elif before >= 0:
            step[before, state] += n
    whole = lambda p: np.rint(np.log(p) * UNIT).astype(np.int64)
    return Model(whole(start / start.sum()), whole(step / step.sum(1, keepdims=True)), whole(see / see.sum(1, keepdims=True)))


def rendered(lines: list[str], states: list[int], cuts: list[int]) -> tuple[str, list[tuple[str, str]]]:
    """The canonical chat, and its turns as (role, text)."""
    turns: list[tuple[str, list[str]]] = []
    for line, s, cut in zip(lines, states, cuts, strict=True):
        role = ROLES[s // 2]
        if s % 2 == 0 or not turns or turns[-1][0] != role:
            turns.append((role, [line[cut:]]))
        else:
            turns[-1][1].append(line)
    done = [(r, "\n".join(t).strip()) for r, t in turns]
    return "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in done), done


PARSED = "chat string, states array<int>, turns array<struct<role:string,text:string>>"
JOINT = "conv string, part long, before array<long>, last int"


def joined_parts(seen: DataFrame, model: Model) -> DataFrame:
    """(conv, part, before, last) of conversations in several parts: the scores before each part, and the state at its end.

    What meets for a conversation is 36 numbers for each of its parts, then 6.
    """
    shared = seen.sparkSession.sparkContext.broadcast(model)
    several = seen.groupBy("conv").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("conv")
    parts = seen.select("conv", "part", "seen").join(several, "conv", "left_semi")
    longs = pa.list_(pa.int64())

    def across(column: pa.Array) -> pa.Array:
        return pa.array([shared.value.across(v).ravel().tolist() if v else None for v in column.to_pylist()], longs)

    def ordered(t: pa.Table) -> pa.Table:
        return t.sort_by("part")

    def befores(t: pa.Table) -> pa.Table:
        """The head of a conversation has no scores before it, and its own come from the initial probabilities."""
        t, out, best = ordered(t), [], None
        for head, m in zip(t.column("head").to_pylist(), t.column("m").to_pylist(), strict=True):
            out.append(None if best is None else best.tolist())
            if best is None:
                best = np.array(head, np.int64)
            else:
                best = (best[:, None] + np.array(m, np.int64).reshape(STATES, STATES)).max(0)
        return pa.table({"conv": t.column("conv"), "part": t.column("part"), "before": pa.array(out, longs), "end": pa.array([None] * (len(out) - 1) + [best.tolist()], longs)})

    def heads(column: pa.Array) -> pa.Array:
        return pa.array([shared.value.forward(v, None)[0].tolist() if v else None for v in column.to_pylist()], longs)

    moves = parts.select("conv", "part", F.arrow_udf(across, "array<long>")("seen").alias("m"), F.arrow_udf(heads, "array<long>")("seen").alias("head"))
    scored = cut(moves.groupBy("conv").applyInArrow(befores, "conv string, part long, before array<long>, end array<long>"))

    def entries(column: pa.Array, before: pa.Array) -> pa.Array:
        return pa.array([shared.value.entries(v, np.array(b, np.int64)) if b else None for v, b in zip(column.to_pylist(), before.to_pylist(), strict=True)], pa.list_(pa.int32()))

    def lasts(t: pa.Table) -> pa.Table:
        t, out = ordered(t), []
        state = int(np.argmax(t.column("end")[-1].as_py()))
        for into in reversed(t.column("into").to_pylist()):
            out.append(state)
            state = into[state] if into else -1
        return pa.table({"conv": t.column("conv"), "part": t.column("part"), "before": t.column("before"), "last": pa.array(out[::-1], pa.int32())})

    told = parts.join(scored, ["conv", "part"]).select("conv", "part", "before", "end", F.arrow_udf(entries, "array<int>")("seen", "before").alias("into"))
    return told.groupBy("conv").applyInArrow(lasts, JOINT)


def parse(raw: DataFrame, model: Model) -> DataFrame:
    """raw (as observe() returns it) with chat, states and turns of its lines."""
    shared = raw.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array, seen: pa.Array, cuts: pa.Array, before: pa.Array, last: pa.Array) -> pa.Array:
        chats, states, turns = [], [], []
        for lines, x, c, b, z in zip(column.to_pylist(), seen.to_pylist(), cuts.to_pylist(), before.to_pylist(), last.to_pylist(), strict=True):
            path = shared.value.path(x, None if b is None else np.array(b, np.int64), z)
            chat, done = rendered(lines or [], path, c)
            chats.append(chat)
            states.append(path)
            turns.append([{"role": r, "text": t} for r, t in done])
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        return pa.StructArray.from_arrays([pa.array(chats, pa.string()), pa.array(states, pa.list_(pa.int32())), pa.array(turns, kind)], ["chat", "states", "turns"])

    known = checked_broadcast(joined_parts(raw, model))
    all_ = raw.join(known, ["conv", "part"], "left")
    return all_.select(*[F.col(c) for c in raw.columns], F.arrow_udf(run, PARSED)("lines", "seen", "cuts", "before", "last").alias("p")).select(*raw.columns, "p.chat", "p.states", "p.turns")


def agreement(parsed: DataFrame) -> Column:
    """How many lines have their true role."""
    return F.size(F.filter(F.zip_with("states", "truth", lambda a, b: F.floor(a / 2) == F.floor(b / 2)), lambda x: x))
