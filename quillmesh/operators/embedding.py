"""Node embeddings: uniform and biased walks with skip-gram, spectral, concatenation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, written
from .tables import numbered


class EmbeddingStrategy(Protocol):
    """Fits (node_id, vec) to an edge table (source, target)."""

    directed: bool

    def fit(self, edges: DataFrame) -> DataFrame: ...


def adjacency(edges: DataFrame, directed: bool = True) -> DataFrame:
    """(node, nbrs): distinct neighbours in order."""
    e = edges.select("source", "target").distinct()
    if not directed:
        e = e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    return e.groupBy(F.col("source").alias("node")).agg(F.array_sort(F.collect_list("target")).alias("nbrs"))


def starts(edges: DataFrame, num_walks: int) -> DataFrame:
    """(start, walk) of every node, num_walks times."""
    nodes = edges.select(F.explode(F.array("source", "target")).alias("start")).distinct()
    return nodes.select("start", F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))).alias("walk"))


def uniform(seed: int, *keys: Column) -> Column:
    """In [0, 1), from a seeded hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All values of a list array, the row of each, and where each row ends."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_flatten(lists), np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)


def biased_pick(p: float, q: float):
    """The neighbour at share u of the weights' mass, by lists of neighbours; what the picks by place are held to."""

    def pick(nbrs: pa.Array, back: pa.Array, back_nbrs: pa.Array, u: pa.Array) -> pa.Array:
        near, row, ends = _flat(nbrs)
        known, known_row, _ = _flat(back_nbrs)
        if not len(near):
            return pa.nulls(len(nbrs), pa.string())
        names = pa.concat_arrays([near, known, back])
        code = pc.fill_null(pc.dictionary_encode(names).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        wide = int(code.max()) + 2
        here, there, before = code[: len(near)], code[len(near) : len(near) + len(known)], code[len(near) + len(known) :]
        common = np.isin(row * wide + here, known_row * wide + there)
        weight = np.where(before[row] < 0, 1.0, np.where(here == before[row], 1.0 / p, np.where(common, 1.0, 1.0 / q)))
        mass = np.cumsum(weight)
        begin = np.concatenate([[0], ends[:-1]])
        low = np.where(begin > 0, mass[np.maximum(begin - 1, 0)], 0.0)
        high = mass[np.maximum(ends - 1, 0)]
        at = np.searchsorted(mass, low + u.to_numpy(zero_copy_only=False) * (high - low), "right")
        at = np.minimum(np.maximum(at, begin), ends - 1)
        return near.take(pa.array(at, mask=begin == ends))

    return pick


def lone_pick(p: float, q: float, degree: Column, back: Column, u: Column) -> Column:
    """The place of the neighbour at share u of the weights' mass, where no neighbour is one of the node before: by arithmetic, so that no list is copied. back: the place of the node before, or less than 0."""
    before = back / q
    t = u * (1.0 / p + (degree - 1) / q)
    i = F.when(t < before, F.floor(t * q)).when(t < before + 1.0 / p, back).otherwise(back + 1 + F.floor((t - before - 1.0 / p) * q))
    return F.least(F.when(back >= 0, i).otherwise(F.floor(u * degree)), degree - 1).cast("int")


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(back, node, common): for each edge from back to node, other than loops, the neighbours that both lead to; edges without any are left out.

    Each triangle is found once, from its corner of least degree, so that no hub's neighbours meet in pairs.
    """
    e = edges.select("source", "target").where("source <> target").distinct()
    low, high = F.least("source", "target"), F.greatest("source", "target")
    both = e.groupBy(low.alias("a"), high.alias("b")).agg(F.max(F.col("source") == low).alias("ab"), F.max(F.col("source") == high).alias("ba"))
    degree = both.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    both = both.join(degree.select(F.col("n").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("n").alias("b"), F.col("d").alias("db")), "b")
    first = F.struct("da", "a") < F.struct("db", "b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    up = cut(both.select(pick("a", "b").alias("x"), pick("b", "a").alias("y"), pick("db", "da").alias("dy"), pick("ab", "ba").alias("xy"), pick("ba", "ab").alias("yx")))
    other = up.select("x", F.col("y").alias("z"), F.col("dy").alias("dz"), F.col("xy").alias("xz"), F.col("yx").alias("zx"))
    wedges = up.join(other, "x").where(F.struct("dy", "y") < F.struct("dz", "z"))
    closed = wedges.join(up.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("xy").alias("yz"), F.col("yx").alias("zy")), ["y", "z"])
    found = [F.when(F.col(u + v) & F.col(u + w) & F.col(v + w), F.struct(F.col(u).alias("back"), F.col(v).alias("node"), F.col(w).alias("n"))) for u, v, w in permutations("xyz")]
    each = closed.select(F.explode(F.array(*found)).alias("t")).where("t is not null").select("t.*")
    return each.groupBy("back", "node").agg(F.collect_list("n").alias("common"))


def two_sided(edges: DataFrame) -> bool:
    """Whether no node is both source and target, and neither is missing: then no neighbours of an edge's ends are shared, and no edge is a loop."""
    sides = [edges.select(F.col(c).alias("node")).distinct() for c in ("source", "target")]
    return edges.where("source is null or target is null").isEmpty() and sides[0].join(sides[1], "node", "left_semi").isEmpty()


#: Neighbours of a node that one row holds.
CHUNK = 64


def stepping_stones(edges: DataFrame, directed: bool, specials: bool) -> DataFrame:
    """(h, node, chunk, d, of): the ordered neighbours of a node, CHUNK of them to a row, so that no hub is one row or one task; d is their number.

    Each of them (nbr) comes with all that the step after it needs: deg, the number of its neighbours, and back, the place of node among
    them, if it is. With specials also common, the places of those that node leads to as well, and alike, whether node is nbr.
    """
    adj = adjacency(edges, directed).where("node is not null")
    each = adj.select("node", F.size("nbrs").alias("d"), F.posexplode("nbrs").alias("i", "nbr"))
    a, b = F.least("node", "nbr"), F.greatest("node", "nbr")
    way = lambda c, x, name: F.max(F.when(F.col("node") == c, F.col(x))).alias(name)
    both = each.groupBy(a.alias("a"), b.alias("b")).agg(way(a, "i", "ai"), way(a, "d", "ad"), way(b, "i", "bi"), way(b, "d", "bd"))
    turned = [F.struct(F.col(x).alias("node"), F.col(f"{x}d").alias("d"), F.col(f"{x}i").alias("i"), F.col(y).alias("nbr"), F.col(f"{y}d").alias("deg"), F.col(f"{y}i").alias("back")) for x, y in ("ab", "ba")]
    rows = both.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(turned[0])).otherwise(F.array(*turned)))).where("i is not null")
    if directed:
        degree = adj.select(F.col("node").alias("nbr"), F.size("nbrs").alias("_d"))
        rows = rows.join(degree, "nbr", "left").withColumn("deg", F.coalesce("deg", "_d")).drop("_d")
    if specials:
        rows = written(rows, "places")
        near = common_neighbours(edges if directed else rows.select(F.col("node").alias("source"), F.col("nbr").alias("target")))
        place = rows.select(F.col("node").alias("nbr"), F.col("nbr").alias("_n"), F.col("i").alias("_i"))
        shared = near.select(F.col("back").alias("node"), F.col("node").alias("nbr"), F.explode("common").alias("_n")).join(place, ["nbr", "_n"])
        loops = rows.where("node <> nbr").select("node", "nbr").join(place.where("nbr = _n"), "nbr")  # a loop leads to a neighbour of the node before
        found = shared.select("node", "nbr", "_i").unionByName(loops.select("node", "nbr", "_i")).groupBy("node", "nbr").agg(F.array_sort(F.collect_set("_i")).alias("common"))
        rows = rows.join(found, ["node", "nbr"], "left").withColumns({"common": F.coalesce("common", F.array().cast("array<int>")), "alike": F.col("node") == F.col("nbr")})
    chunk = F.floor(F.col("i") / CHUNK).cast("int")
    keys, n = ["h", "node", "chunk"], int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("chunk", chunk).withColumn("h", F.xxhash64("node", "chunk")).repartition(n, *keys)
    stones = dealt.groupBy(*keys).agg(F.max("d").alias("d"), F.array_sort(F.collect_list(F.struct("i", *[c for c in rows.columns if c not in ("node", "d", "i")]))).alias("of"))
    return stones.sortWithinPartitions(*keys)


def special_pick(p: float, q: float, degree: Column, back: Column, common: Column, alike: Column, u: Column) -> Column:
    """The place of the neighbour at share u of the weights' mass, from the places of those of other weight than the rest: back, if it is one, and common."""
    rest = F.when(alike, 1.0).otherwise(1.0 / q)
    places = F.array_sort(F.array_union(common, F.when(back >= 0, F.array(back)).otherwise(F.array().cast("array<int>"))))
    weight = lambda x: F.when(x == back, 1.0 / p).otherwise(1.0)
    mass = F.aggregate(places, (degree - F.size(places)) * rest, lambda m, x: m + weight(x))
    state = lambda at, left, found: F.struct(at.cast("int").alias("at"), left.cast("double").alias("left"), found.cast("int").alias("found"))

    def past(s: Column, x: Column) -> Column:
        gap = (x - s["at"]) * rest
        here = F.when(s["found"] >= 0, s["found"]).when(s["left"] < gap, s["at"] + F.floor(s["left"] / rest)).when(s["left"] < gap + weight(x), x).otherwise(-1)
        return state(x + 1, s["left"] - gap - weight(x), here)

    end = F.aggregate(places, state(F.lit(0), u * mass, F.lit(-1)), past, lambda s: F.when(s["found"] >= 0, s["found"]).otherwise(s["at"] + F.floor(s["left"] / rest)))
    return F.least(end, degree - 1).cast("int")


def biased_walks(edges: DataFrame, num_walks: int, walk_length: int, seed: int, directed: bool, p: float, q: float) -> DataFrame:
    """(start, walk, path) of biased steps. A walk meets the few neighbours its next one is among, and moves on with that one's place."""
    edges = written(edges.select("source", "target").distinct(), "edges")
    plain = two_sided(edges)
    stones = stepping_stones(edges, directed, not plain).persist(StorageLevel.MEMORY_AND_DISK)  # dealt and sorted once: only walks move
    start, cur = F.get("path", F.lit(0)), F.element_at("path", -1)

    def moved(j: DataFrame, step: int) -> DataFrame:
        """Rows of a walk (path) and the neighbours (of) among which number i is its next: with the place of the one after that."""
        to = F.get("of", F.col("i") % CHUNK)
        ends = (F.size("path") < step) | to.isNull()
        j = j.select("walk", F.when(ends, F.col("path")).otherwise(F.concat("path", F.array(to["nbr"]))).alias("path"), F.when(~ends, to).alias("to"))
        u, t = uniform(seed, start, F.col("walk"), F.lit(step + 1)), F.col("to")
        back = F.coalesce(t["back"], F.lit(-1))
        i = lone_pick(p, q, t["deg"], back, u) if plain else special_pick(p, q, t["deg"], back, t["common"], t["alike"], u)
        return j.select("walk", "path", F.when(t["deg"] > 0, i).alias("i"))

    first = stones.select("node", "chunk", "d", "of", F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))).alias("walk"))
    first = first.withColumn("i", F.floor(uniform(seed, F.col("node"), F.col("walk"), F.lit(1)) * F.col("d")).cast("int")).where(F.floor(F.col("i") / CHUNK) == F.col("chunk"))
    w = moved(first.select("walk", F.array("node").alias("path"), "of", "i"), 1)
    for step in range(2, walk_length):
        w = w.withColumns({"_n": cur, "_c": F.floor(F.col("i") / CHUNK).cast("int")}).withColumn("_h", F.xxhash64("_n", "_c"))
        w = moved(w.join(stones, (w["_h"] == stones["h"]) & (w["_n"] == stones["node"]) & (w["_c"] == stones["chunk"]), "left"), step)
    still = starts(edges, num_walks).join(stones.where("chunk = 0").select(F.col("node").alias("start")), "start", "left_anti")  # no edge leads on
    return w.select("walk", "path").unionByName(still.select("walk", F.array("start").alias("path"))).select(start.alias("start"), "walk", "path")


def walks(edges: DataFrame, num_walks: int = 25, walk_length: int = 10, seed: int = 42, directed: bool = True, p: float = 1.0, q: float = 1.0, pick: str = "hash") -> DataFrame:
    """(start, walk, path): each step one join of all walks with the adjacency; a walk ends where no edge leads on.

    With p = q = 1 the next node is uniform: by a seeded hash of (start, walk, step), or, with pick="arithmetic", the neighbour
    number (31 * walk + 17 * step + seed) mod degree. Else a neighbour weighs 1/p if it is the node before, 1 if it is a neighbour of
    that, and 1/q otherwise; the neighbours that an edge's two ends share are found once for all walks. Only a walk's number and path
    travel: where it began, is and was before are told by the path, and that it has ended by the path's length. Where edges lead both
    ways, every node has its neighbours, and the first step is made beside them, before any walk moves.
    """
    if (p != 1.0 or q != 1.0) and num_walks > 0 and walk_length > 1:
        return biased_walks(edges, num_walks, walk_length, seed, directed, p, q)
    adj = adjacency(edges, directed).repartition("node").persist(StorageLevel.MEMORY_AND_DISK)  # dealt once: only walks move
    each = F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))).alias("walk")
    first = not directed and num_walks > 0 and walk_length > 1
    w = starts(edges, num_walks).select("walk", F.array("start").alias("path")) if not first else None
    start = F.get("path", F.lit(0))
    for step in range(1, walk_length):
        j = adj.select(F.when(F.col("node").isNotNull(), F.col("nbrs")).alias("nbrs"), F.array("node").alias("path"), each) if first and step == 1 else w.join(adj, F.element_at(w["path"], -1) == adj["node"], "left")
        deg = F.size("nbrs")
        if pick == "arithmetic":
            i = F.pmod(F.col("walk") * 31 + F.lit(17 * step + seed), deg).cast("int")
        else:
            i = F.floor(uniform(seed, start, F.col("walk"), F.lit(step)) * deg).cast("int")
        ends = (F.size("path") < step) | F.col("nbrs").isNull()
        w = j.select("walk", F.when(ends, F.col("path")).otherwise(F.concat("path", F.array(F.get("nbrs", i)))).alias("path"))
    return w.select(start.alias("start"), "walk", "path")


#: Words of walks that one partition of skip-gram learns, where there are cores for more; words at most that Spark's skip-gram gets, whose vocabulary lies on the driver.
WORDS, VOCABULARY = 2_000_000, 200_000
#: Words that are learnt at once; words drawn as contexts that were not seen, for all of these, and the weight of them all; how far a vector moves at once.
AT_ONCE, DRAWN, WEIGHT, FARTHEST = 500, 128, 5.0, 0.5


def first_vectors(words: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Where a word's vector begins: the same numbers, within half of 1 / dimensions, in every task (SplitMix64 of its number)."""
    z = (words.astype(np.uint64)[:, None] * np.uint64(dimensions) + np.arange(dimensions, dtype=np.uint64)[None, :] + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((z ^ (z >> np.uint64(31))) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24) - np.float32(0.5)) / np.float32(dimensions)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -15.0, 15.0)))


def add_rows(x: np.ndarray, at: np.ndarray, y: np.ndarray) -> None:
    """Adds each row of y to its row of x, which may be named several times and moves by FARTHEST at most."""
    order = np.argsort(at, kind="stable")
    rows, begin = np.unique(at[order], return_index=True)
    y = np.add.reduceat(y[order], begin, axis=0)
    far = np.sqrt(np.einsum("ij,ij->i", y, y))
    x[rows] += y * np.minimum(1.0, FARTHEST / np.maximum(far, FARTHEST))[:, None]


def skip_gram(words: np.ndarray, walk: np.ndarray, n_words: int, vec: np.ndarray, window: int, iterations: int, rng: np.random.Generator) -> np.ndarray:
    """Skip-gram with negative sampling over a task's walks: words by number, the walk of each. vec is learnt in place.

    A word's contexts are those of its walk up to a drawn distance. Pairs at one distance are rows of two slices, and all words learnt at
    once share the drawn words, so that nothing is gathered or scattered for each pair. The rate falls from 0.025 as Spark's does.
    """
    out = np.zeros_like(vec)
    share = np.cumsum(np.bincount(words, minlength=n_words) ** 0.75)
    total, done = max(1, len(words) * iterations), 0
    for _ in range(iterations):
        for i in range(0, len(words), AT_ONCE):
            w, own = words[i : i + AT_ONCE], walk[i : i + AT_ONCE]
            rate = np.float32(0.025 * max(1e-4, 1.0 - done / total))
            done += len(w)
            v, u = vec[w], out[w]
            dv, du, pairs = np.zeros_like(v), np.zeros_like(u), np.zeros(len(w), np.float32)
            radius = rng.integers(1, window + 1, len(w))
            for d in range(1, min(window, len(w) - 1) + 1):
                same = own[d:] == own[:-d]
                for a, b in ((slice(None, -d), slice(d, None)), (slice(d, None), slice(None, -d))):
                    seen = same & (radius[a] >= d)
                    g = np.where(seen, rate * (1.0 - sigmoid(np.einsum("ij,ij->i", v[a], u[b]))), 0.0).astype(np.float32)[:, None]
                    dv[a] += g * u[b]
                    du[b] += g * v[a]
                    pairs[a] += seen
            drawn = np.minimum(np.searchsorted(share, rng.random(DRAWN) * share[-1], "right"), n_words - 1)
            not_seen = out[drawn]
            g = sigmoid(v @ not_seen.T) * (pairs * (-rate * np.float32(WEIGHT / DRAWN)))[:, None]
            dv += g @ not_seen
            add_rows(vec, w, dv)
            add_rows(out, np.concatenate([w, drawn]), np.concatenate([du, g.T @ v]))
    return vec


@dataclass
class WalkEmbedding:
    """DeepWalk (p = q = 1) or biased walks, then skip-gram.

    partitions: those of skip-gram, each of which learns from its own walks before vectors are averaged; None: by the number of words, up to
    the number of cores. Up to VOCABULARY nodes it is Spark's, whose vocabulary and vectors pass through the driver; walks are stored first, since it
    reads them twice. Beyond, tasks learn (learnt), and no name and no vector comes to the driver.
    """

    dimensions: int = 32
    walk_length: int = 10
    num_walks: int = 25
    window: int = 5
    p: float = 1.0
    q: float = 1.0
    seed: int = 42
    directed: bool = True
    partitions: int | None = None
    iterations: int = 1

    def learnt(self, edges: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
        """Vectors of n nodes by tasks: walks go by numbers of nodes and are dealt to partitions in a hashed order.

        A task holds its words and two vectors of each node among them. Those of a node are averaged by how often each task met it, in the order of tasks.
        """
        nodes = written(numbered(nodes.where("node is not null"), ["node"], "i").select("node", (F.col("i") - 1).alias("i")), "nodes")
        e = edges.select("source", "target").distinct()
        for c in ("source", "target"):
            e = e.join(nodes.select(F.col("node").alias(c), F.col("i").cast("string").alias(f"_{c}")), c, "left").drop(c)
        e = written(e.withColumnsRenamed({"_source": "source", "_target": "target"}), "numbers")
        paths = walks(e, self.num_walks, self.walk_length, self.seed, self.directed, self.p, self.q).where("start is not null")
        parts = self.partitions or max(1, min(-(-n * self.num_walks * self.walk_length // WORDS), edges.sparkSession.sparkContext.defaultParallelism))
        dealt = paths.select(F.xxhash64("start", "walk").alias("h"), "start", "walk", F.col("path").cast("array<int>").alias("path")).repartition(parts, "h").sortWithinPartitions("h", "start", "walk")
        size, window, iterations, seed = self.dimensions, self.window, self.iterations, self.seed

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, sizes = [], []
            for b in batches:
                flat, _, ends = _flat(b.column("path"))
                held.append(flat.to_numpy(zero_copy_only=False).astype(np.int32))
                sizes.append(np.diff(ends, prepend=0).astype(np.int32))
            words = np.concatenate([*held, np.zeros(0, np.int32)])
            held.clear()
            if not len(words):
                return
            walk = np.repeat(np.arange(sum(len(s) for s in sizes), dtype=np.int32), np.concatenate(sizes))
            counts = np.bincount(words, minlength=n)
            mine, part = np.flatnonzero(counts), TaskContext.get().partitionId()
            place = np.zeros(n, np.int32)
            place[mine] = np.arange(len(mine))
            vec = skip_gram(place[words], walk, len(mine), first_vectors(mine, size, seed), window, iterations, np.random.default_rng([seed, part]))
            for i in range(0, len(mine), 10_000):
                k = mine[i : i + 10_000]
                v = pa.FixedSizeListArray.from_arrays(pa.array(vec[i : i + 10_000].ravel()), size).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), part, np.int32)), pa.array(counts[k]), v], ["i", "part", "n", "v"])

        found = dealt.select("path").mapInArrow(learn, "i long, part int, n long, v array<float>")
        each = found.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("part", "n", "v"))).alias("of"), F.sum("n").alias("n"))
        zero = F.array_repeat(F.lit(0.0), size)
        mean = F.aggregate("of", zero, lambda m, x: F.zip_with(m, x["v"], lambda a, y: a + y * x["n"]), lambda m: F.transform(m, lambda a: a / F.col("n")))
        return nodes.join(each.select("i", mean.alias("vec")), "i").select(F.col("node").alias("node_id"), "vec")

    def fit(self, edges: DataFrame) -> DataFrame:
        nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
        n = nodes.count()
        if n > VOCABULARY:
            return self.learnt(edges, nodes, n)
        paths = walks(edges, self.num_walks, self.walk_length, self.seed, self.directed, self.p, self.q)
        ordered = written(paths.orderBy("start", "walk").select("path"), "walks")
        parts = self.partitions
        if parts is None:
            words = ordered.agg(F.sum(F.size("path"))).first()[0] or 0
            parts = max(1, min(-(-words // WORDS), edges.sparkSession.sparkContext.defaultParallelism))
        model = Word2Vec(vectorSize=self.dimensions, minCount=1, windowSize=self.window, seed=self.seed, numPartitions=parts, maxIter=self.iterations, inputCol="path", outputCol="_v").fit(ordered)
        return model.getVectors().select(F.col("word").alias("node_id"), vector_to_array("vector").alias("vec"))


#: Vectors iterated beside those wanted; residual at which they are done; restarts; bytes of the basis on the driver; blocks of it at most; share of it that a restart keeps.
GUARD, TOLERANCE, RESTARTS, BASIS_BYTES, DEPTH, KEPT = 8, 1e-7, 60, 320_000_000, 64, 0.4


def leading_vectors(times: Callable[[np.ndarray], np.ndarray], n: int, k: int, seed: int) -> np.ndarray:
    """The k leading eigenvectors of a symmetric operator on n numbers, by restarted block Krylov steps; times applies it to columns.

    Only the basis is held: its projection grows with each image, and what lies outside the basis in the last image is the residual.
    The basis is as deep as BASIS_BYTES allow. A restart keeps the best KEPT of it, many more vectors than are wanted, and goes on from
    the residual, so that little of what it knew is lost where eigenvalues lie close together.
    """
    wide = min(n, k + GUARD)
    depth = int(min(DEPTH, max(3, BASIS_BYTES // (8 * n * wide))))
    basis = np.empty((n, min(n, depth * wide)), order="F")
    small = np.zeros((basis.shape[1], basis.shape[1]))
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, wide)))[0]
    begin, end, step, restarts = 0, x.shape[1], 0, 0
    basis[:, :end] = x
    while True:
        step += 1
        whole, image = basis[:, :end], times(basis[:, begin:end])
        small[:end, begin:end] = whole.T @ image
        small[begin:end, :end] = small[:end, begin:end].T
        image -= whole @ small[:end, begin:end]
        full = end == basis.shape[1]
        if full or step % 4 == 0:
            values, vectors = np.linalg.eigh(small[:end, :end])
            values, vectors = values[::-1], vectors[:, ::-1]
            if np.abs(image @ vectors[begin:end, :k]).max() < TOLERANCE or full and (end == n or restarts == RESTARTS):
                break
        image -= whole @ (whole.T @ image)
        new, r = np.linalg.qr(image)
        new = new[:, np.abs(np.diag(r)) > 1e-12]
        if not new.shape[1]:
            vectors = np.linalg.eigh(small[:end, :end])[1][:, ::-1]
            break
        if full:
            keep = max(wide, int(KEPT * depth) * wide)
            basis[:, :keep] = whole @ vectors[:, :keep]
            small[:], restarts, end = 0, restarts + 1, keep
            np.fill_diagonal(small[:keep, :keep], values[:keep])
            whole = basis[:, :end]
        new = new[:, : basis.shape[1] - end]
        new -= whole @ (whole.T @ new)
        begin, end = end, end + new.shape[1]
        basis[:, begin:end] = np.linalg.qr(new)[0]
    return basis[:, :end] @ vectors[:, :k]


#: Parts of a two-sided matrix; entries of a piece of it; nodes of the fewer side whose sums travel as one row; singular value below which the other side is not told by it.
PARTS, ENTRIES, SUMMED, LEAST = 12, 1_000_000, 2048, 1e-3


class TwoSided:
    """The normalised adjacency B of a graph whose edges all lead from one set of nodes to another, as stored pieces of rows of the larger set.

    Eigenvectors of [[0, B], [B', 0]] with the largest values s are pairs (u, B'u / s) / sqrt(2), where B B' u = s^2 u; so only vectors
    over the fewer nodes are sent to the rows, and only their images come back. A piece holds the places of its ones by row and by
    column: degrees are divided out before and after. Rows, pieces and parts have one order, and sums too.
    """

    def __init__(self, fewer: DataFrame, n: int, edges: DataFrame):
        """fewer: (node, i), n of them; edges: distinct (few, many)."""
        self.n = n
        few = edges.groupBy("few").agg(F.count(F.lit(1)).alias("d")).join(fewer.select(F.col("node").alias("few"), "i"), "few")
        found = few.select("i", "d").toArrow()
        self.scale = np.zeros((n, 1))
        self.scale[found.column("i").to_numpy(), 0] = 1.0 / np.sqrt(found.column("d").to_numpy())
        many = edges.join(fewer.select(F.col("node").alias("few"), F.col("i").cast("int").alias("i")), "few").groupBy("many").agg(F.array_sort(F.collect_list("i")).alias("col"))
        dealt = many.repartition(PARTS, "many").sortWithinPartitions("many")
        self.pieces = dealt.mapInArrow(pieces, "many array<string>, col binary, begin binary, row binary, own binary, at binary").persist(StorageLevel.MEMORY_AND_DISK)

    def times(self, x: np.ndarray) -> np.ndarray:
        """B B' x."""
        shared, n, wide = self.pieces.sparkSession.sparkContext.broadcast(x * self.scale), self.n, x.shape[1]

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n, wide))
            for b in batches:
                for col, begin, row, own, at in zip(*[b.column(c) for c in ("col", "begin", "row", "own", "at")], strict=True):
                    begin, col = places(begin), places(col)
                    mine = summed(shared.value, col, begin)
                    mine /= np.diff(np.append(begin, len(col)))[:, None]
                    total[places(own)] += summed(mine, places(row), places(at))
            for i in range(0, n, SUMMED):
                if total[i : i + SUMMED].any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total[i : i + SUMMED].tobytes()], pa.binary())], ["i", "part", "y"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, total = None, None
            for b in batches:
                for i, y in zip(b.column("i").to_pylist(), b.column("y"), strict=True):
                    if i != at and at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["i", "y"])
                    new = np.frombuffer(y.as_buffer())
                    at, total = i, (new.copy() if i != at else total + new)
            if at is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["i", "y"])

        sums = self.pieces.select("col", "begin", "row", "own", "at").mapInArrow(part, "i long, part long, y binary").repartition("i").sortWithinPartitions("i", "part")
        found, out = sums.mapInArrow(add, "i long, y binary").toArrow(), np.zeros_like(x)
        for i, y in zip(found.column("i").to_pylist(), found.column("y"), strict=True):
            out[i : i + SUMMED] = np.frombuffer(y.as_buffer()).reshape(-1, wide)
        shared.unpersist()
        out *= self.scale
        return out

    def other_side(self, u: np.ndarray, s: np.ndarray) -> DataFrame:
        """(node_id, vec) of the larger set, from vectors over the fewer nodes and their singular values; none of it comes to the driver."""
        shared = self.pieces.sparkSession.sparkContext.broadcast(u / s * self.scale)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for names, col, begin in zip(b.column("many"), b.column("col"), b.column("begin"), strict=True):
                    begin, col = places(begin), places(col)
                    mine = summed(shared.value, col, begin) / np.sqrt(2.0 * np.diff(np.append(begin, len(col))))[:, None]
                    for i in range(0, len(mine), 10_000):
                        yield pa.RecordBatch.from_arrays([names.values.slice(i, 10_000), pa.array(list(mine[i : i + 10_000]), pa.list_(pa.float64()))], ["node_id", "vec"])

        return self.pieces.select("many", "col", "begin").mapInArrow(part, "node_id string, vec array<double>")


def places(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.int32)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (many, col) in pieces of about ENTRIES: their names, columns, where each row's begin; the rows in the order of their columns, the columns and where each one's begin."""

    def piece(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        lists = pa.concat_arrays(t.column("col").chunks)
        col, size = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
        begin, order = np.cumsum(size) - size, np.argsort(col, kind="stable")
        own, at = np.unique(col[order], return_index=True)
        packed = [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (col, begin, np.repeat(np.arange(len(size)), size)[order], own, at)]
        return pa.RecordBatch.from_arrays([pa.array([t.column("many").to_pylist()], pa.list_(pa.string())), *packed], ["many", "col", "begin", "row", "own", "at"])

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held, n = [*held, b], n + len(b.column("col").flatten())
            if n >= ENTRIES:
                yield piece(held)
                held, n = [], 0
    if held:
        yield piece(held)


def summed(x: np.ndarray, pick: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of x's rows pick[begin[k] : begin[k + 1]] for each k, none of them empty; those of one length a block at a time, long ones one by one."""
    ends, out = np.append(begin[1:], len(pick)), np.empty((len(begin), x.shape[1]))
    size = ends - begin
    for d in np.unique(size[size <= 64]):
        same = np.flatnonzero(size == d)
        for i in range(0, len(same), 2048):
            own = same[i : i + 2048]
            at = begin[own]
            y = x[pick[at]]
            for j in range(1, d):
                y += x[pick[at + j]]
            out[own] = y
    for k in np.flatnonzero(size > 64):
        out[k] = sum(x[pick[i : min(i + 4096, ends[k])]].sum(axis=0) for i in range(begin[k], ends[k], 4096))
    return out


@dataclass
class SpectralEmbedding:
    """Eigenvectors of the normalised Laplacian after the first, as those of 2I - L = I + D^-1/2 A D^-1/2 with the largest eigenvalues.

    The matrix stays distributed, a cached row for each node; each step sends it a block of vectors and gets their images back.
    The driver holds nodes x (dimensions + 9) numbers a few times; where no node is both source and target, as of proteins and sites,
    only those of the fewer kind. Signs, and the basis of equal eigenvalues, are arbitrary but the same for the same seed.
    """

    dimensions: int = 32
    directed: bool = False
    seed: int = 42

    def two_sided(self, edges: DataFrame) -> DataFrame | None:
        """The vectors where no node is both source and target; None where one is, or the fewer nodes don't tell all vectors."""
        e = edges.select("source", "target").distinct().persist(StorageLevel.MEMORY_AND_DISK)
        sides = [e.select(F.col(c).alias("node")).distinct() for c in ("source", "target")]
        found = None
        if two_sided(e):
            sizes = [x.count() for x in sides]
            few, many = ("source", "target") if sizes[0] <= sizes[1] else ("target", "source")
            n, k = min(sizes), self.dimensions + 1
            if n > k + GUARD:
                fewer = numbered(sides[0 if few == "source" else 1], ["node"], "i").withColumn("i", F.col("i") - 1).persist()
                matrix = TwoSided(fewer, n, e.select(F.col(few).alias("few"), F.col(many).alias("many")))
                u = leading_vectors(matrix.times, n, k, self.seed)
                s = np.sqrt(np.maximum((u * matrix.times(u)).sum(axis=0), 0.0))
                if s.min() > LEAST:
                    mine = edges.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(u[:, 1:] / np.sqrt(2))], "i long, vec array<double>")
                    found = fewer.join(mine, "i").select(F.col("node").alias("node_id"), "vec").unionByName(matrix.other_side(u[:, 1:], s[1:]))
                else:
                    matrix.pieces.unpersist()
        e.unpersist()
        return found

    def fit(self, edges: DataFrame) -> DataFrame:
        found = self.two_sided(edges)
        if found is not None:
            return found
        e = edges.select("source", "target").where("source <> target")
        e = e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
        everyone = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
        nodes = numbered(everyone, ["node"], "i").withColumn("i", F.col("i") - 1).persist()
        n = nodes.count()
        k = min(self.dimensions + 1, n)
        degree = e.groupBy("source").agg(F.count(F.lit(1)).alias("d"))
        a = e.join(degree, "source").join(degree.select(F.col("source").alias("target"), F.col("d").alias("dt")), "target")
        a = a.select("source", "target", (1.0 / F.sqrt(F.col("d").cast("double") * F.col("dt"))).alias("w"))
        a = a.join(nodes.select(F.col("node").alias("source"), F.col("i").alias("row")), "source").join(nodes.select(F.col("node").alias("target"), F.col("i").alias("col")), "target")
        rows = a.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "w"))).alias("x")).select("row", F.col("x.col").alias("col"), F.col("x.w").alias("w"))
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        spark = edges.sparkSession

        def times(x: np.ndarray) -> np.ndarray:
            shared = spark.sparkContext.broadcast(x)

            def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        col, w = b.column("col"), b.column("w")
                        begin = np.concatenate([[0], np.cumsum(pc.list_value_length(col).to_numpy())])[:-1]
                        out = np.add.reduceat(shared.value[pc.list_flatten(col).to_numpy()] * pc.list_flatten(w).to_numpy()[:, None], begin, axis=0)
                        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([r.tobytes() for r in out], pa.binary())], ["row", "y"])

            found, y = rows.mapInArrow(part, "row long, y binary").toArrow(), x.copy()
            if found.num_rows:
                y[found.column("row").to_numpy()] += np.frombuffer(b"".join(found.column("y").to_pylist())).reshape(-1, x.shape[1])
            shared.unpersist()
            return y

        v = leading_vectors(times, n, k, self.seed) if n else np.zeros((0, 0))
        rows.unpersist()
        vectors = spark.createDataFrame([(i, v[i, 1:].tolist()) for i in range(n)], "i long, vec array<double>")
        return nodes.join(vectors, "i").select(F.col("node").alias("node_id"), "vec")


def concatenated(a: DataFrame, b: DataFrame) -> DataFrame:
    """Vectors of nodes that both have, one after the other."""
    return a.select("node_id", F.col("vec").alias("_a")).join(b.select("node_id", F.col("vec").alias("_b")), "node_id").select("node_id", F.concat("_a", "_b").alias("vec"))


@dataclass
class ConcatEmbedding:
    first: EmbeddingStrategy
    second: EmbeddingStrategy
    directed: bool = False

    def fit(self, edges: DataFrame) -> DataFrame:
        return concatenated(self.first.fit(edges), self.second.fit(edges))


def make_strategy(name: str, dimensions: int = 64, seed: int = 42) -> EmbeddingStrategy:
    if name == "node2vec":
        return WalkEmbedding(dimensions=dimensions, seed=seed)
    if name == "spectral":
        return SpectralEmbedding(dimensions=dimensions, seed=seed)
    if name == "concat":
        return ConcatEmbedding(WalkEmbedding(dimensions=dimensions, seed=seed), SpectralEmbedding(dimensions=dimensions, seed=seed))
    raise ValueError(f"unknown embedding: {name}")
