"""Logistic pair models: exact fits by passes over a stored table, leave-one-out refits, and two-tier scoring of all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .blocks import crossed, matrix
from .evaluation import training_vectors
from .ranking import COUNTS_SCHEMA, Counter, Own, doubles, overlay, ranks_of_counts, true_candidates, with_categories, with_truth, with_truth_lists
from .tables import numbered, union_all

#: Training rows taken at once; trials refitted side by side.
CHUNK, SIDE = 1024, 512
#: Coefficients of the models that are refitted together by exact passes, on the driver; models of a packed sum; sums added by one task.
BLOCK_NUMBERS, GRADIENT_SLICE, FAN = 2_000_000, 1024, 32
#: Third derivatives at most, beyond which all refits are by exact passes; those of a packed sum.
CUBE_NUMBERS, CUBE_SLICE = 10_000_000, 1_000_000
#: Error of a score that a refit may have.
TOLERANCE = 1e-6


def fit_pair_model(rows: DataFrame, c: float = 1.0) -> np.ndarray:
    """Coefficients, the intercept last, of an L2 model with balanced class weights; the intercept is penalised like the rest.

    rows has label and features of one length; the optimum is exact (Newton steps over sums made on executors).
    """
    width = rows.agg(F.max(F.size("features"))).first()[0] or 0
    return Passes(stored(rows), width + 1).optimum(c)[0]


def pair_rows(k: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Features of each row of k with the vector s (or its row of s), and a constant."""
    t = np.broadcast_to(s, k.shape)
    return np.concatenate([k, t, np.abs(k - t), k * t, np.ones((len(k), 1))], axis=1)


def linear_scores(k: np.ndarray, s: np.ndarray, models: np.ndarray) -> np.ndarray:
    """For each row of s, with the model in the same row, its pairs with all rows of k; terms are added in order, so that equal pairs have equal scores anywhere."""
    wide = s.shape[1]
    total = np.repeat(models[:, -1:], len(k), axis=1)
    for j in range(wide):
        a, b, m = k[None, :, j], s[:, j, None], models[:, j:-1:wide, None]
        total += a * m[:, 0] + b * m[:, 1] + np.abs(a - b) * m[:, 2] + a * b * m[:, 3]
    return total


def chance(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def unpacked(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x) for x in column.to_pylist()])


def class_weights(n: int, pos: int, c: float = 1.0) -> tuple[float, float]:
    """Balanced weights of a positive and a negative among n rows."""
    return c * n / (2 * max(1, pos)), c * n / (2 * max(1, n - pos))


def weights_without_one(n: int, pos: int, c: float = 1.0) -> tuple[float, float]:
    """Balanced weights once a positive row is gone."""
    return class_weights(n - 1, pos - 1, c)


class TrainingTable:
    """n rows of which the first pos are positive; they are built a chunk at a time."""

    n: int
    pos: int

    def rows(self, at: np.ndarray | slice) -> np.ndarray:
        raise NotImplementedError

    def chunks(self) -> Iterator[tuple[np.ndarray, bool]]:
        for begin, end in ((0, self.pos), (self.pos, self.n)):
            for at in range(begin, end, CHUNK):
                yield self.rows(slice(at, min(end, at + CHUNK))), begin < self.pos

    def gradient(self, w: np.ndarray, sp: float, sn: float) -> np.ndarray:
        """x.T @ (weighted residuals) of each column of coefficients."""
        total = np.zeros_like(w)
        with np.errstate(over="ignore"):
            for x, positive in self.chunks():
                r = x @ w
                np.exp(r if positive else np.negative(r, out=r), out=r)
                r += 1
                total += x.T @ np.divide(-sp if positive else sn, r, out=r)
        return total

    def hessian(self, w: np.ndarray, sp: float, sn: float) -> np.ndarray:
        total = np.eye(len(w))
        for x, positive in self.chunks():
            p = 1 / (1 + np.exp(-(x @ w)))
            total += (x * ((sp if positive else sn) * p * (1 - p))[:, None]).T @ x
        return total

    def optimum(self, d: int, sp: float, sn: float, steps: int = 50, tol: float = 1e-10) -> np.ndarray:
        """The d coefficients of the whole table, by Newton steps."""
        w = np.zeros(d)
        for _ in range(steps):
            step = np.linalg.solve(self.hessian(w, sp, sn), self.gradient(w[:, None], sp, sn)[:, 0] + w)
            w = w - step
            if np.abs(step).max() < tol:
                break
        return w


class DenseTable(TrainingTable):
    """A training matrix in memory; order has the places of its rows in x."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.order = np.argsort(-y, kind="stable")
        self.x, self.n, self.pos = x[self.order], len(y), int(y.sum())

    def rows(self, at: np.ndarray | slice) -> np.ndarray:
        return self.x[at]


def hessian(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: float = 1.0) -> np.ndarray:
    return DenseTable(x, y).hessian(w, *class_weights(len(y), int(y.sum()), c))


def newton(x: np.ndarray, y: np.ndarray, c: float = 1.0) -> np.ndarray:
    return DenseTable(x, y).optimum(x.shape[1], *class_weights(len(y), int(y.sum()), c))


def refits(x: np.ndarray, y: np.ndarray, w: np.ndarray, inverse: np.ndarray, masked: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Columns of coefficients of the model of x and y, each without one positive row (-1: none); inverse is that of the Hessian at w."""
    data = DenseTable(x, y)
    less = weights_without_one(data.n, data.pos, c)
    out = np.repeat(w[:, None], len(masked), axis=1)
    gone = masked >= 0
    if gone.any():
        out[:, gone] = masked_optima(lambda o: data.gradient(o, *less), data.gradient(w[:, None], *less), w, inverse, x[masked[gone]], less[0])
    return out


def masked_optima(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, w: np.ndarray, inverse: np.ndarray, rows: np.ndarray, sp: float, steps: int = 500, tol: float = 1e-9, begin: np.ndarray | None = None) -> np.ndarray:
    """Columns of coefficients, each the optimum without its positive row, exact to tol.

    gradient gives that of the table's losses for columns of coefficients, start being its value at w, and inverse is that of the
    Hessian at w; all three with the class weights (sp: of a positive) of a table that lacks one positive. A step uses the Hessian
    without the column's own row (Sherman-Morrison). The first needs no pass over the table; the steps then shrink at
    a steady rate, which tells when what is left is below tol. begin: columns that are near the optima, to start from instead of w.
    """
    out, at = (np.repeat(w[:, None], len(rows), axis=1), start) if begin is None else (begin.copy(), gradient(begin))
    u = inverse @ rows.T
    p = 1 / (1 + np.exp(-(rows @ w)))
    h = sp * p * (1 - p)
    h = h / (1 - h * np.einsum("td,dt->t", rows, u))
    before = np.full(len(rows), np.inf)
    for i in range(steps):
        own = 1 / (1 + np.exp(-np.einsum("td,dt->t", rows, out))) - 1
        g = at + out - (rows * (sp * own)[:, None]).T
        step = inverse @ g
        step += u * (h * np.einsum("dt,dt->t", u, g))
        out -= step
        size = np.abs(step).max(axis=0)
        rate = size / np.maximum(before, 1e-300)
        if i and ((size < tol) | ((rate < 0.5) & (2 * size * rate < tol))).all():
            break
        before, at = size, gradient(out)
    return out


def stored(rows: DataFrame) -> DataFrame:
    """Training rows (label and features, or label, kv and sv) in the shared folder, since every pass reads them."""
    held = ["features"] if "features" in rows.columns else ["kv", "sv"]
    return written(rows.select(*[F.col(c).cast("array<double>").alias(c) for c in held], F.col("label").cast("int").alias("label")), "training")


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(label, rows of features with the constant), at most CHUNK rows at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, CHUNK):
            b = whole.slice(at, CHUNK)
            if "features" in b.schema.names:
                x = np.hstack([matrix(b.column("features")), np.ones((b.num_rows, 1))])
            else:
                x = pair_rows(matrix(b.column("kv")), matrix(b.column("sv")))
            y = b.column("label").to_numpy()
            for label in (0, 1):
                if (y == label).any():
                    yield label, x[y == label]


SUMS = "key long, part long, v binary"


def added(parts: DataFrame, n_parts: int) -> dict[int, np.ndarray]:
    """Sums of packed numbers by key, at most FAN summands in a task, in a tree; parts has (key, part, v)."""

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v) for v in t.column("v").to_pylist()], axis=0)
        return pa.table({"key": t.column("key")[:1], "part": t.column("part")[:1], "v": pa.array([total.tobytes()], pa.binary())})

    while n_parts > 1:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("key", "part").applyInArrow(add, SUMS)
        n_parts = -(-n_parts // FAN)
    found = parts.toArrow()
    return dict(zip(found.column("key").to_pylist(), [np.frombuffer(v) for v in found.column("v").to_pylist()], strict=True))


@dataclass
class Passes:
    """Passes over a stored training table: each sums numbers on executors; only sums come back."""

    table: DataFrame
    d: int
    positives: DataFrame | None = None

    def __post_init__(self) -> None:
        self.whole: tuple[float, tuple] | None = None
        self.n_parts = self.table.rdd.getNumPartitions()

    def sums(self, shared: object, kernel: Callable[[object, Iterator[tuple[int, np.ndarray]]], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
        """kernel gets what is shared and a task's matrices, and gives (key, numbers)."""
        held = self.table.sparkSession.sparkContext.broadcast(shared)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get().partitionId()
            for key, v in kernel(held.value, matrices(batches)):
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([task], pa.int64()), pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())], ["key", "part", "v"])

        found = added(self.table.mapInArrow(part, SUMS), self.n_parts)
        held.unpersist()
        return found

    def bend(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By label (0, 1): numbers of rows, gradients and Hessians of the losses at w, without class weights."""
        d = self.d

        def kernel(w: np.ndarray, mine: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
            total = np.zeros((2, 1 + d + d * d))
            for label, x in mine:
                p = 1 / (1 + np.exp(-(x @ w)))
                total[label] += np.concatenate([[len(x)], x.T @ (p - label), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
            yield 0, total

        found = self.sums(w, kernel).get(0, np.zeros(2 * (1 + d + d * d))).reshape(2, -1)
        return found[:, 0], found[:, 1 : d + 1], found[:, d + 1 :].reshape(2, d, d)

    def farthest(self, inverse: np.ndarray) -> float:
        """The largest norm of a row by the inverse of a Hessian."""

        def kernel(inverse: np.ndarray, mine: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
            yield TaskContext.get().partitionId(), np.array([max((float(np.einsum("nd,nd->n", x @ inverse, x).max()) for _, x in mine), default=0.0)])

        return float(np.sqrt(max((v[0] for v in self.sums(inverse, kernel).values()), default=0.0)))

    def cube(self, w: np.ndarray, sp: float, sn: float) -> np.ndarray:
        """The third derivatives of the losses at w: for each coefficient those by pairs (i <= j) of the others."""
        i, j = np.triu_indices(self.d)
        d, wide = self.d, max(1, CUBE_SLICE // self.d)

        def kernel(shared: tuple[np.ndarray, float, float], mine: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
            w, sp, sn = shared
            total = np.zeros((len(i), d))
            for label, x in mine:
                p = 1 / (1 + np.exp(-(x @ w)))
                y = x * ((sp if label else sn) * p * (1 - p) * (1 - 2 * p))[:, None]
                for at in range(0, len(i), wide):
                    k = slice(at, at + wide)
                    total[k] += (x[:, i[k]] * x[:, j[k]]).T @ y
            for at in range(0, len(i), wide):
                yield at, total[at : at + wide]

        found = self.sums((w, sp, sn), kernel)
        return np.vstack([found[k].reshape(-1, d) for k in sorted(found)]) if found else np.zeros((len(i), d))

    def gradient(self, w: np.ndarray, sp: float, sn: float) -> np.ndarray:
        """x.T @ (weighted residuals) of each column of coefficients."""

        def kernel(shared: tuple[np.ndarray, float, float], mine: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
            w, sp, sn = shared
            total = np.zeros_like(w)
            with np.errstate(over="ignore"):
                for label, x in mine:
                    for at in range(0, w.shape[1], SIDE):
                        k = slice(at, at + SIDE)
                        r = x @ w[:, k]
                        np.exp(r if label else np.negative(r, out=r), out=r)
                        r += 1
                        total[:, k] += x.T @ np.divide(-sp if label else sn, r, out=r)
            for at in range(0, w.shape[1], GRADIENT_SLICE):
                yield at, total[:, at : at + GRADIENT_SLICE]

        found = self.sums((w, sp, sn), kernel)
        return np.hstack([found[k].reshape(self.d, -1) for k in sorted(found)]) if found else np.zeros_like(w)

    def optimum(self, c: float = 1.0, steps: int = 50, tol: float = 1e-10) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The whole table's coefficients, by Newton steps, and what bend() gives there; found once."""
        if self.whole and self.whole[0] == c:
            return self.whole[1]
        w = np.zeros(self.d)
        bent = self.bend(w)
        for _ in range(steps):
            n, g, h = bent
            sp, sn = class_weights(int(n.sum()), int(n[1]), c)
            step = np.linalg.solve(np.eye(self.d) + sp * h[1] + sn * h[0], sp * g[1] + sn * g[0] + w)
            w = w - step
            bent = self.bend(w)
            if np.abs(step).max() < tol:
                break
        self.whole = (c, (w, bent))
        return w, bent


@dataclass
class Expansion:
    """The losses around the whole table's optimum to third order: what a refit without one row needs, whatever the number of rows.

    A refit is the root of the expanded gradient less the row's own. Its distance from the true optimum is bounded: a logistic loss's
    derivatives from the second on are at most its second, which grows at most e-fold for each unit of the linear score. So with delta the way from
    w, |delta|_H its norm by the Hessian, and reach = far |delta|_H (far: the largest norm of a row by the inverse Hessian) what the
    way moves any row at most, the error in the norm of the Hessian is at most reach^2 exp(2 reach) |delta|_H / 6; that of a score is at most a
    quarter of it times its row's norm over the root of the least curvature.
    """

    w: np.ndarray
    g: np.ndarray
    h: np.ndarray
    cube: np.ndarray | None
    sp: float
    radius: float
    far: float

    def __post_init__(self) -> None:
        self.inverse = np.linalg.inv(np.eye(len(self.w)) + self.h)
        self.sharpest = float(np.sqrt(np.linalg.eigvalsh(self.inverse)[-1]))
        self.i, self.j = np.triu_indices(len(self.w))
        self.times = np.where(self.i == self.j, 0.5, 1.0)

    def gradient(self, out: np.ndarray) -> np.ndarray:
        delta = out - self.w[:, None]
        return self.g[:, None] + self.h @ delta + self.cube.T @ (delta[self.i] * delta[self.j] * self.times[:, None])

    def refits(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns of coefficients, each without the row of own, and whether their error of a score is known to be below TOLERANCE."""
        if self.cube is None:
            return np.repeat(self.w[:, None], len(own), axis=1), np.zeros(len(own), bool)
        with np.errstate(all="ignore"):
            out = masked_optima(self.gradient, self.g[:, None], self.w, self.inverse, own, self.sp, steps=25, tol=1e-13)
            delta = out - self.w[:, None]
            error = self.error(delta)
        return out, np.isfinite(out).all(axis=0) & (error < TOLERANCE)

    def error(self, delta: np.ndarray) -> np.ndarray:
        """The most by which scores may be wrong, for each column."""
        bent = np.sqrt(np.einsum("dt,dt->t", delta, delta + self.h @ delta))
        reach = self.far * bent
        return reach**2 * np.exp(2 * reach) * bent / 6 * self.sharpest * self.radius / 4


def training_table(rows: DataFrame, vectors: DataFrame) -> Passes:
    """Training rows ready for passes; rows have the features of their nodes' vectors."""
    width = vectors.agg(F.max(F.size("vec"))).first()[0] or 0
    table = Passes(stored(rows), 4 * width + 1)
    table.positives = written(rows.where("label = 1").select("kinase_node_id", "site_node_id").distinct(), "positives")
    return table


def refitted(table: Passes, trials: DataFrame, vectors: DataFrame, c: float = 1.0) -> DataFrame:
    """(trial_index, kinase_node_id, site_node_id, sv, model) of the trials whose site has a vector; model is packed.

    The model is fitted without the trial's own pair (the whole table's, if the pair is no positive row), with class weights of the
    rows left. It comes from the expansion around the whole table's optimum where that is known to be right to TOLERANCE, as it is at any large
    number of rows, and else by steps with exact gradients, summed over the table for a block of models at a time.
    """
    spark = trials.sparkSession
    a = vectors.agg(F.max(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
    w, (n, g, h) = table.optimum(c)
    sp, sn = weights_without_one(int(n.sum()), int(n[1]), c)
    cube = table.cube(w, sp, sn) if len(w) ** 3 // 2 <= CUBE_NUMBERS else None
    bent = sp * h[1] + sn * h[0]
    far = table.farthest(np.linalg.inv(np.eye(len(w)) + bent)) if cube is not None else 0.0
    fit = Expansion(w, sp * g[1] + sn * g[0], bent, cube, sp, float(np.sqrt(1 + 6 * a + a * a)), far)
    pair = ["kinase_node_id", "site_node_id"]
    known = table.positives.withColumn("_row", F.lit(True))
    of = lambda c, v: vectors.select(F.col("node_id").alias(c), F.col("vec").cast("array<double>").alias(v))
    t = trials.select("trial_index", *pair).join(of("site_node_id", "sv"), "site_node_id").join(of("kinase_node_id", "kv"), "kinase_node_id", "left").join(known, pair, "left")
    held = spark.sparkContext.broadcast(fit)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, SIDE):
                b = whole.slice(at, SIDE)
                mine = b.column("_row").is_valid().to_numpy(zero_copy_only=False)
                out, sure = np.repeat(fit.w[:, None], len(mine), axis=1), np.ones(len(mine), bool)
                if mine.any():
                    k, s = (matrix(b.column(c).filter(pa.array(mine))) for c in ("kv", "sv"))
                    out[:, mine], sure[mine] = fit.refits(pair_rows(k, s))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("trial_index", *pair, "sv", "kv")], pa.array([x.tobytes() for x in out.T], pa.binary()), pa.array(sure)], ["trial_index", *pair, "sv", "kv", "model", "sure"])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    solved = written(t.repartition(parts, "trial_index").mapInArrow(solve, "trial_index long, kinase_node_id string, site_node_id string, sv array<double>, kv array<double>, model binary, sure boolean"), "models")
    columns = ["trial_index", *pair, "sv", "model"]
    unsure = solved.where(~F.col("sure"))
    blocks = -(-unsure.count() * len(w) // BLOCK_NUMBERS)
    out = [solved.where("sure").select(*columns)]
    unsure = unsure.withColumn("_b", F.pmod(F.xxhash64("trial_index", *pair), F.lit(max(1, blocks))))
    for i in range(blocks):
        b = unsure.where(F.col("_b") == i).drop("_b", "sure").toArrow()
        if b.num_rows:
            k, s = (matrix(b.column(c).combine_chunks()) for c in ("kv", "sv"))
            near = np.stack([np.frombuffer(x) for x in b.column("model").to_pylist()], axis=1)
            models = masked_optima(lambda o: table.gradient(o, sp, sn), fit.g[:, None], w, fit.inverse, pair_rows(k, s), sp, begin=near if np.isfinite(near).all() else None)
            b = b.drop_columns(["kv", "model"]).append_column("model", pa.array([x.tobytes() for x in models.T], pa.binary()))
            out.append(spark.createDataFrame(b).select(*columns))
    return union_all(out)


def masked_scores(rows: DataFrame, trials: DataFrame, cands: DataFrame, vectors: DataFrame, c: float = 1.0, own_only: bool = False) -> DataFrame:
    """(trial_index, kinase_node_id, site_node_id, score) of every candidate, by a model fitted without the trial's own pair.

    Trials whose site has no vector are left out. With own_only a trial scores only its own candidate. Trials and candidates meet in blocks.
    """
    models = refitted(training_table(rows, vectors), trials, vectors, c)
    if own_only:
        return own_scores(models, cands, vectors)
    cand = cands.select("node_id").distinct().join(doubles(vectors, "vec"), "node_id")

    def score(left: pa.RecordBatch, right: pa.RecordBatch) -> pa.RecordBatch:
        found = chance(linear_scores(matrix(right.column("vec")), matrix(left.column("sv")), unpacked(left.column("model"))))
        i, j = (pa.array(x) for x in np.divmod(np.arange(found.size), found.shape[1]))
        return pa.RecordBatch.from_arrays([left.column("trial_index").take(i), right.column("node_id").take(j), left.column("site_node_id").take(i), pa.array(found.ravel())], ["trial_index", "kinase_node_id", "site_node_id", "score"])

    return crossed(models.drop("kinase_node_id"), cand, score, "trial_index long, kinase_node_id string, site_node_id string, score double")


def own_scores(models: DataFrame, cands: DataFrame, vectors: DataFrame) -> DataFrame:
    """(trial_index, kinase_node_id, site_node_id, score) of each trial's own pair by its model, if its kinase is a candidate with a vector."""
    mine = models.join(cands.select("node_id").distinct().join(doubles(vectors, "kv"), "node_id").withColumnRenamed("node_id", "kinase_node_id"), "kinase_node_id")
    names = ["trial_index", "kinase_node_id", "site_node_id"]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k, s, m = matrix(b.column("kv")), matrix(b.column("sv")), unpacked(b.column("model"))
                z = np.concatenate([linear_scores(k[i : i + 1], s[i : i + 1], m[i : i + 1])[0] for i in range(len(k))])
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(chance(z))], [*names, "score"])

    return mine.mapInArrow(own, "trial_index long, kinase_node_id string, site_node_id string, score double")


def leave_one_out(positives: DataFrame, trials: DataFrame, cands: DataFrame, vectors: DataFrame, categories: DataFrame | None = None, per_site: int = 50) -> DataFrame:
    """Result rows of every trial: each refit is without its own positive, then ranked among all candidates."""
    models = refitted(training_table(training_vectors(positives, cands, vectors, per_site), vectors), trials, vectors)
    c = with_categories(cands, vectors, categories)
    left = models.drop("kinase_node_id").join(true_candidates(trials, c), "site_node_id")

    def count(left: pa.RecordBatch, right: pa.RecordBatch) -> pa.RecordBatch:
        counter, own, sv, m = Counter(right), Own(left.column("own")), matrix(left.column("sv")), unpacked(left.column("model"))
        scores = chance(linear_scores(matrix(right.column("vec")), sv, m))
        for i, (key, begin, end) in enumerate(zip(zip(left.column("trial_index").to_pylist(), left.column("site_node_id").to_pylist(), strict=True), own.begins, own.ends, strict=True)):
            held = chance(linear_scores(own.vecs[begin:end], sv[i : i + 1], m[i : i + 1]))[0]
            counter.add(key, scores[i], own.names[begin:end], own.kinds[begin:end], held)
        return counter.batch([("trial_index", pa.int64()), ("site_node_id", pa.string())])

    group = ["trial_index", "site_node_id"]
    ranks = ranks_of_counts(crossed(left, c, count, f"trial_index long, site_node_id string, {COUNTS_SCHEMA}"), group, categories is not None)
    ranked = with_truth_lists(trials, trials, ranks, [*group, "kinase_node_id"])
    present = vectors.select(F.col("node_id").alias("site_node_id")).withColumn("_s", F.lit(1))
    have = vectors.select(F.col("node_id").alias("true_kinase_node_id")).withColumn("_k", F.lit(1))
    out = ranked.join(present, "site_node_id", "left").join(have, "true_kinase_node_id", "left")
    return out.withColumns({"held_out_relation": F.lit("phosphorylates"), "site_embedding_present": F.coalesce("_s", F.lit(0)), "true_kinase_embedding_present": F.coalesce("_k", F.lit(0))}).drop("_s", "_k")


def global_scores(rows: DataFrame, cands: DataFrame, sites: DataFrame, vectors: DataFrame) -> DataFrame:
    """(kinase_node_id, site_node_id, score) of all pairs by one model of the rows, in blocks of sites and candidates."""
    return scores_of(fit_pair_model(rows), cands, sites, vectors)


def scores_of(w: np.ndarray, cands: DataFrame, sites: DataFrame, vectors: DataFrame) -> DataFrame:
    v = vectors.select("node_id", F.col("vec").cast("array<double>").alias("vec"))
    c = cands.select("node_id").distinct().join(v, "node_id")
    s = sites.select("node_id").distinct().join(v, "node_id").select(F.col("node_id").alias("site_node_id"), F.col("vec").alias("sv"))

    def score(left: pa.RecordBatch, right: pa.RecordBatch) -> pa.RecordBatch:
        found = chance(linear_scores(matrix(right.column("vec")), matrix(left.column("sv")), np.repeat(w[None], left.num_rows, axis=0)))
        i, j = (pa.array(x) for x in np.divmod(np.arange(found.size), found.shape[1]))
        return pa.RecordBatch.from_arrays([right.column("node_id").take(j), left.column("site_node_id").take(i), pa.array(found.ravel())], ["kinase_node_id", "site_node_id", "score"])

    return crossed(s, c, score, "kinase_node_id string, site_node_id string, score double")


def predict_all(positives: DataFrame, cands: DataFrame, sites: DataFrame, vectors: DataFrame, per_site: int = 50) -> DataFrame:
    """Two tiers: all pairs by the global model, true pairs by a refit without themselves; ranked, with is_true_kinase from the truth set."""
    table = training_table(training_vectors(positives, cands, vectors, per_site), vectors)
    own = numbered(positives.select("kinase_node_id", "site_node_id").distinct(), ["kinase_node_id", "site_node_id"])
    # a site has one trial for each of its true kinases: only the score of the trial's own kinase counts
    mine = own_scores(refitted(table, own, vectors), cands, vectors)
    wide = scores_of(table.optimum()[0], cands, sites, vectors)
    return with_truth(overlay(wide, mine), positives)
