"""Scoring pairs and ranking candidates within sites: plain, held-out, adjusted, best-true and within-category ranks."""

from __future__ import annotations

from bisect import bisect_left
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .blocks import crossed, matrix


class PairScorer(Protocol):
    """Scores every candidate for every site."""

    def scores(self, vectors: DataFrame, candidates: DataFrame, sites: DataFrame) -> DataFrame:
        """(kinase_node_id, site_node_id, score); null where a vector has no direction."""
        ...


class CosineScorer:
    def scores(self, vectors: DataFrame, candidates: DataFrame, sites: DataFrame) -> DataFrame:
        return cosine_scores(vectors, candidates, sites)


def _norms(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * x[:, j]
    return np.sqrt(total)


def cosines(s: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Cosines of rows of s with rows of k; NaN where one has no direction. Terms are added in order, so that equal vectors have equal cosines anywhere."""
    total = np.zeros((len(s), len(k)))
    for j in range(s.shape[1]):
        total += s[:, j, None] * k[None, :, j]
    norms = _norms(s)[:, None] * _norms(k)[None, :]
    with np.errstate(all="ignore"):
        return np.where(norms == 0, np.nan, total / norms)


def doubles(vectors: DataFrame, name: str) -> DataFrame:
    return vectors.select("node_id", F.col("vec").cast("array<double>").alias(name))


def network_scores(vectors: DataFrame, slices: dict[str, tuple[int, int]], candidates: DataFrame, sites: DataFrame) -> DataFrame:
    """(network, kinase_node_id, site_node_id, score) of all pairs in each network, whose vectors are slices (from, to) of vec; one crossing for all."""
    c = candidates.select("node_id").distinct().join(doubles(vectors, "vec"), "node_id")
    s = sites.select("node_id").distinct().join(doubles(vectors, "sv"), "node_id").select(F.col("node_id").alias("site_node_id"), "sv")

    def score(left: pa.RecordBatch, right: pa.RecordBatch) -> pa.RecordBatch:
        sv, kv = matrix(left.column("sv")), matrix(right.column("vec"))
        found = np.concatenate([cosines(sv[:, a:b], kv[:, a:b]).ravel() for a, b in slices.values()])
        i, j = np.divmod(np.tile(np.arange(len(sv) * len(kv)), len(slices)), len(kv))
        names = pa.array(list(slices)).take(pa.array(np.repeat(np.arange(len(slices)), len(sv) * len(kv))))
        return pa.RecordBatch.from_arrays([names, right.column("node_id").take(pa.array(j)), left.column("site_node_id").take(pa.array(i)), pa.array(found, mask=np.isnan(found))], ["network", "kinase_node_id", "site_node_id", "score"])

    return crossed(s, c, score, "network string, kinase_node_id string, site_node_id string, score double")


def cosine_scores(vectors: DataFrame, candidates: DataFrame, sites: DataFrame) -> DataFrame:
    """(kinase_node_id, site_node_id, score): cosine of each candidate with each site; null where a vector has no direction."""
    return network_scores(vectors, {"": (0, None)}, candidates, sites).drop("network")


def top_candidates(scores: DataFrame, k: int) -> DataFrame:
    """(site_node_id, kinase_node_id, score, rank_in_site) of each site's k best: k are kept by each task before sites meet."""
    best = F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("less"), F.col("kinase_node_id").alias("kinase_node_id"))
    heads = scores.withColumn("_t", F.spark_partition_id()).groupBy("site_node_id", "_t").agg(F.slice(F.array_sort(F.collect_list(best)), 1, k).alias("_h"))
    merged = heads.groupBy("site_node_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_h"))), 1, k).alias("_h"))
    rows = merged.select("site_node_id", F.posexplode("_h").alias("_r", "_b"))
    return rows.select("site_node_id", "_b.kinase_node_id", (-F.col("_b.less")).alias("score"), (F.col("_r") + 1).cast("long").alias("rank_in_site"))


CATEGORIES = ("poor", "average", "rich")


def _before(scores: np.ndarray, held: np.ndarray, names_before: np.ndarray) -> np.ndarray:
    """Which scores come before each held one: higher, or equal and by a name before its own (names_before: how many those are); NaN comes last."""
    held, none = held[:, None], np.isnan(scores)[None, :]
    lost = np.isnan(held)
    equal = np.where(lost, none, scores == held) & (np.arange(len(scores)) < names_before[:, None])
    return np.where(lost, ~none, scores > held) | equal


_BEST = pa.struct([("none", pa.bool_()), ("less", pa.float64()), ("name", pa.string())])
_TOPS = ("top", *[f"top_{x}" for x in CATEGORIES])
_COUNTS = ("n", "above", "true_above", "within", "true_within")


def with_categories(candidates: DataFrame, vectors: DataFrame, categories: DataFrame | None) -> DataFrame:
    """(node_id, vec, category) of candidates that have a vector; without a category they are poor."""
    c = candidates.select("node_id").distinct().join(doubles(vectors, "vec"), "node_id")
    if categories is None:
        return c.withColumn("category", F.lit("poor"))
    return c.join(categories.select(F.col("kinase_node_id").alias("node_id"), "category"), "node_id", "left").withColumn("category", F.coalesce("category", F.lit("poor")))


def true_candidates(trials: DataFrame, candidates: DataFrame) -> DataFrame:
    """(site_node_id, own): each site's true kinases that are candidates, in order, with their category and vector."""
    own = trials.select("kinase_node_id", "site_node_id").distinct().join(candidates.withColumnRenamed("node_id", "kinase_node_id"), "kinase_node_id")
    return own.groupBy("site_node_id").agg(F.array_sort(F.collect_list(F.struct("kinase_node_id", "category", "vec"))).alias("own"))


class Own:
    """The true kinases of a block of sites, as true_candidates gives them: a site's are those from begin to end."""

    def __init__(self, own: pa.Array):
        self.ends = np.cumsum(pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.int64))
        self.begins = np.concatenate([[0], self.ends[:-1]])
        names, kinds, vecs = pc.list_flatten(own).flatten()
        self.names, self.kinds, self.vecs = np.array(names.to_pylist(), object), np.array(kinds.to_pylist(), object), matrix(vecs)


#: Held-out kinases of a site that are counted at once.
HELD = 256


class Counter:
    """Rows of counts for held-out kinases against one block of candidates (node_id, category), given scores of both; kept as columns."""

    def __init__(self, right: pa.RecordBatch):
        self.names, self.kinds = right.column("node_id").to_pylist(), np.array(right.column("category").to_pylist(), object)
        self.at = [np.arange(len(self.names)), *[np.flatnonzero(self.kinds == x) for x in CATEGORIES]]
        self.keys: list[tuple] = []
        self.own: list[tuple[np.ndarray, np.ndarray]] = []
        self.counts: list[np.ndarray] = []
        self.tops: list[tuple[list[int], list[float]]] = []
        self.sizes: list[int] = []

    def best(self, scores: np.ndarray, at: np.ndarray) -> int:
        """The place of the best of those at, the first of equals; -1 if there are none."""
        if not len(at):
            return -1
        return int(at[0] if np.isnan(scores[at]).all() else at[np.nanargmax(scores[at])])

    def add(self, keys: tuple, scores: np.ndarray, names: np.ndarray, kinds: np.ndarray, held: np.ndarray) -> None:
        """A row for each of a site's true kinases (names, kinds): scores are those of the block, held those of the kinases."""
        places = [self.best(scores, at) for at in self.at]
        self.keys.append(keys)
        self.own.append((names, kinds))
        self.tops.append((places, [np.nan if i < 0 else -scores[i] for i in places]))
        self.sizes.append(len(names))
        for i in range(0, len(names), HELD):
            h, kind = held[i : i + HELD], kinds[i : i + HELD, None]
            all_before = _before(scores, h, np.array([bisect_left(self.names, x) for x in names[i : i + HELD]]))
            own_before = _before(held, h, np.arange(i, i + len(h)))
            counts = (all_before, own_before, all_before & (self.kinds == kind), own_before & (kinds == kind))
            self.counts.append(np.stack([np.full(len(h), len(self.names)), *[c.sum(axis=1) for c in counts]]))

    def batch(self, keys: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        columns = [pa.array([k[i] for k in self.keys], t).take(pa.array(row)) for i, (_, t) in enumerate(keys)]
        columns += [pa.array(np.concatenate([o[i] for o in self.own]) if self.own else [], pa.string()) for i in (0, 1)]
        counts = np.concatenate(self.counts, axis=1) if self.counts else np.zeros((len(_COUNTS), 0), np.int64)
        columns += [pa.array(c, pa.int64()) for c in counts]
        names = pa.array(self.names, pa.string())
        for i in range(len(_TOPS)):
            place, less = np.array([t[0][i] for t in self.tops], np.int64)[row], np.array([t[1][i] for t in self.tops], float)[row]
            none = np.isnan(less)
            parts = [pa.array(none), pa.array(less, mask=none), names.take(pa.array(place, mask=place < 0))]
            columns.append(pa.StructArray.from_arrays(parts, fields=list(_BEST), mask=pa.array(place < 0)))
        return pa.RecordBatch.from_arrays(columns, [*[k for k, _ in keys], "kinase_node_id", "category", *_COUNTS, *_TOPS])


COUNTS_SCHEMA = f"kinase_node_id string, category string, {', '.join(f'{c} long' for c in _COUNTS)}, {', '.join(f'{c} struct<none:boolean,less:double,name:string>' for c in _TOPS)}"


def ranks_of_counts(counts: DataFrame, group: list[str], categories: bool) -> DataFrame:
    """The rank columns of trial_ranks for each group and true kinase, from the counts of all blocks."""
    sums = counts.groupBy(*group, "kinase_node_id", "category").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in ("above", "within")], *[F.first(x).alias(x) for x in ("true_above", "true_within")], *[F.min(x).alias(x) for x in _TOPS])
    cols = [
        (F.col("above") + 1).alias("held_out_kinase_rank"),
        (F.col("above") + 1 - F.col("true_above")).alias("adjusted_held_out_rank"),
        F.min(F.col("above") + 1).over(W.partitionBy(*group)).alias("best_true_kinase_rank"),
        F.col("top.name").alias("top1_predicted_kinase"),
        (-F.col("top.less")).alias("top1_score"),
        F.col("n").alias("num_candidate_kinases_scored"),
    ]
    if categories:
        within = (F.col("within") + 1 - F.col("true_within")).alias("adjusted_held_out_rank_in_category")
        cols = [F.col("category").alias("held_out_kinase_category"), *cols, within, *[F.col(f"top_{x}.name").alias(f"top1_{x}") for x in CATEGORIES]]
    return sums.select(*group, "kinase_node_id", *cols)


def held_out_ranks(vectors: DataFrame, slices: dict[str, tuple[int, int]], candidates: DataFrame, trials: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """What trial_ranks gives for cosine scores in each network, by counting: no pair of a site and a candidate leaves the task that scores it.

    A site brings the vectors of its true kinases, so that each block of candidates counts those before each held-out one (in all, and within
    its category) and gives its own best; counts of blocks are added.
    """
    c = with_categories(candidates, vectors, categories)
    s = true_candidates(trials, c).join(doubles(vectors, "sv").withColumnRenamed("node_id", "site_node_id"), "site_node_id")

    def count(left: pa.RecordBatch, right: pa.RecordBatch) -> pa.RecordBatch:
        sv, kv, counter, own = matrix(left.column("sv")), matrix(right.column("vec")), Counter(right), Own(left.column("own"))
        sites = left.column("site_node_id").to_pylist()
        for network, (a, b) in slices.items():
            scores = cosines(sv[:, a:b], kv[:, a:b])
            for i, (begin, end) in enumerate(zip(own.begins, own.ends, strict=True)):
                held = cosines(sv[i : i + 1, a:b], own.vecs[begin:end, a:b])[0]
                counter.add((network, sites[i]), scores[i], own.names[begin:end], own.kinds[begin:end], held)
        return counter.batch([("network", pa.string()), ("site_node_id", pa.string())])

    group = ["network", "site_node_id"]
    ranks = ranks_of_counts(crossed(s, c, count, f"network string, site_node_id string, {COUNTS_SCHEMA}"), group, categories is not None)
    each = trials.withColumn("network", F.explode(F.array(*map(F.lit, slices))))
    return with_truth_lists(each, trials, ranks, [*group, "kinase_node_id"])


def with_truth_lists(trials: DataFrame, truth: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """Trials with their ranks (null where there are none) and the kinases of truth for their site."""
    known = truth.groupBy("site_node_id").agg(F.array_sort(F.collect_set("kinase_node_id")).alias("_k"))
    t = trials.join(known, "site_node_id").join(ranks, keys, "left")
    return t.withColumn("n_true_kinases_for_site", F.size("_k").cast("long")).withColumn("all_true_kinases_for_site", F.array_join("_k", ";")).drop("_k").withColumnRenamed("kinase_node_id", "true_kinase_node_id")


def rank_in_site(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """scores with rank_in_site (for each value of the columns in by): by score, highest first and null last, then by kinase."""
    w = W.partitionBy(*(by or []), "site_node_id").orderBy(F.desc_nulls_last("score"), "kinase_node_id")
    return scores.withColumn("rank_in_site", F.row_number().over(w).cast("long"))


def with_truth(scores: DataFrame, positives: DataFrame) -> DataFrame:
    """scores with is_true_kinase, from the truth set and not from scores that exist."""
    t = positives.select("kinase_node_id", "site_node_id").distinct().withColumn("_t", F.lit(True))
    return scores.join(t, ["kinase_node_id", "site_node_id"], "left").withColumn("is_true_kinase", F.coalesce("_t", F.lit(False))).drop("_t")


def trial_ranks(scores: DataFrame, trials: DataFrame, categories: DataFrame | None = None, per_trial: bool = False) -> DataFrame:
    """One row for each trial (trial_index, kinase_node_id, site_node_id): all ranks of its held-out kinase.

    All windows run over one partitioning by site and one order. The adjusted rank drops other true kinases: the rank less the true
    ones above. Trials whose kinase or site has no score have null ranks. With categories (kinase_node_id, category; absent is
    poor) the same within the kinase's category, and the best kinase of each category. per_trial: scores carry trial_index, each
    trial having its own.
    """
    truth = trials.select("kinase_node_id", "site_node_id").distinct()
    marked = with_truth(scores, truth)
    if categories is not None:
        marked = marked.join(categories.select("kinase_node_id", "category"), "kinase_node_id", "left").withColumn("category", F.coalesce("category", F.lit("poor")))
    group = ["trial_index"] if per_trial else ["site_node_id"]
    by_site = W.partitionBy(*group)
    order = [F.desc_nulls_last("score"), F.col("kinase_node_id")]
    ordered = by_site.orderBy(*order)
    above = ordered.rowsBetween(W.unboundedPreceding, -1)
    true = F.col("is_true_kinase").cast("int")
    r = F.row_number().over(ordered)
    cols = {
        "held_out_kinase_rank": r.cast("long"),
        "adjusted_held_out_rank": (r - F.coalesce(F.sum(true).over(above), F.lit(0))).cast("long"),
        "best_true_kinase_rank": F.min(F.when(F.col("is_true_kinase"), F.col("held_out_kinase_rank"))).over(by_site),
        "top1_predicted_kinase": F.first("kinase_node_id").over(ordered),
        "top1_score": F.first("score").over(ordered),
        "num_candidate_kinases_scored": F.count(F.lit(1)).over(by_site),
    }
    out = marked
    for name, c in cols.items():
        out = out.withColumn(name, c)
    kept = list(cols)
    if categories is not None:
        within = W.partitionBy(*group, "category").orderBy(*order)
        out = out.withColumn("adjusted_held_out_rank_in_category", (F.row_number().over(within) - F.coalesce(F.sum(true).over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).cast("long"))
        for c in ("poor", "average", "rich"):
            out = out.withColumn(f"top1_{c}", F.min(F.when(F.col("category") == c, F.struct("held_out_kinase_rank", "kinase_node_id"))).over(by_site)["kinase_node_id"])
        kept += ["adjusted_held_out_rank_in_category", "top1_poor", "top1_average", "top1_rich"]
    keys = ["kinase_node_id", "site_node_id", *(["trial_index"] if per_trial else [])]
    ranks = out.where("is_true_kinase").select(*keys, *([F.col("category").alias("held_out_kinase_category")] if categories is not None else []), *kept)
    return with_truth_lists(trials, truth, ranks, keys)


def overlay(global_scores: DataFrame, masked: DataFrame) -> DataFrame:
    """Two-tier scores: the masked score where there is one, else the global; then ranked anew."""
    m = masked.select("kinase_node_id", "site_node_id", F.col("score").alias("_m"))
    j = global_scores.join(m, ["kinase_node_id", "site_node_id"], "left")
    return rank_in_site(j.select("kinase_node_id", "site_node_id", F.coalesce("_m", "score").alias("score")))
