"""Enrichment, distribution shifts and false discovery: KSEA, two-sample KS, BH, rank tables and the frames behind plots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ids import clean_node_id, strip_prefix
from ..functions.numeric import kolmogorov_tail, neg_log10, normal_tail, normal_tail_exact, significance_stars
from .tables import union_all

MIN_SUBSTRATES, MIN_SIDE, MIN_STD = 3, 30, 1.0


def benjamini_hochberg(df: DataFrame, p: str, tie: str, out: str = "adj_p_value", keys: list[str] | None = None) -> DataFrame:
    """df with adjusted p-values. Tests are few (one for each entity), so they meet in one window for each of keys."""
    w = W.partitionBy(*(keys or []))
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(F.col(p).asc(), tie))).withColumn("_n", F.count(F.lit(1)).over(w))
    from_right = w.orderBy(F.desc("_i")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return ranked.withColumn(out, F.min(F.least(F.lit(1.0), F.col(p) * F.col("_n") / F.col("_i"))).over(from_right)).drop("_i", "_n")


def ksea(fc: DataFrame, sets: DataFrame, min_substrates: int = MIN_SUBSTRATES, exact: bool = False) -> DataFrame:
    """Enrichment of each kinase's substrates among fold changes.

    fc is (site_node_id, fc), sets (kinase_node_id, site_node_id). The score is (mean of substrates - mean of all) * sqrt(m) / sd of
    all, with its one-sided p-value and BH adjustment.
    """
    overall = fc.agg(F.avg("fc").alias("global_mean_fc"), F.stddev_samp("fc").alias("sd"))  # one row
    g = sets.select("kinase_node_id", "site_node_id").distinct().join(fc, "site_node_id").groupBy("kinase_node_id").agg(F.count(F.lit(1)).alias("n_substrates_in_dataset"), F.avg("fc").alias("mean_substrate_fc"))
    g = g.where(F.col("n_substrates_in_dataset") >= min_substrates).crossJoin(F.broadcast(overall))
    g = g.withColumn("ksea_score", F.try_divide((F.col("mean_substrate_fc") - F.col("global_mean_fc")) * F.sqrt(F.col("n_substrates_in_dataset").cast("double")), F.col("sd")))
    g = g.withColumn("p_value", (normal_tail_exact if exact else normal_tail)(F.col("ksea_score")))
    g = g.select("kinase_node_id", clean_node_id(F.col("kinase_node_id")).alias("kinase"), "n_substrates_in_dataset", "mean_substrate_fc", "global_mean_fc", "ksea_score", "p_value")
    return benjamini_hochberg(g, "p_value", "kinase_node_id")


def predicted_sets(ranks: DataFrame) -> DataFrame:
    """Each site as a substrate of its first-ranked kinase."""
    return ranks.where("rank_in_site = 1").select("kinase_node_id", "site_node_id").distinct()


def ksea_three_way(a: DataFrame, b: DataFrame, c: DataFrame, names: tuple[str, str, str] = ("psp", "generic", "liver")) -> DataFrame:
    """Kinases scored by all three sets, with scores, adjusted p-values and the differences from the first."""
    parts = [x.select("kinase", F.col("ksea_score").alias(f"score_{n}"), F.col("adj_p_value").alias(f"adj_p_{n}")) for x, n in zip((a, b, c), names, strict=True)]
    j = parts[0].join(parts[1], "kinase").join(parts[2], "kinase")
    first = F.col(f"score_{names[0]}")
    return j.select("*", *[(F.col(f"score_{n}") - first).alias(f"delta_{n}") for n in names[1:]])


def ks_statistic(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, ks_statistic): the largest distance of the two empirical distribution functions, over keys that both have.

    Values are counted by side first, so the windows run over distinct values.
    """
    both = union_all([a.select(key, F.col(value).alias("v"), F.lit(1).alias("ia"), F.lit(0).alias("ib")), b.select(key, F.col(value).alias("v"), F.lit(0).alias("ia"), F.lit(1).alias("ib"))])
    counts = both.where("v is not null").groupBy(key, "v").agg(F.sum("ia").alias("ca"), F.sum("ib").alias("cb"))
    upto = W.partitionBy(key).orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(key)
    f = counts.select(key, F.sum("ca").over(upto).alias("fa"), F.sum("cb").over(upto).alias("fb"), F.sum("ca").over(whole).alias("na"), F.sum("cb").over(whole).alias("nb")).where("na > 0 and nb > 0")
    return f.groupBy(key).agg(F.max(F.abs(F.col("fa") / F.col("na") - F.col("fb") / F.col("nb"))).alias("ks_statistic"))


#: Cells of the diagonals that a batch of exact tests holds at once.
CELLS = 1 << 15


def ks_exact(d: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """P(D >= d) of two samples of sizes n and m, ties aside, for a batch of tests: the share of lattice paths that leave the band of width d.

    Tests of like width go together, as many as CELLS hold. Time is (n + m) steps of arrays for each such group, not n * m of Python.
    """
    lcm = np.lcm(n, m)
    h = np.rint(d * lcm).astype(np.int64)
    right, up = lcm // n, lcm // m  # what a step along either side adds to the distance
    width = (2 * h - 1) // (right + up) + 1  # cells of a diagonal inside the band, at most
    p = np.ones(len(d))
    order = np.argsort(width, kind="stable")
    order = order[h[order] > 0]
    while len(order):
        fit = width[order] * np.arange(1, len(order) + 1) <= CELLS
        now, order = np.split(order, [max(1, int(np.argmin(fit)) if not fit.all() else len(fit))])
        p[now] = _paths_outside(n[now], m[now], h[now], right[now], up[now], int(width[now].max()))
    return np.clip(p, 0.0, 1.0)


def _paths_outside(n: np.ndarray, m: np.ndarray, h: np.ndarray, right: np.ndarray, up: np.ndarray, width: int) -> np.ndarray:
    """For each test, the share of paths to (n, m) that touch |i * right - j * up| >= h, by whole diagonals i + j = s.

    A share is a mean of the two before it, weighed i and j; shares outside the band are 1. All terms are positive, so that small
    results keep their digits. Diagonals are held from their first cell inside the band, which moves by 0 or 1 at each step.
    """
    out = np.empty(len(n))
    k = np.arange(width)
    share = np.ones((len(n), width + 2))  # a cell more at both ends, outside
    low = -h // (right + up) + 1
    share[np.arange(len(n)), 1 - low] = 0.0
    ends = n + m
    stops = set(ends.tolist())
    for s in range(1, int(ends.max()) + 1):
        new = (s * up - h) // (right + up) + 1
        count = -(-(s * up + h) // (right + up)) - new
        moved = new - low
        low = new
        if moved.all() or not moved.any():
            at = 1 + int(moved[0])
            here, left = share[:, at : at + width], share[:, at - 1 : at - 1 + width]
        else:
            at = moved[:, None] > 0
            here, left = np.where(at, share[:, 2:], share[:, 1:-1]), np.where(at, share[:, 1:-1], share[:, :-2])
        weight = np.minimum(np.maximum((low[:, None] + k) / s, 0.0), 1.0)  # just 1 at i = s, or shares leak in from outside
        share[:, 1:-1] = weight * left + (1.0 - weight) * here
        share[:, 1:-1][k >= count[:, None]] = 1.0
        if s in stops:
            done = np.flatnonzero(ends == s)
            out[done] = share[done, np.clip(1 + n[done] - low[done], 0, width + 1)]
    return out


def _exact_tails(d: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
    known = pc.is_valid(d).to_numpy(zero_copy_only=False)
    x, a, b = (c.filter(pa.array(known)).to_numpy(zero_copy_only=False) for c in (d, n, m))
    p = np.full(len(known), np.nan)
    p[known] = ks_exact(x, a.astype(np.int64), b.astype(np.int64))
    return pa.array(p, mask=~known)


#: Sizes up to which a two-sample test is exact.
EXACT = 10_000


def ks_test(a: DataFrame, b: DataFrame, names: tuple[str, str], min_side: int = MIN_SIDE, min_std: float = MIN_STD, exact: bool = True) -> DataFrame:
    """Rank distributions of each kinase in two networks: sizes, means, medians, population deviations, D, p, shift, BH.

    p is that of the exact distribution where both sides have at most EXACT ranks, else the asymptotic series, which exact=False takes for all.
    """
    x, y = names

    def side(df: DataFrame, n: str) -> DataFrame:
        r = F.col("rank_in_site")
        g = df.groupBy("kinase_node_id").agg(F.count(r).alias(f"n_{n}"), F.avg(r).alias(f"mean_rank_{n}"), F.median(r).alias(f"median_rank_{n}"), F.stddev_pop(r).alias(f"std_rank_{n}"))
        return g.where(F.col(f"n_{n}") >= min_side)

    j = side(a, x).join(side(b, y), "kinase_node_id").join(ks_statistic(a, b, "kinase_node_id", "rank_in_site"), "kinase_node_id")
    better_b = F.col(f"median_rank_{y}") < F.col(f"median_rank_{x}")
    args = F.col("ks_statistic"), F.col(f"n_{x}"), F.col(f"n_{y}")
    p = kolmogorov_tail(*args)
    if exact:
        small = F.greatest(args[1], args[2]) <= EXACT
        p = F.coalesce(F.arrow_udf(_exact_tails, "double")(F.when(small, args[0]), args[1], args[2]), p)
    j = j.select("*", clean_node_id(F.col("kinase_node_id")).alias("kinase"), p.alias("p_value"), F.when(better_b, f"better in {y}").otherwise(f"better in {x}").alias("shift"), ((F.col(f"std_rank_{x}") > min_std) | (F.col(f"std_rank_{y}") > min_std)).alias("informative"))
    return benjamini_hochberg(j, "p_value", "kinase_node_id")


def rank_tables(ranks: DataFrame, networks: list[str]) -> DataFrame:
    """One row for each kinase: mean and sample deviation of its rank by network (ranks carry network)."""
    aggs = []
    for n in networks:
        r = F.when(F.col("network") == n, F.col("rank_in_site"))
        aggs += [F.avg(r).alias(f"mean_{n}"), F.stddev_samp(r).alias(f"std_{n}")]
    return ranks.groupBy(clean_node_id(F.col("kinase_node_id")).alias("kinase")).agg(*aggs)


def informative(tables: DataFrame, networks: list[str], min_std: float = MIN_STD) -> Column:
    """Whether the rank varies in some of the networks."""
    out: Column = F.lit(False)
    for n in networks:
        out = out | F.coalesce(F.col(f"std_{n}") > min_std, F.lit(False))
    return out


def rank_deltas(tables: DataFrame, baseline: str, targets: list[str]) -> DataFrame:
    return tables.select("kinase", *[(F.col(f"mean_{t}") - F.col(f"mean_{baseline}")).alias(f"{t}_minus_{baseline}") for t in targets], informative(tables, [baseline, *targets]).alias("informative"))


def volcano(tested: DataFrame, names: tuple[str, str], n: int | None = None) -> DataFrame:
    """(kinase, delta, neg_log_p, score) of a KS test: medians of the first less the second; the n highest scores if given."""
    x, y = names
    v = tested.select("kinase", (F.col(f"median_rank_{x}") - F.col(f"median_rank_{y}")).alias("delta"), neg_log10(F.col("adj_p_value")).alias("neg_log_p"), "informative")
    v = v.withColumn("score", F.col("neg_log_p") * F.abs("delta"))
    return v.orderBy(F.desc("score"), "kinase").limit(n) if n else v


def enrichment_vs_rank(scored: DataFrame, results: DataFrame, rank: str = "adjusted_held_out_rank", min_trials: int = 5) -> DataFrame:
    """(kinase, ksea_score, adj_p_value, stars, median_rank, n_trials) of kinases with both."""
    r = results.groupBy(strip_prefix(F.col("true_kinase_node_id")).alias("kinase")).agg(F.median(rank).alias("median_rank"), F.count(F.lit(1)).alias("n_trials")).where(F.col("n_trials") >= min_trials)
    return scored.select("kinase", "ksea_score", "adj_p_value", significance_stars(F.col("adj_p_value")).alias("stars")).join(r, "kinase")


#: Rows that may be clustered: the distances of all pairs meet in one task (200 MB).
CLUSTER_ROWS = 5_000


def leaf_order(x: np.ndarray) -> list[int]:
    """The rows of x as the leaves of their average-linkage tree over Euclidean distances, the cluster with the smaller number at the left."""
    n = len(x)
    if n < 2:
        return list(range(n))
    d = np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1), 0)) if n * n * x.shape[1] < 50_000_000 else np.stack([np.sqrt(((x - r) ** 2).sum(1)) for r in x])
    np.fill_diagonal(d, np.inf)
    size, alive, chain, merges = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):  # nearest-neighbour chains
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        a, b = sorted((a, b))
        merges.append((d[a, b], a, b))
        new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        alive[a], size[b] = False, size[a] + size[b]
        d[b], d[:, b] = new, new
        d[b, b] = np.inf
    number, leaves, root = list(range(n)), {i: [i] for i in range(n)}, list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, (_, a, b) in enumerate(sorted(merges, key=lambda t: t[0])):  # stable: equal distances in the order found
        a, b = top(a), top(b)
        first, second = (a, b) if number[a] < number[b] else (b, a)
        root[a] = b
        number[b], leaves[b] = n + k, leaves[first] + leaves[second]
    return leaves[top(0)]


def cluster_order(tables: DataFrame, columns: list[str], key: str = "kinase") -> DataFrame:
    """(key, place): rows without nulls in the order of their clustering. For tables of a row for each of at most CLUSTER_ROWS entities, else ValueError."""
    whole = tables.select(key, *columns).dropna()
    if whole.count() > CLUSTER_ROWS:
        raise ValueError(f"over {CLUSTER_ROWS} rows to cluster")

    def ordered(t: pa.Table) -> pa.Table:
        t = t.sort_by(key)
        order = leaf_order(np.stack([t.column(c).to_numpy().astype(float) for c in columns], axis=1))
        return pa.table({key: t.column(key).take(pa.array(order)), "place": pa.array(np.arange(1, len(order) + 1))})

    return whole.withColumn("_g", F.lit(0)).groupBy("_g").applyInArrow(lambda t: ordered(t), f"{key} string, place long")
