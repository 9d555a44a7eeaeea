"""Metrics of trial results, their comparison between runs and networks, and the frames behind reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ids import clean_node_id
from .tables import union_all

KS = (1, 5, 10, 20)
RANKS = {"held_out": "held_out_kinase_rank", "adjusted_held_out": "adjusted_held_out_rank", "best_true": "best_true_kinase_rank"}
ADJUSTED = "adjusted_held_out_rank"
MIN_TRIALS = 5


def hit_rate_ranked(rank: str, k: int) -> Column:
    """Share of the trials that have a rank; 0 if none has."""
    return F.coalesce(F.avg(F.when(F.col(rank).isNotNull(), (F.col(rank) <= k).cast("double"))), F.lit(0.0))


def hit_rate_all(rank: str, k: int) -> Column:
    """Share of all trials; those without a rank are misses."""
    return F.try_divide(F.count(F.when(F.col(rank) <= k, 1)), F.count(F.lit(1)))


def _tall(row: DataFrame, keys: list[str]) -> DataFrame:
    names = [c for c in row.columns if c not in keys]
    return row.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))


def summary(results: DataFrame, keys: list[str] | None = None, ks: tuple[int, ...] = KS) -> DataFrame:
    """(metric, value), by keys if given: hit rates among ranked trials, counts, mean and median, in one aggregation."""
    keys = keys or []
    aggs = []
    for prefix, c in RANKS.items():
        if c not in results.columns:
            continue
        aggs += [hit_rate_ranked(c, k).alias(f"{prefix}_top_{k}_accuracy") for k in ks]
        aggs += [F.count(c).alias(f"{prefix}_n_ranked"), F.count_if(F.col(c).isNull()).alias(f"{prefix}_n_missing_rank"), F.avg(c).alias(f"{prefix}_mean_rank"), F.median(c).alias(f"{prefix}_median_rank")]
    aggs += [F.count(F.lit(1)).alias("n_trials"), F.avg("n_true_kinases_for_site").alias("mean_n_true_kinases_per_site")]
    return _tall(results.groupBy(*keys).agg(*aggs), keys)


def summary_text(metrics: DataFrame, title: str) -> str:
    rows = metrics.collect()  # a few dozen metrics
    return "\n".join([title, "=" * len(title), *(f"{r.metric}: {r.value}" for r in rows)])


def performance(results: DataFrame, keys: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """(keys, rank_kind, metric, value): counts and shares of all trials, mean and median, for each kind of rank."""
    kinds = F.array(*[F.struct(F.lit(p).alias("rank_kind"), F.col(c).alias("rank")) for p, c in RANKS.items()])
    t = results.select(*keys, F.inline(kinds))
    aggs = [F.count(F.lit(1)).alias("n_trials")]
    for k in ks:
        aggs += [F.count(F.when(F.col("rank") <= k, 1)).alias(f"top_{k}_count"), hit_rate_all("rank", k).alias(f"top_{k}_share")]
    aggs += [F.avg("rank").alias("mean_rank"), F.median("rank").alias("median_rank")]
    return _tall(t.groupBy(*keys, "rank_kind").agg(*aggs), [*keys, "rank_kind"])


def multi_truth(results: DataFrame) -> DataFrame:
    """Ranked trials of sites with two true kinases or more."""
    return results.where(F.col(ADJUSTED).isNotNull() & (F.col("n_true_kinases_for_site") >= 2))


def frequency(results: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, value, count, pct) with pct of all rows of the keys."""
    keys = keys or []
    counts = results.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    joined = counts.join(total, keys) if keys else counts.crossJoin(F.broadcast(total))
    return joined.withColumn("pct", F.col("count") / F.col("_n")).drop("_n")


def frequency_by_network(results: DataFrame, networks: list[str], column: str = "top1_predicted_kinase") -> DataFrame:
    """One row for each kinase with count and share by network, 0 where it never comes first."""
    n = results.groupBy("network").agg(F.count(F.lit(1)).alias("_n"))
    f = results.where(F.col(column).isNotNull()).groupBy("network", clean_node_id(F.col(column)).alias("kinase")).agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(n), "network")
    aggs = []
    for x in networks:
        mine = F.col("network") == x
        aggs += [F.coalesce(F.max(F.when(mine, F.col("c"))), F.lit(0)).alias(f"count_{x}"), F.coalesce(F.max(F.when(mine, F.col("c") / F.col("_n"))), F.lit(0.0)).alias(f"pct_{x}")]
    return f.groupBy("kinase").agg(*aggs)


def per_kinase_topk(results: DataFrame, networks: list[str], ks: tuple[int, ...] = (1, 5, 10), min_trials: int = MIN_TRIALS) -> DataFrame:
    """One row for each kinase, with n, shares and median by network; kept if some network has min_trials trials."""
    aggs = []
    for x in networks:
        mine = F.col("network") == x
        n = F.count(F.when(mine, 1))
        aggs.append(F.when(n > 0, n).alias(f"n_{x}"))
        aggs += [F.try_divide(F.count(F.when(mine & (F.col(ADJUSTED) <= k), 1)), n).alias(f"top{k}_{x}") for k in ks]
        aggs.append(F.median(F.when(mine, F.col(ADJUSTED))).alias(f"median_{x}"))
    out = results.groupBy(clean_node_id(F.col("true_kinase_node_id")).alias("kinase")).agg(*aggs)
    sizes = [F.coalesce(F.col(f"n_{x}"), F.lit(0)) for x in networks]
    return out.withColumn("max_n", F.greatest(*sizes) if len(sizes) > 1 else sizes[0]).where(F.col("max_n") >= min_trials)


def category_breakdown(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """For each category of held-out kinases: n, medians of both ranks, shares in the category, its commonest winner."""
    keys = keys or []
    g = [*keys, "held_out_kinase_category"]
    inner = "adjusted_held_out_rank_in_category"
    stats = results.where("held_out_kinase_category is not null").groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.median(ADJUSTED).alias("global_median"), F.median(inner).alias("category_median"), hit_rate_all(inner, 1).alias("category_top1"), hit_rate_all(inner, 5).alias("category_top5"))
    c = F.col("held_out_kinase_category")
    winner = F.when(c == "poor", F.col("top1_poor")).when(c == "average", F.col("top1_average")).when(c == "rich", F.col("top1_rich"))
    counts = results.withColumn("winner", clean_node_id(winner)).where("winner is not null").groupBy(*g, "winner").agg(F.count(F.lit(1)).alias("winner_count"))
    first = F.row_number().over(W.partitionBy(*g).orderBy(F.desc("winner_count"), "winner"))
    best = counts.withColumn("_n", first).where("_n = 1").drop("_n")
    return stats.join(best, g, "left")


def compare_runs(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("generic", "liver")) -> DataFrame:
    """Trials of both runs side by side: ranks, deltas (positive: the second is better), changes, ties."""
    key = ["trial_index", "true_kinase_node_id", "site_node_id"]

    def side(df: DataFrame, n: str) -> DataFrame:
        return df.select(*key, F.col("held_out_kinase_rank").alias(f"{n}_held_out_rank"), F.col("best_true_kinase_rank").alias(f"{n}_best_true_rank"), F.col(ADJUSTED).alias(f"{n}_adjusted_rank"), F.col("top1_predicted_kinase").alias(f"{n}_top1"))

    x, y = names
    m = side(a, x).join(side(b, y), key)
    held, best = (F.col(f"{x}_{r}_rank") - F.col(f"{y}_{r}_rank") for r in ("held_out", "best_true"))
    no = F.lit(False)
    return m.select(
        "*",
        held.alias("held_out_rank_delta"),
        best.alias("best_true_rank_delta"),
        (~F.col(f"{x}_top1").eqNullSafe(F.col(f"{y}_top1"))).alias("top1_changed"),
        F.coalesce(held > 0, no).alias("held_out_improved"),
        F.coalesce(best > 0, no).alias("best_true_improved"),
        F.coalesce(held == 0, no).alias("tied"),
    )


def comparison_summary(compared: DataFrame) -> DataFrame:
    """One row: counts and means of a comparison; what isn't improved counts as worsened, ties too."""
    up = F.col("held_out_improved")
    return compared.agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.count_if("top1_changed").alias("n_top1_changed"),
        F.count_if(up).alias("n_improved"),
        F.count_if(~up).alias("n_worsened"),
        F.count_if("tied").alias("n_tied"),
        F.count_if("best_true_improved").alias("n_best_true_improved"),
        F.avg("held_out_rank_delta").alias("mean_delta"),
        F.avg(F.when(up, F.col("held_out_rank_delta"))).alias("mean_delta_improved"),
        F.avg(F.when(~up, F.col("held_out_rank_delta"))).alias("mean_delta_worsened"),
    )


def extremes(df: DataFrame, column: str, n: int, largest: bool, ties: list[str]) -> DataFrame:
    """The n largest or smallest, nulls apart, ties by the given columns."""
    order = F.col(column).desc() if largest else F.col(column).asc()
    return df.where(F.col(column).isNotNull()).orderBy(order, *ties).limit(n)


def ranking_shifts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(trial_index, ..., delta, improved) of trials ranked in both runs, by adjusted rank."""
    x = a.select("trial_index", "site_node_id", "true_kinase_node_id", F.col(ADJUSTED).alias("rank_a"), F.col("top1_predicted_kinase").alias("top1_a"))
    y = b.select("trial_index", F.col(ADJUSTED).alias("rank_b"), F.col("top1_predicted_kinase").alias("top1_b"))
    m = x.join(y, "trial_index").where("rank_a is not null and rank_b is not null").withColumn("delta", F.col("rank_a") - F.col("rank_b"))
    return m.withColumn("improved", F.col("delta") > 0)


def kinase_shifts(shifts: DataFrame, min_trials: int = MIN_TRIALS) -> DataFrame:
    """(kinase, n_trials, mean_delta, n_improved, pct_improved) of kinases with enough trials."""
    g = shifts.groupBy(clean_node_id(F.col("true_kinase_node_id")).alias("kinase")).agg(F.count(F.lit(1)).alias("n_trials"), F.avg("delta").alias("mean_delta"), F.count_if("improved").alias("n_improved"))
    return g.withColumn("pct_improved", F.col("n_improved") / F.col("n_trials")).where(F.col("n_trials") >= min_trials)


def phase_comparison(first: DataFrame, second: DataFrame, key: str = "network") -> DataFrame:
    """For each network: median, mean and top-20 share of two phases, the change of the median and its percentage."""
    both = union_all([first.withColumn("_p", F.lit(1)), second.withColumn("_p", F.lit(2))])
    aggs = []
    for p in (1, 2):
        mine = F.col("_p") == p
        r = F.when(mine, F.col(ADJUSTED))
        aggs += [F.median(r).alias(f"median_{p}"), F.avg(r).alias(f"mean_{p}"), F.try_divide(F.count(F.when(r <= 20, 1)), F.count(F.when(mine, 1))).alias(f"top20_{p}")]
    d = F.col("median_1") - F.col("median_2")
    return both.groupBy(key).agg(*aggs).select("*", d.alias("delta_median"), F.try_divide(d * 100, F.col("median_1")).alias("pct_improved"))


def case_study(results: DataFrame, kinase: str, keys: list[str]) -> DataFrame:
    """For one kinase, by keys: trials, median, shares among all and among ranked trials, and how often it comes first anywhere."""
    mine = results.where(F.col("true_kinase_node_id") == kinase)
    stats = mine.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median(ADJUSTED).alias("median_rank"), hit_rate_all(ADJUSTED, 1).alias("top1"), hit_rate_all(ADJUSTED, 10).alias("top10"), hit_rate_ranked(ADJUSTED, 20).alias("top20_ranked"))
    wins = results.groupBy(*keys).agg(F.count_if(F.col("top1_predicted_kinase") == kinase).alias("n_top1_anywhere"))
    return stats.join(wins, keys, "left")


def inference_summary(ranks: DataFrame) -> DataFrame:
    """One row: sites covered, pairs, true pairs."""
    return ranks.agg(F.countDistinct("site_node_id").alias("n_sites"), F.count(F.lit(1)).alias("n_pairs"), F.count_if("is_true_kinase").alias("n_true_pairs"))


def top_mean_ranks(ranks: DataFrame, n: int = 20) -> DataFrame:
    """The n kinases with the best mean rank: mean, median, count."""
    g = ranks.groupBy(clean_node_id(F.col("kinase_node_id")).alias("kinase")).agg(F.avg("rank_in_site").alias("mean_rank"), F.median("rank_in_site").alias("median_rank"), F.count(F.lit(1)).alias("n"))
    return g.orderBy("mean_rank", "kinase").limit(n)
