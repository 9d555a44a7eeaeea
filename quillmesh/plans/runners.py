"""Runs over networks and embeddings: one function for each kind of run, with the network, embedding and trials as parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, graph, logistic, metrics
from ..operators.embedding import EmbeddingStrategy, make_strategy
from ..operators.tables import sample_rows
from ..sources import readers, writers

EMBEDDINGS = ("node2vec", "spectral", "concat")


@dataclass
class EvaluationSet:
    candidates: DataFrame
    sites: DataFrame
    positives: DataFrame


def prepare(nodes: DataFrame, edges: DataFrame) -> EvaluationSet:
    nodes, edges = readers.load_graph(nodes, edges)
    return EvaluationSet(evaluation.candidates(nodes), evaluation.sites(nodes), evaluation.positive_edges(edges, nodes))


def trials_of(positives: DataFrame, kind: str = "all", n: int | None = None, seed: int = 42) -> DataFrame:
    """all, multi (sites with several kinases), or n of all sampled by the seed."""
    if kind == "all":
        frozen = evaluation.freeze_all(positives)
    elif kind == "multi":
        frozen = evaluation.freeze_multi(positives)
    else:
        raise ValueError(f"unknown trials: {kind}")
    if n is None:
        return frozen
    return evaluation.freeze_all(sample_rows(frozen.drop("trial_index"), n, ["kinase_node_id", "site_node_id"], seed))


def embed(edges: DataFrame, network: str, strategy: EmbeddingStrategy) -> DataFrame:
    """Vectors of a network without its labelled relation."""
    return strategy.fit(graph.embedding_edges(edges, graph.NETWORKS[network]))


def leave_one_out(nodes: DataFrame, edges: DataFrame, network: str, embedding: str, trials: str = "multi", dimensions: int = 64, n: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Result rows and their metrics."""
    s = prepare(nodes, edges)
    vectors = embed(edges, network, make_strategy(embedding, dimensions, seed))
    cats = evaluation.categories(s.candidates, evaluation.substrate_counts(s.positives))
    results = logistic.leave_one_out(s.positives, trials_of(s.positives, trials, n, seed), s.candidates, vectors, cats)
    return results, metrics.summary(results)


def sweep(spark: SparkSession, nodes: DataFrame, edges: DataFrame, root: str, networks: tuple[str, ...] = tuple(graph.NETWORKS), embeddings: tuple[str, ...] = EMBEDDINGS, dimensions: int = 32, seed: int = 42) -> DataFrame:
    """Ranks of all pairs for each network and embedding under root; combinations whose output is complete are not run again."""
    s = prepare(nodes, edges)
    for network in networks:
        for embedding in embeddings:
            path = f"{root}/network={network}/embedding={embedding}"
            if not writers.exists(spark, f"{path}/_SUCCESS"):
                vectors = embed(edges, network, make_strategy(embedding, dimensions, seed))
                logistic.predict_all(s.positives, s.candidates, s.sites, vectors).write.mode("overwrite").parquet(path)
    return spark.read.option("basePath", root).parquet(*[f"{root}/network={n}/embedding={e}" for n in networks for e in embeddings])


def sweep_summary(ranks: DataFrame) -> DataFrame:
    """For each network and embedding: sites, pairs and true pairs."""
    return ranks.groupBy("network", "embedding").agg(F.countDistinct("site_node_id").alias("n_sites"), F.count(F.lit(1)).alias("n_pairs"), F.count_if("is_true_kinase").alias("n_true_pairs"))
