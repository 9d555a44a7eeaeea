"""Results of running experiments as a stream: which trials are done, and how well, so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metrics import ADJUSTED, KS, hit_rate_all

RESULTS = T.StructType([T.StructField("trial_index", T.LongType()), T.StructField("true_kinase_node_id", T.StringType()), T.StructField("site_node_id", T.StringType()), T.StructField(ADJUSTED, T.LongType()), T.StructField("experiment", T.StringType())])


def follow(spark: SparkSession, root: str, files_at_once: int = 100) -> DataFrame:
    """The results table of an experiment folder as a stream of rows, as its Parquet files appear."""
    return spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", files_at_once).parquet(f"{root.rstrip('/')}/results")


def running_metrics(results: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(experiment, n_trials, mean_rank, top_k_accuracy ...), one row for each experiment, the state of which is all that is kept."""
    rank = F.col(ADJUSTED)
    return results.groupBy("experiment").agg(F.count(F.lit(1)).alias("n_trials"), F.avg(rank).alias("mean_rank"), *[hit_rate_all(ADJUSTED, k).alias(f"top_{k}_accuracy") for k in ks])
